import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafray.llm import embeddings, neardup
from sheafray.llm.rolling import mix64


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = {i: i for i in bags}
    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = sum((bags[a] & bags[b]).values())
            total = bags[a].total() + bags[b].total() - common
            if common and common / total >= 0.8:
                x, y = _find(parent, a), _find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: _find(parent, i) for i in ids}


def _rows():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    out = [None, "", " \n", "one", "one", "a b c d", "a b c d"]
    for family in range(6):
        base = [word() for _ in range(120 + 40 * family)]
        for copy in range(25):
            words = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 4, 7])):
                words[random.randrange(len(words))] = word()
            out.append(" ".join(words))
    out += [" ".join(word() for _ in range(100)) for _ in range(40)] + ["echo " * 200, "echo " * 190, "echo " * 90]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [1024, 8])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bands string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_one_outsider_in_a_large_bucket(spark):
    """A bucket of one component but for one member sends each member about
    once, and all pairs of different components meet."""
    n, lots = 100_000, -(-100_000 // neardup.BLOCK)
    rows = spark.range(n).select(F.lit(5).cast("long").alias("bucket"), F.col("id").alias("node"), F.when(F.col("id") == 77, 77).otherwise(0).cast("long").alias("component"))
    met = neardup._lots(rows).persist()
    assert n <= met.count() <= n + 2 * lots
    sides = met.groupBy("one", "two").agg(F.countDistinct("component").alias("components"), F.sum((F.col("node") == 77).cast("int")).alias("outsiders"))
    assert sides.where("components = 2").count() == lots and sides.where("outsiders > 1").count() == 0
    met.unpersist()


@pytest.mark.parametrize("sizes", [[30, 1], [20, 20, 3, 1], [1] * 40, [8, 9, 7, 16]])
def test_lots_meet_all_components(spark, monkeypatch, sizes):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    component = [k for k, n in enumerate(sizes) for _ in range(n)]
    rows = spark.createDataFrame([(1, i, -c) for i, c in enumerate(component)], "bucket long, node long, component long")
    pairs, seen = neardup._lots(rows).collect(), set()
    for one, two in {(r.one, r.two) for r in pairs}:
        left, right = ({r.node for r in pairs if (r.one, r.two, r.block) == (one, two, side)} for side in (one, two))
        assert len(left) <= 24 and len(right) <= 24
        seen |= {(min(a, b), max(a, b)) for a in left for b in right}
    assert seen >= {(a, b) for b in range(len(component)) for a in range(b) if component[a] != component[b]}


def test_null_ids_repeats_and_stage(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(None, text, 1), (7, text, 2), (7, text, 2), (3, text + " tail", 3), (9, "alone", 4)], "doc_id long, text string, other int")
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(docs).collect())
    assert got == Counter({(None, None): 1, (7, 3): 2, (3, 3): 1, (9, 9): 1})
    kept = sorted((str(r.doc_id), r.other) for r in neardup.near_stage(spark, docs, "").collect())
    assert kept == [("3", 3), ("9", 4), ("None", 1)]
    assert neardup.classes(docs.limit(0)).collect() == []


def test_texts_that_share_an_id(spark):
    """Each text is judged by itself: none is lost to another under its id,
    and a copy of another document's text goes whatever its id holds besides."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(3, one, "a"), (5, two, "b"), (5, one, "c"), (5, three, "d"), (5, three, "e"), (6, three + " tail", "f"), (5, " ", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {(r.doc_id, r.text.strip()[:2]) for r in neardup.near_stage(spark, docs, "").collect()}
    assert kept >= {(3, "x0"), (5, "y0"), (5, "")} and len(kept) == 4 and kept & {(5, "z0"), (6, "z0")}
    got = {(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()}
    assert got >= {(3, 3), (5, 3), (5, 5)} and got & {(6, 5), (6, 6)}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 6, 150)
    b = a.copy()
    b[:40] = rng.integers(0, 9, 40)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for seed in range(30):
        bag = lambda c: np.repeat(mix64(np.arange(150, dtype=np.uint64) + np.uint64(1000 * seed), 5), c)  # noqa: B023, E731
        x, y = bag(a), bag(b)
        s = neardup.bag_signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - true) < 4 * np.std(agree) / 30**0.5


def _vectors():
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, None):
        base = rng.standard_normal((60, 32))
        for v in base:
            for _ in range(rng.integers(1, 6)):
                rows.append((k, (v + rng.standard_normal(32) * rng.choice([0, 0.1, 0.25, 0.4])).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, None, 0), (k + 3, [0.0] * 32, 0), (k + 4, [float("nan")] * 32, 0), (k + 5, [None] * 32, 1), (k + 6, [1.0, 2.0], 1), (k + 7, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = _vectors()
    good = {i: np.array(v, float) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in rows}
    links, parent = Counter(), {i: i for i, _, _ in rows}
    for a in good:
        for b in good:
            if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a] * (good[b] @ good[b])) >= 0.93:
                links[a] += 1
                links[b] += 1
                x, y = _find(parent, a), _find(parent, b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, v, x, "node") for i, v, x in rows], "vec_id long, embedding array<float>, label int, node string")
    got = embeddings.near_vectors(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert found <= sum(links.values()) and found >= 0.98 * sum(links.values())
    if found == sum(links.values()):
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], _find(parent, r.vec_id), _find(parent, r.vec_id) == r.vec_id)
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_list_decoding_lists_every_filter():
    code = embeddings.ProductCode(32, 5000)
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((20, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for v, found in zip(unit, code.filters(unit), strict=True):
        score = (code.code[0] @ v[:16])[:, None] + (code.code[1] @ v[16:])[None, :]
        assert found.tolist() == np.flatnonzero(score.ravel() >= code.cut).tolist()


@pytest.mark.parametrize("rows", [10**4, 10**6, 10**8])
def test_pairs_at_the_threshold_share_filters_at_any_size(rows):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + (1 - 0.931**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    shared = np.zeros(150)
    for k in range(embeddings.CODES):
        code = embeddings.ProductCode(64, rows, seed=k)
        shared += [len(np.intersect1d(a, b)) for a, b in zip(code.filters(x), code.filters(y), strict=True)]
    assert (shared > 0).mean() >= 0.95
    assert shared.mean() >= 0.7 * embeddings.CODES * embeddings.SHARED
