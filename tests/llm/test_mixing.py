from collections import defaultdict

import pytest

from sheafray.llm import mixing


def reshared(sizes: dict, share: float = 1.0) -> dict:
    """Targets by dealing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        total = sum(weight[s] for s in free)
        target = {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3.0 * sizes[s] for s in over}


def _mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()


def test_targets_and_taken(spark):
    rows = [(k, "abcdefg"[k % 7], " ".join(["w"] * (1 + (k * 37) % 90))) for k in range(700)]
    rows += [(1000 + k, "huge", " ".join(["w"] * 50)) for k in range(400)] + [(2000, None, "a b c"), (2001, "a", None), (2002, "b", ""), (None, "b", "x y"), (2003, "empty", "")]
    got = _mixed(spark, rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = reshared(dict(sizes))
    by_id = {r[0]: r for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        source = by_id[r.doc_id][1]
        assert r.size == len((by_id[r.doc_id][2] or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, _mixed(spark, rows[::-1])), key=str)


def test_empty_table(spark):
    assert _mixed(spark, []) == []


def test_stage_repeats_documents(spark):
    docs = spark.createDataFrame([(k, f"one two {k}", "ab"[k % 2], "x") for k in range(200)], "doc_id long, text string, source string, whole string")
    got = mixing.mix_stage(spark, docs, "")
    assert got.columns == docs.columns
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["a"] - 600 * 5 / 7 / 3) <= 1 and abs(counts["b"] - 600 * 2 / 7 / 3) <= 1
