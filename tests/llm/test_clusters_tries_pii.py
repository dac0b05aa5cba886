"""Operators 11 to 13 against SQL and brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sheafray.llm import centroids, pii, trie

SF = "/root/testdata/sf0.001"


def _same_as_sql(df, sql: str, table: str, path: str) -> None:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x)) for x in df.select(*names).collect())


# -- 11: centroids ----------------------------------------------------------


def _lloyd(rows: list[tuple[int, list]], k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cents = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds + 1):
        at = [min((far(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
        last = cents
        cents = list(cents)
        for n in range(len(cents)):
            own = [v for (_, v), (_, m) in zip(kept, at, strict=True) if m == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total, by = sum(d for d, _ in at), defaultdict(int)
    for d, n in at:
        by[n] += d
    return sorted((i, n, d, by[n], total, hashlib.sha256(",".join(map(str, last[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at, strict=True))


def test_centroids_equal_sql(spark):
    _same_as_sql(centroids.centroid_query(spark, SF), centroids.CENTROID_SQL, "embeddings", f"{SF}/embeddings.parquet")


def test_centroids_brute_force_with_odd_rows(spark):
    rng = random.Random(5)
    centre = [[rng.uniform(-9, 9) for _ in range(64)] for _ in range(20)]
    rows = [(k, [c + rng.gauss(0, 0.1) for c in centre[k % 20]]) for k in range(300)]
    # Ties: vectors in the middle of others, copies, and a crowd of one vector.
    rows += [(1000 + k, rows[0][1]) for k in range(150)] + [(2000 + k, [(a + b) / 2 for a, b in zip(rows[k][1], rows[k + 1][1], strict=True)]) for k in range(40)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65), (3004, [None] + [1.0] * 63), (3005, [float("nan")] * 64), (3006, [float("-inf")] + [0.0] * 63), (3007, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, pairs int")
    got = sorted(map(tuple, centroids.centroid_clusters(df.repartition(7)).collect()))
    assert got == _lloyd(rows)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = centroids.centroid_clusters(few).collect()
    assert {(r.vec_id, r.cluster) for r in got} == {(1, 1), (2, 1), (None, 0)}
    none = centroids.centroid_clusters(few.where("vec_id > 5"))
    assert none.collect() == [] and none.columns == centroids.centroid_clusters(few).columns
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert [r.distance for r in centroids.centroid_clusters(huge, k=1, rounds=0).orderBy("distance").collect()] == [0, 64 * (2 * centroids.LARGEST) ** 2]


def test_annulus_spares_pairs_and_keeps_ties():
    rng = np.random.default_rng(3)
    cents = np.concatenate([rng.integers(-5, 6, (40, 8)) + 200 * k for k in range(6)]).astype(np.int64)
    cents[7] = cents[3]  # equal centroids: the smaller number
    x = np.concatenate([cents + rng.integers(-2, 3, cents.shape), (cents[:-1] + cents[1:]) // 2])
    at, best, pairs = centroids.nearest(x, cents)
    d = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    again, _, fewer = centroids.nearest(x, cents, at)
    assert (again == at).all() and fewer <= pairs
    assert fewer < 0.4 * len(x) * len(cents)


# -- 12: trie ---------------------------------------------------------------


def _trie(rows: list[tuple], branched: bool = True) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    if branched:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        made = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    else:
        made = own
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo, out = [p], []
        while todo:
            out.append(todo.pop())
            todo += kids[out[-1]]
        return out

    out = []
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in m if len(made[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


_TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.select(*_TRIE_COLUMNS).collect())


def _conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230)]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ab", "héé", ""])) for t in range(n)]
    rows += [(100, None, None, None), (101, None, "user", None), (101, None, "user", None), (102, 0, "user", "a"), (None, 3, "user", "lost")]
    rows += [(300, t, "user", f"x{t % 3}") for t in range(700)] + [(301 + k, t, "user", f"x{t % 3}") for k in range(3) for t in range(200)]
    rows += [(-7, 0, "user", "a"), (-100, 0, "user", "bb")]
    return rows


_KIND = "conv_id long, turn long, role string, text string"


def test_trie_equals_sql(spark):
    _same_as_sql(trie.trie_query(spark, SF), trie.TRIE_SQL, "conversations", f"{SF}/conversations.parquet")


@pytest.mark.parametrize("branched", [True, False])
def test_trie_brute_force(spark, branched):
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{_KIND}, depth int, path string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # long conversations then span partitions
    try:
        assert _nodes(trie.prefix_trie(df, branched)) == _trie(rows, branched)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("spread", "bases"), [(2, trie.BASES), (1, trie.BASES), (3, (1, 1))])
def test_colliding_fingerprints_are_split(spark, spread, bases):
    rows = [r for r in _conversations() if r[0] is None or r[0] < 300]
    df = spark.createDataFrame(rows, _KIND)
    assert _nodes(trie.prefix_trie(df, True, spread, bases)) == _trie(rows)


def test_trie_of_nothing_and_of_copies(spark):
    assert _nodes(trie.prefix_trie(spark.createDataFrame([], _KIND), True)) == []
    rows = [(c, t, "user", f"turn {t}") for c in range(2500) for t in range(2)]
    assert _nodes(trie.prefix_trie(spark.createDataFrame(rows, _KIND))) == _trie(rows, False)


def test_products_and_sums_modulo_the_prime():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, trie.P, 500).astype(np.uint64) for _ in range(2))
    assert [int(x) for x in trie.product(a, b)] == [int(x) * int(y) % trie.P for x, y in zip(a, b, strict=True)]
    e = rng.integers(0, 10_000, 50)
    assert [int(x) for x in trie.power(trie.BASES[0], e)] == [pow(trie.BASES[0], int(k), trie.P) for k in e]
    first = rng.random(500) < 0.05
    first[0] = True
    total, want = 0, []
    for x, f in zip(a, first, strict=True):
        total = int(x) if f else (total + int(x)) % trie.P
        want.append(total)
    assert [int(x) for x in trie.running(a, first)] == want


# -- 13: personal data ------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def _base(text: str) -> list[tuple]:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def _spelled(spans) -> str:
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("01239.@+- ()aZ_%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == _base(text), text


def test_base_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.pii_query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = _base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(_spelled(want).encode()).hexdigest()
        assert set(filter(None, _spelled(want).split(","))) <= set(r.spans.split(","))


def test_time_is_linear_in_the_text():
    for unit in ("1", "a", "1.", "a.", "1-", "+1", "@", "a@", "(", "x(at)", " 1", "+1("):
        text = unit * (400_000 // len(unit))
        pii.candidates(text, pii.base_spans(text))


def _scores(entities: list[tuple], rounds: int, support: int, confidence: float) -> dict:
    """Pattern confidences by dictionaries; entities: (instance, kind, patterns)."""
    edges = {(i, p) for i, _, ps in entities for p in ps}
    size = defaultdict(set)
    for i, p in edges:
        size[p].add(i)
    seen = defaultdict(lambda: defaultdict(int))
    for i, k, _ in entities:
        if k >= 0:
            seen[i][k] += 1
    seeds = {(i, k): n / sum(ks.values()) for i, ks in seen.items() for k, n in ks.items()}
    scores = dict(seeds)
    for _ in range(rounds):
        mass, n = defaultdict(float), defaultdict(int)
        for i, p in edges:
            for k in range(4):
                if (i, k) in scores:
                    mass[p, k] += scores[i, k]
                    n[p, k] += 1
        sure = {pk: m / (len(size[pk[0]]) + 1) for pk, m in mass.items() if n[pk] >= support and m / (len(size[pk[0]]) + 1) >= confidence}
        rest = defaultdict(lambda: 1.0)
        for i, p in edges:
            if i not in seen:
                for k in range(4):
                    if (p, k) in sure:
                        rest[i, k] *= 1 - sure[p, k]
        scores = dict(seeds)
        for i in {i for i, _ in rest}:
            score, k = max((1 - rest[i, k], -k) for k in range(4) if (i, k) in rest)
            scores[i, -k] = score
    return sure


def _documents() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [f"{prose(5)} ring my desk on +1 (555) 010-{k:04d} before noon {prose(4)}" for k in range(60)]
    docs += [f"{prose(5)} ring my desk on 555-77{k:02d}-{k:03d} or {prose(5)}" for k in range(12)]
    # The second round's: found only through what the first discovers.
    docs += [f"{prose(4)} dial extension 555-77{k:02d}-{k:03d} for help {prose(3)}" for k in range(12)]
    docs += [f"write to me at user{k}@mail.example.org today {prose(3)}" for k in range(20)] + ["write to me at jane.roe [at] example [dot] org today then"]
    docs += [f"{prose(3)} order number 2024{k:05d} shipped {prose(3)}" for k in range(25)]
    docs += [prose(30) for _ in range(40)] + [None, "", "the 1.2.3.4 the 4111 1111 1111 1111 the 999.1.1.1 and 4111111111111112"]
    return list(enumerate(docs))


def test_contexts_discover_unseen_identifiers(spark):
    docs = _documents()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, pattern string, kind int").repartition(6)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(docs)
    entities = []
    for _, t in docs:
        base = pii.base_spans(t or "")
        entities += [(pii.instance_of(t[s:e]), k, pii.patterns_of(t, s, e)) for s, k, e in base]
        entities += [(pii.instance_of(t[s:e]), -1, pii.patterns_of(t, s, e)) for s, e in pii.candidates(t or "", base)]
    for rounds in (1, pii.ROUNDS):
        sure = _scores(entities, rounds, pii.SUPPORT, pii.CONFIDENCE)
        told = {(r.pattern, r.kind): r.confidence for r in pii.scored_patterns(pii.scanned(df).selectExpr("inline(found)"), rounds).collect()}
        assert told.keys() == sure.keys() and all(abs(told[k] - sure[k]) < 1e-9 for k in sure)
        if rounds == 1:
            assert not any("extension" in p for p, _ in sure)
    assert any("extension" in p for p, _ in sure)
    for i, t in docs:
        assert [tuple(s) for s in got[i].base] == _base(t or "")
        added = {t[s.start : s.end]: pii.KINDS[s.kind] for s in got[i].added}
        if t and ("555-77" in t):
            assert list(added.values()) == ["phone"], (t, added)
        elif t and "[at]" in t:
            assert added == {"jane.roe [at] example [dot] org": "email"}
        else:
            assert not added


def test_no_documents_and_repeated_ones(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.base), len(r.added)) for r in pii.personal_data(rows).collect()) == [(0, 1, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0)]
