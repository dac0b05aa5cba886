import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sheafray.llm import exchange, substring, suffixes
from sheafray.llm.rolling import Members, SpanHash, Words, byte_codes, byte_runs, run_hashes, sliding_argmin, text_buffer, within


def _texts():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(1, 5)))
    text = lambda n: "".join(word() + random.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
    passage, base = text(60), text(400)
    out = [None, "", "  ", text(34), text(35)]
    out += [text(random.randint(0, 90)) + passage + text(random.randint(0, 90)) for _ in range(40)]
    for _ in range(30):
        words = base.split(" ")
        words[random.randrange(len(words))] = "zz"
        out.append(" ".join(words))
    out += [base, base, "ha " * 300, "x" * 2000, "no spaces" + "é" * 700]
    return out


TEXTS = _texts()


def _docs(spark, texts=TEXTS):
    rows = [(k, t, "left", 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, values string, _row long")


def brute_words(texts, n=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def brute_bytes(texts, n=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + n] for t in raw for k in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("size", [1 << 22, 1 << 13])
def test_words(spark, monkeypatch, size):
    monkeypatch.setattr(exchange, "GROUP_BYTES", size)
    want = brute_words(TEXTS)
    got = substring.repeat_digests(_docs(spark)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize(("size", "hot"), [(1 << 22, 256), (1 << 13, 2), (1 << 14, 0)])
def test_bytes(spark, monkeypatch, size, hot):
    monkeypatch.setattr(exchange, "GROUP_BYTES", size)
    want = brute_bytes(TEXTS)
    got = suffixes.repeat_digests(_docs(spark), hot=hot).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_rewrite_keeps_columns_and_unrepeated_text(spark):
    docs = _docs(spark)
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    want = brute_words(TEXTS)
    assert set(got) == set(range(len(TEXTS))) and got[0].asDict().keys() == set(docs.columns)
    for k, r in got.items():
        assert len((r.text or "").split()) == want[k][0] - want[k][1] or "é" in (TEXTS[k] or "")
        if not want[k][1]:
            assert (r.text or "") == (TEXTS[k] or "")


def test_empty_tables(spark):
    empty = _docs(spark).limit(0)
    assert substring.repeat_digests(empty).collect() == [] and suffixes.repeat_digests(empty).collect() == []


def test_maximal_repeats():
    groups = suffixes.maximal_repeats([b"xxabcdefyy", b"zzabcdefqq", b"wwabcdemm"], [list(range(7))] * 3, 4)
    assert (6, [(0, 2), (1, 2)]) in [(n, sorted(w)) for n, w in groups]
    assert (5, [(0, 2), (1, 2), (2, 2)]) in [(n, sorted(w)) for n, w in groups]
    assert len(groups) == 2


def test_difference_cover():
    on = set(substring.COVER)
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + d) % substring.PERIOD in on and (b + d) % substring.PERIOD in on for d in range(substring.PERIOD))


def test_kernels():
    import pyarrow as pa

    data, bounds = text_buffer(pa.array(["ab c", None, "", "d", "e f "]))
    w = Words(data, bounds)
    assert [bytes(data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [b"ab", b"c", b"d", b"e", b"f"]
    assert w.first.tolist() == [0, 2, 2, 2, 3, 5]
    h = SpanHash(byte_codes(np.frombuffer(b"abcabcabd", np.uint8))).windows(3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert within(np.array([0, 3, 3, 5]), 2).tolist() == [True, True, False, True]
    values = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    at = sliding_argmin(values, 37)
    assert all(values[p] >> np.uint64(32) == (values[k : k + 37] >> np.uint64(32)).min() and k <= p < k + 37 for k, p in enumerate(at.tolist()))


@pytest.mark.parametrize(("chunk", "hot"), [(1 << 20, 256), (3000, 3)])
def test_passages_are_half_a_window(spark, monkeypatch, chunk, hot):
    """The further columns, and the same answers from slices of long texts."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    random.seed(11)
    long = "".join(random.choice("abcdefgh ") for _ in range(30_000))
    texts = [*TEXTS, long, "ab " + long[7000:20_000] + "cd", long[1000:1250] + "zz" + long[9000:9390], "".join(random.choice("xyz") for _ in range(20_000))]
    want, passages = brute_bytes(texts), brute_bytes(texts, suffixes.LEAST)
    got = suffixes.repeat_digests(_docs(spark, texts), hot=hot).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert (r.n_repeated, r.n_passages) == passages[r.doc_id][1:3]


@pytest.mark.parametrize("hot", [256, 4])
def test_repeat_groups(spark, hot):
    """Each group is one string with all its places, and the groups cover
    what brute force covers."""
    raw = [(t or "").encode() for t in TEXTS]
    held: dict[str, set] = {}
    for r in suffixes.repeat_groups(_docs(spark), hot=hot).collect():
        held.setdefault(r.repeat_id, set()).add((r.doc_id, r.start, r.length))
    covered = [np.zeros(len(t), bool) for t in raw]
    for places in held.values():
        assert len(places) > 1
        (text,) = {raw[d][s : s + n] for d, s, n in places}
        assert len(places) == sum(1 for t in raw for k in range(len(t) - len(text) + 1) if t.startswith(text, k))
        for d, s, n in places:
            covered[d][s : s + n] = True
    for c, (_, n, _, _) in zip(covered, brute_bytes(TEXTS), strict=True):
        assert c.sum() == n


def test_bytes_are_cut_out(spark):
    docs = _docs(spark)
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    want = brute_bytes(TEXTS)
    assert set(got) == set(range(len(TEXTS))) and got[0].asDict().keys() == set(docs.columns)
    for k, r in got.items():
        if not want[k][1]:
            assert r.text == TEXTS[k]
        elif (TEXTS[k] or "").isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[k][3]


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bits[:n]


def test_strings_that_a_polynomial_takes_for_equal(spark):
    """Two strings of 1,024 letters, one the other with its letters swapped,
    have one hash in any sum of powers of an odd number modulo 2**64."""
    a = "".join("ab"[b] for b in thue_morse(1024))
    b = "".join("ba"[b] for b in thue_morse(1024))
    side = [" ".join(f"w{k}" for k in range(s, s + 20)) for s in (0, 100)]
    texts = [f"{side[0]} {a} {side[1]}", f"{side[0]} {b} {side[1]}", a[:700], b[:700]]
    for r in substring.repeat_digests(_docs(spark, texts[:2])).collect():
        assert (r.n_words, r.n_removed) == (41, 0)
    want = brute_bytes(texts)
    for hot in (256, 0):
        for r in suffixes.repeat_digests(_docs(spark, texts), hot=hot).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_rows_of_a_shuffle_are_dealt_alike(spark):
    docs = _docs(spark).repartition(5, "text")
    want = brute_words(TEXTS)
    for r in substring.repeat_digests(docs).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_words_and_runs_by_content():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh" * 2, b"x" * 64, b"x" * 65, b"y" * 5000]
    data = np.frombuffer(b" ".join([*words, *words]), np.uint8)
    for lane in (0, 1):
        h = Words(data, np.array([0, len(data)])).hashes(lane).tolist()
        assert h[: len(words)] == h[len(words) :] and len(set(h)) == len(words)
    runs = byte_runs(data, 21).tolist()
    raw = data.tobytes()
    same: dict[bytes, set] = {}
    for k, v in enumerate(runs):
        same.setdefault(raw[k : k + 21], set()).add(v)
    assert len(runs) == len(raw) - 20 and all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)
    codes = np.arange(50, dtype=np.uint64) % np.uint64(5)
    assert run_hashes(codes, 7)[0] == run_hashes(codes, 7)[5] and len(set(run_hashes(codes, 7).tolist())) == 5
    both = Members(np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint64))
    assert both.of(np.array([7, 7, 7, 9, 9], np.uint64), np.array([1, 2, 3, 3, 1], np.uint64)).tolist() == [True, True, False, True, False]
