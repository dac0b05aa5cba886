import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from sheafray.llm import html, packing, tokenfile, tokens
from sheafray.llm.tokens import encoder, vocabulary

KINDS = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]
SYMBOLS = ["a", "The", "ing", "E", "é", "ß", "İ", "Σ", "漢", "1", "²", "Ⅷ", "_", "-", "'", "s", "ll", ".", ",", " ", "  ", "\n", "\t", "\r", "\x1c", " ", " ", "́", "🙂", "<|endoftext|>", "<|", "|>", "$$$", "ŉ", "ﬁ"]


@pytest.mark.parametrize(("name", "kind"), KINDS)
@settings(max_examples=300, deadline=None)
@given(parts=hs.lists(hs.sampled_from(SYMBOLS), max_size=12))
def test_pieces_join_to_the_library_ids(name, kind, parts):
    e, text = encoder(vocabulary(name), kind), "".join(parts)
    assert np.frombuffer(e.encode_batch([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_new_words_take_no_room_from_those_that_come_again(name, kind, monkeypatch):
    """Room goes to what comes twice, a word takes it once, and neither the
    order of the texts nor what is kept shows in the ids."""
    monkeypatch.setattr(tokens, "MEMO_OPEN", 20, raising=False)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 120)
    e = tokens.Encoder(vocabulary(name), kind)
    # Letters only, so that no digit is cut off.
    spell = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    once = [f"x zq{spell(k)}é {'y' * 70}{spell(k)}" for k in range(2000)]
    again = ["x " + " ".join(f"wv{spell(k)} wv{spell(k)}, it's{spell(k)}" for k in range(25))] * 3
    odd = ["", None, "x  y", "x \ty", "x İstanbul İ", "x e\u0301a", "x a²b Ⅷ", "x " + "漢" * 200, "(wva) wva(wvb", "wva"]
    for text in [*once, *again, *odd, *again, *once[:50]]:
        want = e.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(e.encode_batch([text])[0], "<u4").tolist() == want
    kept = e.memo.keys()
    assert {f"wv{spell(k)}" for k in range(25)} | {f"wv{spell(k)}," for k in range(25)} <= kept
    assert len(kept) <= 120 and all(len(w) <= tokens.MEMO_CHARS for w in kept)
    # Runs behind a space are stored with the pieces only.
    assert not any(r.startswith(" ") for r in e.runs)


TEXTS = [(k, "abc"[k % 3], f"Word{k} and more, words. " * (k % 40)) for k in range(150)] + [(200, None, None), (201, "a", ""), (202, "a", "long " * 30000)]


def _docs(spark):
    return spark.createDataFrame([(i, s, t, "ids") for i, s, t in TEXTS], "doc_id long, source string, text string, ids string")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    path = f"file://{tmp_path}/t"
    tokenfile.write_tokens(_docs(spark), path, vocabulary("byte_bpe_50k.json"), encoding=encoding)
    tk, start = encoder(vocabulary("byte_bpe_50k.json"), "byte").tokenizer, 0
    got = {r.doc_id: r for r in tokenfile.token_digests(spark, path).collect()}
    whole = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).collect()}
    assert len(got) == len(TEXTS)
    for i, _, t in sorted(TEXTS):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[i].ids == ids and whole[i].start == start
        start += len(ids)


def test_packing(spark):
    pieces = packing.pack(_docs(spark), vocabulary("word_bpe_49k.json"), slice_tokens=20_000).collect()
    tk = encoder(vocabulary("word_bpe_49k.json"), "word").tokenizer
    docs, windows, shares = defaultdict(list), defaultdict(list), defaultdict(lambda: defaultdict(int))
    source = {i: s for i, s, _ in TEXTS}
    ids = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for i, _, t in TEXTS}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        docs[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
        shares[p.sequence_id][source[p.doc_id]] += p.length
    for spans, total in [(docs[i], len(ids[i])) for i in ids] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total or (total is None and at <= packing.WINDOW)
    sizes = [sum(n for _, n in windows[k]) for k in sorted(windows)]
    assert all(n == packing.WINDOW for n in sizes[:-1]) and sorted(windows) == list(range(len(sizes)))
    total = sum(map(len, ids.values()))
    for s in ("a", "b", "c"):
        goal = sum(len(ids[i]) for i in ids if source[i] == s) / total
        for k in list(shares)[:-1]:
            assert abs(shares[k][s] - goal * sizes[k]) <= 3 * packing.PACKET
    assert packing.pack(_docs(spark).limit(0), vocabulary("word_bpe_49k.json")).collect() == []


def test_slices_of_few_tokens_are_cut_together(spark):
    """Once a queue has run out, slices by rounds hold little: 800 packets at
    targets of 1 to 1000 make tens of thousands of them."""
    starts = spark.range(39_000).select(F.col("id").alias("slice"), F.when(F.col("id") < 25, F.col("id") * 4096).otherwise(F.lit(25 * 4096) + (F.col("id") - 25) * 5).alias("slice_start"))
    lots = packing._together(starts, 4096).groupBy("lot").agg(F.min("slice").alias("a"), F.max("slice").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(lots) <= 25 + 39_000 * 5 // 4096 + 2 and all(r.b - r.a + 1 == r.n for r in lots)
    docs = spark.createDataFrame([(k, "few words of a document " * 40, "ab"[k % 2]) for k in range(300)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), slice_tokens=4096, targets={"a": 1.0, "b": 1000.0}).collect()
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert ends.get(p.sequence_id, 0) == p.offset
        ends[p.sequence_id] = p.offset + p.length
    assert sorted(ends) == list(range(len(ends))) and all(ends[k] == packing.WINDOW for k in range(len(ends) - 1))
    assert {p.doc_id: sum(q.length for q in pieces if q.doc_id == p.doc_id) for p in pieces} == {p.doc_id: p.doc_tokens for p in pieces} and len({p.doc_id for p in pieces}) == 300


@pytest.mark.parametrize("wide", [False, True])
def test_packing_to_targets(spark, monkeypatch, wide):
    """Windows hold the targets' proportions while all queues last, and those
    of the remaining ones after; ids of any width come back."""
    docs = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None, f"Word{k} and more, words. " * 60, "x") for k in range(300)], "doc_id long, source string, text string, part string")
    if wide:
        monkeypatch.setattr(packing, "id_width", lambda *_: 4)
    goal = {"a": 6.0, "b": 3.0, None: 1.0}
    source = {r.doc_id: r.source for r in docs.collect()}
    tk = encoder(vocabulary("word_bpe_49k.json"), "word").tokenizer
    ids = {r.doc_id: [*tk.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    left = {s: sum(len(ids[i]) for i in ids if source[i] == s) for s in goal}
    windows, at = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for p in packing.pack(docs, vocabulary("word_bpe_49k.json"), slice_tokens=20_000, targets=goal).collect():
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        windows[p.sequence_id][source[p.doc_id]] += p.length
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()} and sorted(windows) == list(range(len(windows)))
    mixed = 0
    for k in sorted(windows)[:-1]:
        assert sum(windows[k].values()) == packing.WINDOW
        live = {s for s in goal if left[s] > 2 * packing.WINDOW}
        if len(live) == 3:
            mixed += 1
            for s in goal:
                assert abs(windows[k][s] - packing.WINDOW * goal[s] / 10) <= 2 * packing.PACKET
        for s in goal:
            left[s] -= windows[k][s]
    assert mixed > 3
    with pytest.raises(ValueError):
        packing.pack(docs, vocabulary("word_bpe_49k.json"), targets={"a": 0.0})


def _page(k, body="", host="a.example.com"):
    return (k, f"http://{host}/{k}", f"<html><head><title>T{k}</title><script>if (a < b) 'x'</script></head><body><header>Top</header><nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>{body}<aside>Side {k}</aside><form><input>Mail</form><footer>&copy; host</footer></body></html>")


def test_html(spark):
    pages = [_page(k, f"<article><h1>Title&nbsp;{k} &amp; more</h1><p>First <b>bold{k}</b>\n text<p>Second {k}<br>line{k}<p>Sign up now<div class='comments'>nice</div></article>") for k in range(12)]
    loose = [_page(100 + k, f"<div id='x'><p>Body {k} " + "text " * 30 + "</p></div><div>Subscribe today</div>", "b.example.org") for k in range(12)]
    odd = [(200, None, None), (201, "", ""), (202, "http://c.example.net/", "plain <b>words"), (203, "http://c.example.net/x", "<article><p>cut off<p>here <a href='x"), (204, "http://c.example.net/y", "<nav>menu<article><p>unclosed menu</article>")]
    rows = [*pages, *loose, *odd, pages[0]]
    got = defaultdict(list)
    for r in html.extract(spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string")).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert len(got[0]) == 2
    for k in range(12):
        assert set(got[k]) == {f"Title {k} & more\nFirst bold{k} text\nSecond {k}\nline{k}"}
        assert got[100 + k] == [f"Body {k} " + " ".join(["text"] * 30)]
    assert [got[k][0] for k in (200, 201, 202, 203, 204)] == ["", "", "plain words", "cut off\nhere", "unclosed menu"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def _texts(spark, bodies):
    rows = [(k, f"http://plain/{k}", f"<html>{b}</html>") for k, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("number", ["", "{k}"])
def test_html_without_an_article_keeps_every_block(spark, number):
    long = "These words of page {k} go on for long. " * 12
    body = f"<body><div class='date'>day {{k}} by an author</div><div id='post-{number}'><h1>Title {{k}}</h1><div class='text'><p>{long}</p><h2>Part {{k}}</h2><ul><li>Point {{k}}</li></ul><blockquote>Quote {{k}}</blockquote><pre>code {{k}}</pre><p>{long}</p></div></div></body>"
    for pages in (12, 3):
        for k, text in _texts(spark, [body.format(k=k) for k in range(pages)]).items():
            lines = text.split("\n")
            article = [f"Title {k}", long.format(k=k).strip(), f"Part {k}", f"Point {k}", f"Quote {k}", f"code {k}", long.format(k=k).strip()]
            assert lines == (article if pages == 12 else [f"day {k} by an author", *article])


@pytest.mark.parametrize("pages", [12, 3])
@pytest.mark.parametrize("body", ["<body class='has-sidebar'>{t}</body>", "<body><div id='content' class='with-sidebar'>{t}</div></body>", "<body><article class='post no-comments'>{t}</article></body>", "<body><div class='ad-free'><main>{t}</main></div></body>"])
def test_html_words_of_classes_do_not_empty_a_page(spark, body, pages):
    aside = "<div class='sidebar'>Side {k}</div>"
    text = "<p>Article {k} goes on.</p><p>" + "Many words {k}. " * 10 + "</p>"
    got = _texts(spark, [body.replace("{t}", text + aside).format(k=k) for k in range(pages)])
    assert got == {k: f"Article {k} goes on.\n" + " ".join([f"Many words {k}."] * 10) for k in range(pages)}


def test_html_template_of_some_pages(spark):
    """A template that 12 of 20 pages use; a doubtful element of one page is its text."""
    frame = "<div class='one'><span></span><i></i><p>Read by all who come here</p></div>"
    body = "<body>{f}<div class='text'><p>{t}</p>{n}</div></body>"
    bodies = [body.format(f=frame if k < 12 else "", t=f"Words {k}. " * 12, n=f"<div class='notice'>{f'Told {k}. ' * 8}</div>" if k == 3 else "") for k in range(20)]
    got = _texts(spark, bodies)
    for k in range(20):
        assert got[k].split("\n") == [" ".join([f"Words {k}."] * 12)] + ([" ".join(["Told 3."] * 8)] if k == 3 else [])
