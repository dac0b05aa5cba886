"""Forms, comments and headings of pages; codes where no filter can help."""

import random

import pytest

from sheafray.llm import embeddings, html

BODY = "".join(f"<p>Paragraph {k} of the story goes on and on.</p>" for k in range(4))
STORY = "\n".join(f"Paragraph {k} of the story goes on and on." for k in range(4))


def _text(page: str) -> str:
    return html.page_text(page, set(), None, set())


def test_a_page_in_a_form_is_read_and_small_forms_are_not():
    assert _text(f"<body><form id='aspnet'><div>{BODY}</div></form></body>") == STORY
    assert _text(f"<body><form><article>{BODY}</article></form></body>") == STORY
    assert _text(f"<body><form>Search <input></form>{BODY}<fieldset>Subscribe</fieldset></body>") == STORY
    # Beside an article a form is left out even if it is longer.
    assert _text(f"<article>{BODY}</article><form>{'<p>terms and conditions of use</p>' * 40}</form>") == STORY
    assert _text(f"<article>{BODY}<form>{'<p>terms and conditions of use</p>' * 40}</form></article>") == STORY


def test_comments_that_outweigh_the_article():
    for made in ('<section class="comments">{}</section>', '<div id="comment-list">{}</div>', '<ol class="replies open">{}</ol>'):
        said = made.format("".join(f"<div><p>Reader {k} has a great deal to say about it all.</p></div>" for k in range(40)))
        for page in (f"<main><article>{BODY}</article>{said}</main>", f"<article>{BODY}{said}</article>", f"<body><article>{BODY}</article>{said}</body>"):
            assert _text(page) == STORY
    # A word within a name is no list of comments.
    assert _text(f'<article class="post no-comments"><div class="post-with-comments">{BODY}</div></article>') == STORY


def test_headings_and_formulas_stay():
    assert _text(f'<article><h2 class="section-share">Shares</h2>{BODY}<p>so <math><mi>x</mi></math> holds</p></article>') == f"Shares\n{STORY}\nso x holds"


@pytest.mark.parametrize(("dim", "rows"), [(8, 10**4), (12, 10**6), (16, 10**8), (64, 10**9), (384, 10**6), (768, 10**9)])
def test_codes_have_directions_near_both_of_a_pair(dim, rows):
    cut, words = embeddings.code_size(dim, rows)
    assert (cut, words) == (float("-inf"), 1) or (cut < ((1 + embeddings.THRESHOLD) / 2) ** 0.5 and embeddings.CODES * words**2 < 2**31)


def test_short_vectors_of_a_huge_label_are_all_compared(spark, monkeypatch):
    """As if the label had 1e8 rows: no code would find these pairs."""
    assert embeddings.code_size(8, 10**8) == (float("-inf"), 1)
    sized = embeddings.code_size
    monkeypatch.setattr(embeddings, "code_size", lambda dim, rows: sized(dim, 10**8))
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(k, v, 1) for k, v in enumerate(base)] + [(100 + k, [x + rng.gauss(0, 0.12) for x in v], 1) for k, v in enumerate(base)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {i: sum(cos(v, w) >= embeddings.THRESHOLD for j, w, _ in rows if j != i) for i, v, _ in rows}
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want and sum(want.values()) > 60
