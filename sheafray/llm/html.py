"""HTML extraction (operator 1): templates from equivalence classes of tokens.

Pages of a host come from few templates. A page is a sequence of tokens: its
tags, told apart by the path of tags that encloses them, and the strings of
its blocks, told apart likewise. Tokens of one host that occur equally often
on every page, that is, share their occurrence vector, form a class; a class
with enough tokens and pages is valid, valid classes nest in each other's
gaps, and together they are the host's template. What stands between template
tokens are slots. Strings that are template tokens are boilerplate. Of the
rest, a page's article or main element is extracted if it has one; else all
that stands in the container, the lowest element around the slots that hold
the most text over the host's pages and around first headings. A page whose
container holds less than half of its text, or that has none, is extracted
whole. Paths have no digits of ids and class names, as pages number them.
Menus, page headers, footers, sidebars and adverts are told by their tags and
roles. Forms, and words of class names and ids, only make an element doubtful;
headings never are. Beside an article or main element, forms and elements whose
class name begins with a word for comments are left out whatever they hold. Any
other doubtful element is left out if it holds at most a quarter of its page's text, or at most half
and its path is on half of the host's pages, or the host has no template. An
element with most of the text, or with an article, and body, main and article
themselves are never left out for a word; elements within are judged anew.

Vectors are never built: a page has a random 64-bit number, and the sum over
pages of count times that number is a token's fingerprint, equal for equal
vectors. Sums combine before the shuffle, so a host with a third of all pages
is no task's burden. Only tokens on at least half of a host's pages are
grouped, at most twice as many as a page has on average. Pages do not move.

Defined cases: a null html, or one without content, gives the empty text; a
null url is a host of its own; a host with fewer than ``LEAST_PAGES`` pages
has no template strings, its pages are read by their tags alone; cut-off and
unclosed markup is read as far as it goes; repeated rows are extracted each;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import takewhile
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Pages of a host from which strings may count as template.
LEAST_PAGES = 8
#: Share of a host's pages that a template token is on.
SUPPORT = 0.5
#: Strings whose class has no tag are dropped only if on nearly all pages of
#: the host; a class with tags is a template, and its pages all carry it.
STRING_SUPPORT = 0.95
LEAST_TOKENS = 3

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas audio video select".split())
#: Tags that end a block.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "head", "caption", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
#: Tags that may be the container of an article.
HOLDERS = frozenset("body center div section td".split())
#: Tags and roles whose content is not the article.
ASIDE = frozenset("nav footer aside button dialog menu head".split())
#: Tags, and first words of class names and ids, of what is left out whatever it
#: holds beside an article; a form without one may be the whole page's wrapper.
BESIDE = frozenset("form fieldset".split())
BESIDE_WORDS = frozenset("comment comments disqus replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus replies widget toolbar pagination pager skip".split()
)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            if value.lower() in ASIDE_ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


@lru_cache(maxsize=50_000)
def _doubtful(name: str, attributes: str) -> bool:
    """Whether it is a form, or a class name or id has a word of asides; a
    heading is what it heads."""
    if name in ("html", "body", "main", "article") or name in HEADINGS:
        return False
    if name in BESIDE:
        return True
    values = [v for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id")]
    return any(w.lower() in ASIDE_WORDS for v in values for w in _WORD.findall(v))


@lru_cache(maxsize=50_000)
def _beside(name: str, attributes: str) -> bool:
    """Whether an element is left out beside an article even if it is longer."""
    firsts = [_WORD.findall(token)[:1] for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id") for token in v.strip("\"'").split()]
    return name in BESIDE or any(w and w[0].lower() in BESIDE_WORDS for w in firsts)


@lru_cache(maxsize=50_000)
def _label(name: str, attributes: str) -> str:
    """An element in a path: its tag, class and id, without digits."""
    if "class" not in attributes and "id=" not in attributes:
        return name
    return name + "".join(f" {k.lower()}={_DIGITS.sub('', v)}" for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id"))


class Block(NamedTuple):
    path: int
    text: str
    #: Within an article or main element.
    inside: bool
    #: Tags before it.
    place: int
    #: Paths of the holders around its own element.
    above: tuple[int, ...]
    #: In a first heading.
    title: bool
    #: Paths of doubtful elements around it that the template decides on.
    doubts: tuple[int, ...]


def parse(html: str) -> tuple[list[int], list[Block], set[int]]:
    """Hashes of the page's tag tokens, its blocks outside asides, and the
    paths of its doubtful elements."""
    tags: list[int] = []
    kept: list[tuple[Block, tuple[int, ...]]] = []
    # Doubtful elements: path, chars, whether with an article, whether beside one.
    worded: list[list] = []
    marked = False
    # Open elements: name, hash of the path, aside, within the article, holders around it, worded ones around its content.
    stack: list[tuple[str, int, bool, bool, tuple[int, ...], tuple[int, ...]]] = [("", 0, False, False, (), ())]
    buffer: list[str] = []
    names: dict[str, int] = {}
    at, end = 0, len(html)

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                kept.append((Block(top[1], text, top[3], len(tags), top[4], names.get("h1", 0) > 0, ()), top[5]))
                for k in top[5]:
                    worded[k][1] += len(text)

    def close(name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == name:
                del stack[depth:]
                return

    while at < end:
        m = _MARKUP.search(html, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1][2]:
            piece = html[at:stop]
            buffer.append(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            elif name in ("td", "th"):
                buffer.append(" ")
            names[name] = names.get(name, 0) - 1
            if names[name] >= 0:
                close(name)
            else:
                names[name] = 0
            continue
        attributes = m[3] or m[6] or ""
        if name in BLOCK:
            flush()
            if name in CLOSES_P and names.get("p", 0) > 0:
                names["p"] = 0
                close("p")
        if name in ("td", "th"):
            buffer.append(" ")
        top = stack[-1]
        content = name in ("article", "main") or ("main" in attributes and 'role="main"' in attributes)
        path = _hash(f"{top[1]:x}/{_label(name, attributes)}")
        tags.append(path)
        if name in VOID or attributes.endswith("/") and name in ("br", "hr"):
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = found.end() if found else end
            continue
        # An article after an unclosed menu or header is an article still.
        aside = (top[2] and not (content and not top[3])) or _aside(name, attributes, top[3])
        names[name] = names.get(name, 0) + 1
        above = top[4] + (top[1],) if top[0] in HOLDERS else top[4]
        marks = top[5]
        marked = marked or content
        if content and not top[3]:
            for k in marks:
                worded[k][2] = True
        elif _doubtful(name, attributes):
            marks = (*marks, len(worded))
            worded.append([path, 0, False, _beside(name, attributes)])
        stack.append((name, path, aside, top[3] or content, above, marks))
    flush()
    total = sum(len(b.text) for b, _ in kept)
    beside = {k for k, (_, chars, whole, beside) in enumerate(worded) if beside and marked and not whole and chars < total}
    doubtful = beside | {k for k, (_, chars, whole, _) in enumerate(worded) if not whole and 2 * chars <= total}
    short = beside | {k for k in doubtful if 4 * worded[k][1] <= total}
    blocks = [b._replace(doubts=tuple(worded[k][0] for k in marks if k in doubtful)) if marks else b for b, marks in kept if short.isdisjoint(marks)]
    return tags, blocks, {worded[k][0] for k in doubtful}


def _string(path: int, text: str) -> int:
    return _hash(f"{path:x}|{text}")


_COUNTS = "host string, token long, kind int, path long, pages long, vector long, place double, chars long, above array<long>"


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _count(batches: Iterator) -> Iterator:
    """Partial counts by host and token; kind 0 is the page, 1 a tag, 2 a
    string, 3 a slot (the text of one path; its token is 1 within articles, 2
    in first headings), 4 a doubtful element. A page's chars are those outside articles."""
    import pyarrow as pa

    sums: dict[tuple, list] = {}

    def rows():
        keys, values = list(sums), list(sums.values())
        columns = [[k[0] for k in keys], [_signed(k[1]) for k in keys], [k[2] for k in keys], [_signed(k[3]) for k in keys], [v[0] for v in values], [_signed(v[1]) for v in values], [v[2] for v in values], [v[3] for v in values], [[_signed(a) for a in v[4]] for v in values]]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "token", "kind", "path", "pages", "vector", "place", "chars", "above"])

    for batch in batches:
        for host, key, html in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tags, blocks, doubtful = parse(html or "")
            page = [1, 0.0, 0, ()]
            own: dict[tuple, list] = {(host, 0, 0, 0): page}
            for k, tag in enumerate(tags):
                own.setdefault((host, tag, 1, tag), [0, float(k), 0, ()])[0] += 1
            for path in doubtful:
                own[host, path, 4, path] = [1, 0.0, 0, ()]
            for path, text, inside, place, above, title, _ in blocks:
                own.setdefault((host, _string(path, text), 2, path), [0, place + 0.5, 0, ()])[0] += 1
                slot = own.setdefault((host, 1 if inside else 2 if title else path, 3, path if not inside else 0), [0, place + 0.5, 0, () if inside else above])
                slot[0] += 1
                slot[2] += len(text)
                if not inside:
                    page[2] += len(text)
            for token, (n, place, chars, above) in own.items():
                s = sums.setdefault(token, [0, 0, 0.0, 0, above])
                s[0] += 1
                s[1] = (s[1] + n * key) & (2**64 - 1)
                s[2] += place
                s[3] += chars
        if len(sums) > 200_000:
            yield rows()
    yield rows()


def _template(table):
    """One host's template from its frequent tokens: the strings to drop,
    the container to extract where no article is marked, and the doubtful
    elements to leave out, null without a template."""
    import pyarrow as pa

    rows = table.to_pylist()
    host, pages = rows[0]["host"], rows[0]["host_pages"]
    classes: dict[tuple[int, int], list[dict]] = {}
    for r in rows:
        if r["kind"] in (1, 2):
            classes.setdefault((r["vector"], r["pages"]), []).append(r)
    valid = [sorted(c, key=lambda r: r["place"] / r["pages"]) for c in classes.values() if len(c) >= LEAST_TOKENS]
    # Nest: a class lies in a gap of a wider one, between two of its tokens.
    spans = [(c[0]["place"] / c[0]["pages"], c[-1]["place"] / c[-1]["pages"], c) for c in valid]
    nested = []
    for lo, hi, c in spans:
        outer = [o for o in spans if o[2] is not c and o[0] <= lo and hi <= o[1] and len(o[2]) >= len(c)]
        crossing = [o for o in spans if o[2] is not c and (o[0] < lo < o[1] < hi)]
        if outer or not crossing or c[0]["pages"] == pages:
            nested.append(c)
    fixed = [c for c in nested if pages >= LEAST_PAGES and (c[0]["pages"] >= STRING_SUPPORT * pages or any(r["kind"] == 1 for r in c))]
    drop = [r["token"] for c in fixed for r in c if r["kind"] == 2]
    asides = [r["token"] for r in rows if r["kind"] == 4] if pages >= LEAST_PAGES else None
    loose = [r for r in rows if r["kind"] == 3 and r["token"] != 1]
    most = max((r["chars"] for r in loose), default=0)
    heavy = [r["above"] for r in loose if 4 * r["chars"] >= most or r["token"] == 2]
    shared = [level[0] for level in takewhile(lambda level: len(set(level)) == 1, zip(*heavy))]  # noqa: B905
    within = sum(r["chars"] for r in loose if shared and shared[-1] in r["above"])
    # Where paths differ by page, the frequent ones say nothing of the article.
    container = shared[-1] if pages >= LEAST_PAGES and shared and 2 * within >= rows[0]["host_chars"] else None
    return pa.table({"host": pa.array([host], pa.string()), "drop": pa.array([drop], pa.list_(pa.int64())), "container": pa.array([container], pa.int64()), "asides": pa.array([asides], pa.list_(pa.int64()))})


def templates(pages: DataFrame) -> DataFrame:
    """(host, drop, container, asides), one row per host, from (host, key, html)."""
    counts = pages.mapInArrow(_count, _COUNTS).groupBy("host", "token", "kind", "path").agg(
        F.sum("pages").alias("pages"),
        # Sums of 64-bit numbers modulo 2**64, in two halves so that they cannot overflow.
        F.sum(F.shiftrightunsigned("vector", 32)).alias("high"),
        F.sum(F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum("place").alias("place"),
        F.sum("chars").alias("chars"),
        # A path is a hash of the paths around it: equal on all rows.
        F.first("above").alias("above"),
    )
    vector = ((F.col("high").bitwiseAND(F.lit(0x3FFFFFFF)) * F.lit(1 << 32)).bitwiseXOR(F.col("low"))).alias("vector")
    counts = materialize(counts.select("host", "token", "kind", "path", "pages", vector, "place", "chars", "above"), "html-counts")
    hosts = counts.where("kind = 0").select("host", F.col("pages").alias("host_pages"), F.col("chars").alias("host_chars"))
    frequent = counts.where("kind > 0").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    return frequent.groupBy("host").applyInArrow(_template, "host string, drop array<long>, container long, asides array<long>")


def page_text(html: str | None, drop: set[int], container: int | None, asides: set[int] | None) -> str:
    """The text of a page under its host's template."""
    _, blocks, _ = parse(html or "")
    blocks = [b for b in blocks if not b.doubts or (asides is not None and not any(_signed(d) in asides for d in b.doubts))]
    blocks = [b for b in blocks if not drop or _signed(_string(b.path, b.text)) not in drop]
    chosen = [b for b in blocks if b.inside]
    if not chosen and container is not None:
        chosen = [b for b in blocks if any(_signed(a) == container for a in b.above)]
        if 2 * sum(len(b.text) for b in chosen) < sum(len(b.text) for b in blocks):
            chosen = blocks
    return "\n".join(b.text for b in chosen or blocks)


def _extract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        sets: dict[tuple, set[int]] = {}
        as_set = lambda x: sets.setdefault(tuple(x or ()), set(x or ()))
        texts = [page_text(h, as_set(d), c, None if a is None else as_set(a)) for h, d, c, a in zip(*[batch.column(c).to_pylist() for c in ("html", "drop", "container", "asides")], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url").alias("key"))
    # One row per host; Spark broadcasts it if its measured size allows, else joins by host and splits crowded ones.
    known = materialize(templates(rows.select("host", "key", "html")), "html-templates")
    return rows.join(known, "host", "left").select("page_id", "url", "html", "drop", "container", "asides").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
