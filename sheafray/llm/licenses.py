"""License scans (operator 8): an exact set-similarity join of text blocks with
a table of license texts, in native expressions only.

A block is a window of ``2 * step`` words, one every ``step`` words, so any run
of ``step`` words lies whole in some block, however its lines are broken.
``step`` is the least power of two, 32 at least, that a template's words fit
in; templates and blocks of one step meet. A template matches a block when at
least ``THRESHOLD`` of its distinct words are in it, its marks among them. All
tokens of templates have one global order, from rare to frequent over all
documents, and a block is the ordered list of those that it holds. Blocks and
templates are joined on a token of the template's prefix:

* prefix filter: a template's needed overlap is ``need``; a block that holds
  none of its first ``size - need + 1`` tokens cannot match;
* length filter: a block with fewer than ``need`` tokens of the order cannot
  match;
* positional filter: once the first common token stands at known places in
  both, no more tokens can be common than follow it on the shorter side.

What passes is verified by the overlap itself. The prefixes are one row for
each template and prefix token, so that side is bounded by the templates, at
most ``MOST_TOKENS`` distinct tokens, and broadcast; a document is judged where
it is read, its matches are aggregated there, and a document whose words hold
no template's prefix is one row with no block.

The base labels are the phrases' places, found on the same words.

Defined cases: a null or empty text has no words, no places and the score 0;
repeated rows are scanned each; an empty table gives no rows; further columns
are not read; templates without words are left out.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let
from .license_texts import TEXTS

#: Base phrases, by their words, and their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
THRESHOLD = 0.8
LEAST_STEP = 32
#: Distinct tokens of all templates, at most: they are literals of the plan.
MOST_TOKENS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither letter nor digit (the text is in lower case).
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Words of a text in ASCII lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _BREAK), lambda x: x != "")


def plain_words(text: str) -> list[str]:
    """The same words of a template."""
    return [w for w in re.split(_BREAK, text.translate({ord(a): b for a, b in zip(_UPPER, _LOWER, strict=True)})) if w]


class Template:
    """A license text as a set of words."""

    def __init__(self, label: str, text: str, marks: str = "") -> None:
        words = plain_words(text)
        self.label, self.tokens, self.marks = label, sorted(set(words)), sorted(set(plain_words(marks)))
        self.step = LEAST_STEP
        while self.step < len(words):
            self.step *= 2
        self.need = ceil(THRESHOLD * len(self.tokens))


def templates(texts: tuple = TEXTS) -> list[Template]:
    """The templates of (label, text, marks) rows."""
    found = [t for t in (Template(*row) for row in texts) if t.tokens]
    if len({w for t in found for w in t.tokens}) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    return found


def token_order(docs: DataFrame, known: list[Template]) -> dict[str, int]:
    """Ranks of the templates' tokens, the rarest first, by the number of
    documents that hold them, ties by the token.

    The counts cover all documents; only the templates' tokens reach the
    driver.
    """
    tokens = sorted({w for t in known for w in t.tokens})
    if not tokens:
        return {}
    held = docs.select(F.explode(F.array_intersect(license_words(F.col("text")), _names(tokens))).alias("token"))
    found = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (found.get(w, 0), w)))}


def _names(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def prefixes(spark: SparkSession, known: list[Template], order: dict[str, int]) -> DataFrame:
    """One row for each template and token of its prefix: step, token, its
    place in the template, and the template."""
    ints = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    rows = []
    for k, t in enumerate(known):
        ranks, marks = sorted(order[w] for w in t.tokens), [order[w] for w in t.marks if w in order]
        rows.append(F.struct(F.lit(t.step).alias("step"), F.lit(k).alias("template"), F.lit(t.label).alias("label"), ints(ranks).alias("ranks"), ints(marks).alias("marks"), F.lit(t.need).alias("need")))
    every = F.array(*rows) if rows else F.array().cast("array<struct<step:int,template:int,label:string,ranks:array<int>,marks:array<int>,need:int>>")
    table = spark.range(1).select(F.explode(every).alias("t")).select("t.*")
    return table.select("*", F.posexplode(F.slice("ranks", 1, F.size("ranks") - F.col("need") + 1)).alias("place", "token"))


def blocks(words: Column, known: list[Template], order: dict[str, int]) -> Column:
    """Array of (step, ranks) of a text's blocks that hold a token of a prefix
    and enough tokens for some template."""
    none = F.array().cast("array<struct<step:int,ranks:array<int>>>")
    if not order:
        return none
    by_rank = sorted(order, key=order.get)
    rank = F.map_from_arrays(_names(by_rank), F.sequence(F.lit(0), F.lit(len(by_rank) - 1)))
    heads = {}
    for t in known:
        ranks = sorted(order[w] for w in t.tokens)
        heads.setdefault(t.step, set()).update(ranks[: len(ranks) - t.need + 1])

    def of(ws: Column, step: int) -> Column:
        least = min(t.need for t in known if t.step == step)
        head = F.array(*[F.lit(k) for k in sorted(heads[step])])
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ws) - 1), F.lit(step))
        held = F.transform(starts, lambda s: F.array_sort(F.transform(F.array_intersect(F.slice(ws, s + 1, F.lit(2 * step)), _names(by_rank)), lambda w: F.element_at(rank, w))))
        return F.transform(F.filter(held, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, head)), lambda b: F.struct(F.lit(step).alias("step"), b.alias("ranks")))

    def near(step: int) -> Column:
        return _names([by_rank[k] for k in sorted(heads[step])])

    return F.concat(none, *[F.when(F.arrays_overlap(words, near(step)), of(words, step)).otherwise(none) for step in sorted(heads)])


def _matches(found: DataFrame, table: DataFrame) -> DataFrame:
    """Join blocks with templates on tokens of prefixes: adds label and share
    where a template matches, else null."""
    size = F.size("ranks_t")
    t = F.broadcast(table.select("step", "token", "place", "template", "label", F.col("ranks").alias("ranks_t"), "marks", "need"))
    b = found.select("*", F.posexplode_outer("block.ranks").alias("at", "token")).withColumn("step", F.col("block.step"))
    met = b.join(t, ["step", "token"], "left")
    length = F.size("block.ranks") >= F.col("need")
    position = F.least(size - F.col("place"), F.size("block.ranks") - F.col("at")) >= F.col("need")
    # Only the first common token of the two lists tells of the pair.
    first = ~F.arrays_overlap(F.slice(F.col("ranks_t"), F.lit(1), F.col("place")), F.col("block.ranks"))
    overlap = F.size(F.array_intersect("block.ranks", "ranks_t"))
    marked = F.size(F.array_except("marks", "block.ranks")) == 0
    share = F.when(length & position & first & marked, F.when(overlap >= F.col("need"), overlap.cast("double") / size))
    return met.withColumn("share", share)


def phrase_places(words: Column) -> Column:
    """Array of (start, label), one for each place of a phrase."""
    none = F.array().cast("array<struct<start:int,label:string>>")

    def at(ws: Column) -> Column:
        def here(phrase: tuple[str, ...], label: str, i: Column) -> Column:
            hit = F.lit(True)
            for back, word in enumerate(reversed(phrase[:-1]), 1):
                hit = hit & (F.get(ws, i - back) == word)
            return F.when(hit, F.struct((i - (len(phrase) - 1)).alias("start"), F.lit(label).alias("label")))

        ends = F.filter(F.transform(ws, lambda x, i: F.when(x == "license", i)), lambda i: i.isNotNull())
        return F.filter(F.flatten(F.transform(ends, lambda i: F.array(*[here(p, label, i) for p, label in PHRASES]))), lambda x: x.isNotNull())

    return F.when(F.array_contains(words, "license"), at(words)).otherwise(none)


def scan(docs: DataFrame, texts: tuple = TEXTS) -> DataFrame:
    """One row per document: the base places and labels, and the join's with
    the templates of ``texts``, rows of (label, text, marks)."""
    known = templates(texts)
    order = token_order(docs, known)
    # The number tells rows apart from here to the aggregation, in one pass.
    judged = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        let(license_words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n"), phrase_places(ws).alias("base"), blocks(ws, known, order).alias("blocks"))).alias("f"),
    )
    found = judged.select("doc_id", "row", F.col("f.n").alias("n"), F.col("f.base").alias("base"), F.explode_outer("f.blocks").alias("block"))
    hit = _matches(found, prefixes(docs.sparkSession, known, order))
    by_row = hit.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("base").alias("base"), F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("match"), F.max("share").alias("best")
    )
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts, base = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    return by_row.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, "match")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: license phrases and templates in all documents.

    ``score`` is the largest containment that met the threshold; a base
    phrase, contained whole, counts 1.
    """
    return scan(documents(spark, sf_dir))


def license_sql() -> str:
    """The same rows in SQL, by comparing every block with every template."""
    rows = ", ".join(f"('{t.label}', {t.step}, {t.need}, {t.tokens}, {t.marks}::VARCHAR[])" for t in templates())
    steps = sorted({t.step for t in templates()})
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
t(label, step, need, tokens, marks) AS (VALUES {rows}),
b AS (SELECT r, step, list_distinct(list_slice(ws, i + 1, i + 2 * step)) AS block FROM (SELECT r, ws, step, unnest(range(0, greatest(1, len(ws))::BIGINT, step)) AS i FROM d, (SELECT unnest({steps}) AS step))),
m AS (SELECT r, label, len(list_intersect(block, tokens))::DOUBLE / len(tokens) AS share FROM b JOIN t USING (step)
      WHERE len(list_intersect(block, tokens)) >= need AND len(list_intersect(block, marks)) = len(marks)),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
v AS (SELECT r, i, w, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS (SELECT r, i - 1 AS start, 'mit' AS label FROM v WHERE w = 'license' AND w1 = 'mit'
      UNION ALL SELECT r, i - 1, 'apache' FROM v WHERE w = 'license' AND w1 = 'apache'
      UNION ALL SELECT r, i - 2, 'gpl' FROM v WHERE w = 'license' AND w1 = 'public' AND w2 = 'general'),
pb AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM m) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM m GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(pb.n, 0)::BIGINT AS n_base, pb.lo::BIGINT AS first_word, pb.hi::BIGINT AS last_word,
       coalesce(pb.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN pb.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN pb ON d.r = pb.r LEFT JOIN l ON d.r = l.r LEFT JOIN s ON d.r = s.r
"""
