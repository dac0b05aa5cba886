"""Quality rules (operator 10): a learned decision list over text statistics.

Statistics are native expressions over each whole text. Sequential covering
grows conjunctions of thresholds on a bounded sample of labelled rows, prunes
each on rows held out from growing, and emits the list as one ordered Spark
conditional expression. Scoring therefore is a projection: no shuffle, no
Python on the executors.

Defined cases: a null text counts as empty; an empty text has no words, fails
the base rule and is not kept; a document without labels is only scored; a
labels table without usable rows gives an empty list, which keeps whatever
the base rule keeps; repeated rows are scored each; further columns of the
input are never read and never clash, as the result has its own names only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, documents, let, words_of

#: Words of a window whose repetition within a text is counted.
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: At most so many labelled rows are used to learn the list.
MAX_LABELLED = 20_000
#: The statistics that rules may test, in their fixed order.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share")


def repeated_words(words: Column) -> Column:
    """Words lying in windows of ``REPEAT_WINDOW`` words that occur at least
    twice among the given words, first occurrence included.

    Windows are compared by a 64-bit hash of their word sequence. Texts whose
    window hashes are all distinct, nearly all, stop after one hash set; the
    others sort (hash, place) pairs, so the cost stays n log n.
    """
    w = REPEAT_WINDOW

    def hashes(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - w), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(w)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda s: F.sort_array(
                F.array_distinct(
                    F.flatten(
                        F.zip_with(
                            F.slice(s, F.lit(1), F.size(s) - 1),
                            F.slice(s, F.lit(2), F.size(s) - 1),
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
                        )
                    )
                )
            ),
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(w))),
                F.lit(w).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= w, none).otherwise(let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def _chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the base counts and the shares rules may test."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    counted = docs.select(
        *[F.col(c) for c in (id_column, *keep)],
        let(
            words_of(text),
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                repeated_words(ws).alias("n_repeat_words"),
                F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            ),
        ).alias("w"),
        F.length(F.translate(text, WS_CHARS, "")).cast("long").alias("word_chars"),
        _chars(text, "#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        _chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _chars(text, "0123456789").alias("n_digits"),
        _chars(text, "!?|=_~^{}[]\\").alias("n_marks"),
    )
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    n, chars = F.col("w.n_words"), F.col("word_chars")
    return counted.select(
        *[F.col(c) for c in (id_column, *keep)],
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        share(chars, n).alias("mean_word"),
        share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        share(F.col("w.n_repeat_words"), n).alias("repeat_share"),
        share(F.col("n_upper"), chars).alias("upper_share"),
        share(F.col("n_digits"), chars).alias("digit_share"),
        share(F.col("n_marks"), chars).alias("mark_share"),
        share(F.col("w.n_distinct"), n).alias("distinct_share"),
    )


def base_failed(stats_n_words: Column, n_repeat_words: Column) -> Column:
    return (stats_n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * stats_n_words)


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold`` or ``feature > threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents it covers are rejected."""

    conditions: tuple[Condition, ...]
    covered_bad: int
    covered_good: int

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _cuts(values: list[float], most: int) -> list[float]:
    """Mid-points between neighbouring distinct values, thinned to quantiles."""
    distinct = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
    if len(mids) <= most:
        return mids
    return [mids[k * (len(mids) - 1) // (most - 1)] for k in range(most)]


def _precision(bad: int, good: int) -> float:
    """Precision shrunk towards one half, so that tiny rules do not win."""
    return (bad + 1) / (bad + good + 2)


def learn_decision_list(rows: list[dict], max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95, min_covered: int = 5, cuts: int = 32) -> list[Rule]:
    """Sequential covering over labelled statistics; ``rows`` hold the
    features and ``bad`` (bool).

    Every third row, in the given order, is held out of growing. A rule grows
    by the condition with the best gain in shrunk precision times coverage,
    then loses trailing and inner conditions as long as the held-out precision
    does not fall. It is accepted when its shrunk precision over all rows left
    reaches ``min_precision``; rows it covers leave before the next rule.
    """
    left, rules = list(enumerate(rows)), []
    while len(rules) < max_rules:
        grow = [r for k, r in left if k % 3]
        hold = [r for k, r in left if k % 3 == 0]
        if sum(r["bad"] for r in grow) < min_covered:
            break
        chosen: list[Condition] = []
        inside = grow
        best = _precision(sum(r["bad"] for r in inside), sum(not r["bad"] for r in inside))
        while len(chosen) < max_conditions and any(not r["bad"] for r in inside):
            found = None
            all_bad = sum(r["bad"] for r in inside)
            for name in FEATURES:
                pairs = sorted((r[name], r["bad"]) for r in inside)
                sums, bad = [], 0
                for value, is_bad in pairs:
                    bad += is_bad
                    sums.append((value, bad))
                at = 0
                for cut in _cuts([p[0] for p in pairs], cuts):
                    while at < len(sums) and sums[at][0] <= cut:
                        at += 1
                    below_bad = sums[at - 1][1] if at else 0
                    for above, n_bad, n in ((False, below_bad, at), (True, all_bad - below_bad, len(pairs) - at)):
                        if n_bad < min_covered:
                            continue
                        p = _precision(n_bad, n - n_bad)
                        score = (p - best) * n_bad**0.5
                        if p > best and (found is None or score > found[0]):
                            found = (score, Condition(name, above, cut), p)
            if found is None:
                break
            chosen.append(found[1])
            best = found[2]
            inside = [r for r in inside if found[1].holds(r)]
        if not chosen:
            break

        def held(conditions: list[Condition], rows: list[dict] = hold) -> float:
            covered = [r["bad"] for r in rows if all(c.holds(r) for c in conditions)]
            return _precision(sum(covered), len(covered) - sum(covered))

        while len(chosen) > 1:
            shorter = max((chosen[:k] + chosen[k + 1 :] for k in reversed(range(len(chosen)))), key=held)
            if held(shorter) < held(chosen):
                break
            chosen = shorter
        covered = [r["bad"] for _, r in left if all(c.holds(r) for c in chosen)]
        rule = Rule(tuple(chosen), sum(covered), len(covered) - sum(covered))
        if rule.covered_bad < min_covered or _precision(rule.covered_bad, rule.covered_good) < min_precision:
            break
        rules.append(rule)
        left = [(k, r) for k, r in left if not rule.holds(r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learn the list from ``labels`` (doc_id, quality 0/1).

    At most ``max_labelled`` labelled documents are used, those with the
    smallest hash of their id, so reruns and any partitioning agree; that bound
    is what allows their ids to be broadcast and their statistics, nothing
    else, to reach the driver. Ids with contradicting labels and
    null labels are left out.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
        .where("q = q2")
        .select("doc_id", (F.col("q") == 0).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = [r.asDict() for r in text_statistics(sample, keep=("bad",)).select("doc_id", "bad", "n_repeat_words", *FEATURES).collect()]
    # Filtered here: Spark would push the base rule below the join and so compute the statistics of every document.
    rows = [r for r in rows if r["n_words"] >= MIN_WORDS and 100 * r["n_repeat_words"] <= MAX_REPEAT_PERCENT * r["n_words"]]
    return learn_decision_list(sorted(rows, key=lambda r: (r["doc_id"], *(r[f] for f in FEATURES), r["bad"])), **options)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that
    covers the document, else true."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of each document."""
    stats = text_statistics(docs, keep=keep)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: base counts, the base rule and the learned verdict."""
    docs = documents(spark, sf_dir)
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = docs.columns
    scored = apply_rules(docs.select("doc_id", "text", F.struct(*columns).alias("_row")), rules, keep=("_row",))
    return scored.where("kept").select("_row.*")
