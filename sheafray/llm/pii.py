"""Personal data (operator 13): bootstrapped contextual extraction.

Four shapes (email, ip, card, phone) give seed entities. The words around an
entity make lexical patterns: two words before it, one before it, one on each
side, two after it. Other places that look like an identifier, by digits or by
an address sign plain or spelled out, are candidates in the same patterns. Patterns and instances (an
entity's letters and digits) form a graph whose edges Spark scores in rounds:
a pattern's confidence in a kind is the score its instances have in that kind
by one more than the number of all its instances, and it must have
``SUPPORT`` scored ones; a candidate's score is the noisy-or of the patterns
with at least ``CONFIDENCE``. So patterns found by seeds discover instances,
and those further patterns. A candidate in a pattern of the last round becomes
a span of its kind; base spans always stay.

Texts are read once, by a scan whose time is linear in a text's length whatever
it holds, and never move: what is written and shuffled is entities with their
patterns. Edges are counted distinct before they move, a pattern or instance
that is hot meets a written side with one row a kind, and patterns with fewer
than ``SUPPORT`` instances, which can never count, are left out first.

Defined cases: a null text is empty and has no spans; rows are documents each,
also where they repeat or share an id; context words are the whole ASCII-space
separated words within ``REACH`` code points; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, documents, materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Scored instances that a pattern must have, and the confidence it must reach.
SUPPORT = 5
CONFIDENCE = 0.8
#: Code points on each side of an entity where its context lies.
REACH = 64
#: A candidate's length, and digits it has unless it has an address sign.
SHORTEST, LONGEST, DIGITS = 6, 64, 6

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@][^ \t\n\x0b\x0c\r]*+")
_SPELLED = re.compile(r" ?[\[({<] ?at ?[\])}>] ?", re.IGNORECASE)
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?)[A-Za-z0-9-]++)+", re.IGNORECASE)
_EDGE = ".,;:!?\"'|*#$%&<>[]{}=`~"


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order; linear in the text."""
    out = []
    since = 0
    at = text.find("@")
    while at >= 0:
        before = text[since:at]
        start = since + len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, 0, host.end()))
        # No match that starts later can hold this sign.
        since = host.end() if host else at + 1
        at = text.find("@", since)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation around it, nor a parenthesis that has no other."""
    while True:
        piece = text[start:end]
        lo, hi = start + len(piece) - len(piece.lstrip(_EDGE)), start + len(piece.rstrip(_EDGE))
        if lo >= hi:
            return start, start
        if text[lo] in "()" and not (text[lo] == "(" and ")" in text[lo:hi]):
            lo += 1
        elif text[hi - 1] in "()" and not (text[hi - 1] == ")" and "(" in text[lo:hi]):
            hi -= 1
        elif (lo, hi) == (start, end):
            return lo, hi
        start, end = lo, hi


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of places that look like identifiers and meet none of
    ``taken``: words with digits, neighbours together, or an address."""
    words, since = [], 0
    for m in _SIGN.finditer(text):
        start = m.start()
        while start > since and text[start - 1] not in WS_CHARS:
            start -= 1
        since = m.end()
        words.append((start, since))
    if "at" in text or "AT" in text or "At" in text:
        since = 0
        for m in _SPELLED.finditer(text):
            before = text[max(since, m.start() - LONGEST) : m.start()]
            start = m.start() - len(before) + len(before.rstrip(_LOCAL))
            host = _SPELLED_HOST.match(text, m.end()) if start < m.start() else None
            if host:
                words.append((start, host.end()))
                since = host.end()
        words.sort()
    free, k, held = [], 0, sorted((s, e) for s, _, e in taken)
    for start, end in words:
        while k < len(held) and held[k][1] <= start:
            k += 1
        # Spans of several kinds may overlap, so the next ones are looked at too.
        j, clear = k, True
        while j < len(held) and held[j][0] < end:
            if held[j][1] > start:
                clear = False
                break
            j += 1
        if not clear:
            continue
        if free and start < free[-1][1]:
            free[-1] = (free[-1][0], max(end, free[-1][1]))
        elif free and start == free[-1][1] + 1 and text[free[-1][1]] == " ":
            free[-1] = (free[-1][0], end)
        else:
            free.append((start, end))
    out = []
    for start, end in free:
        if end - start > 4 * LONGEST:
            continue
        start, end = _trimmed(text, start, end)
        piece = text[start:end]
        if SHORTEST <= len(piece) <= LONGEST and (sum("0" <= c <= "9" for c in piece) >= DIGITS or "@" in piece or _SPELLED.search(piece)):
            out.append((start, end))
    return out


def instance_of(piece: str) -> str:
    """An entity's letters, digits and address sign; long ones by a hash."""
    name = "".join(c for c in piece.lower() if c.isalnum() or c == "@")
    return name if len(name) <= LONGEST else blake2b(name.encode(), digest_size=16).hexdigest()


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a place lies in."""
    clean = lambda w: w.lower().strip(_EDGE + "()") or w
    near = text[max(0, start - REACH) : start]
    left = near.split()[-3:]
    # The first word may be cut off where the context begins.
    if start > REACH and len(left) == len(near.split()) and not near[0].isspace():
        left = left[1:]
    near = text[end : end + REACH]
    right = near.split()[:3]
    if end + REACH < len(text) and len(right) == len(near.split()) and not near[-1].isspace():
        right = right[:-1]
    left, right = [clean(w) for w in left[-2:]], [clean(w) for w in right[:2]]
    out = []
    if left:
        out.append(f"{left[-1]} _")
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        out.append(f"_ {right[0]} {right[1]}")
    return out


_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = "struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>"


def _scan(batches: Iterator) -> Iterator:
    """The base spans of each text, and all entities with their patterns."""
    import pyarrow as pa

    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    entity = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        base, found = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            places = [(s, e, k) for s, k, e in spans] + [(s, e, -1) for s, e in candidates(text, spans)]
            found.append([{"start": s, "end": e, "kind": k, "instance": instance_of(text[s:e]), "patterns": patterns_of(text, s, e)} for s, e, k in places])
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(entity))], names=["_row", "doc_id", "base", "found"])


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: _row, doc_id, base (spans), found (entities). Written."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = f"_row long, doc_id {dict(docs.dtypes)['doc_id']}, base array<{_SPAN}>, found array<{_FOUND}>"
    return materialize(rows.mapInArrow(_scan, schema), "entities")


def scored_patterns(entities: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that count after ``rounds``.

    ``entities`` has instance, kind (-1: a candidate) and patterns.
    """
    edges = entities.select("instance", F.explode("patterns").alias("pattern")).distinct()
    edges = materialize(edges, "pattern-edges")
    sizes = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support), "pattern-sizes")
    edges = materialize(edges.join(sizes, "pattern"), "pattern-graph")
    # An instance seen in several shapes is of each kind by its share.
    kinds = entities.where("kind >= 0").groupBy("instance", "kind").agg(F.count(F.lit(1)).alias("n"))
    whole = kinds.groupBy("instance").agg(F.sum("n").alias("of"))
    seeds = materialize(kinds.join(whole, "instance").select("instance", "kind", (F.col("n") / F.col("of")).alias("score")), "seed-scores")
    unseen = materialize(edges.join(seeds.select("instance").distinct(), "instance", "left_anti"), "unseen-edges")
    scores = seeds
    for n in range(rounds):
        met = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("scored"), F.first("n").alias("n"))
        sure = F.col("mass") / (F.col("n") + 1)
        patterns = materialize(met.where((F.col("scored") >= support) & (sure >= confidence)).select("pattern", "kind", sure.alias("confidence")), "patterns")
        if n + 1 < rounds:
            told = unseen.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
            best = told.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct(F.col("score"), -F.col("kind"))).alias("b"))
            scores = materialize(seeds.unionByName(best.select("instance", "b.kind", "b.score")), "instance-scores")
    return patterns


def _named(kind: Column) -> Column:
    """A kind's name by its number."""
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def _told(spans: Column) -> Column:
    """kind:start:end, by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", _named(s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base and added (arrays of start, kind, end; kind by its number
    in ``KINDS``) of every row of ``docs`` (doc_id, text)."""
    rows = scanned(docs)
    entities = rows.select("_row", F.explode("found").alias("e")).select("_row", "e.*")
    patterns = scored_patterns(entities, rounds, support, confidence)
    asked = entities.where("kind < 0").select("_row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = asked.join(patterns, "pattern").groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct(F.col("confidence"), -F.col("kind"))).alias("kind"))
    added = hits.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.select("_row", "doc_id", "base").join(added, "_row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: personal data in all documents."""
    found = personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.concat("base", "added")).alias("spans"))
