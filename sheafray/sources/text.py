"""JSON lines, logs with literals, and objects over HTTP."""

from __future__ import annotations

import ast
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with ragged keys; names may hold dots (quote them)."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in a column ``value``."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def last_object(lines: DataFrame, *by: str) -> DataFrame:
    """The last line that starts with a brace, by ``line_no``."""
    return lines.where(F.col("value").startswith("{")).groupBy(*by).agg(F.max_by("value", "line_no").alias("value"))


def literals(text: str) -> list:
    """The balanced {...} literals of a line, as Python values; quotes may
    hold braces."""
    out, depth, start, quote, k = [], 0, 0, "", 0
    while k < len(text):
        ch = text[k]
        if quote:
            if ch == "\\":
                k += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'" and depth:
            quote = ch
        elif ch == "{":
            if not depth:
                start = k
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    out.append(ast.literal_eval(text[start : k + 1]))
                except (ValueError, SyntaxError):
                    pass
        k += 1
    return out


def read_log(spark: SparkSession, path: str, pattern: str, names: tuple[str, ...]) -> DataFrame:
    """Lines of a log that match ``pattern``: its groups as ``names`` and the
    line's literals as JSON strings."""
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    keyed = rows.select(*[F.regexp_extract("value", pattern, k).alias(n) for k, n in enumerate(names, 1)], "value")

    def parse(batches):
        for part in batches:
            yield part.assign(objects=[[json.dumps(x) for x in literals(v)] for v in part["value"]]).drop(columns=["value"])

    return keyed.mapInPandas(parse, ", ".join(f"{n} string" for n in names) + ", objects array<string>")


def http_get(url: str, timeout: float = 60.0, attempts: int = 4, pause: float = 1.0) -> bytes | None:
    """An object's bytes; None if it is missing or forbidden; the last error
    after so many attempts."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code in (403, 404):
                return None
            error: Exception = e
        except OSError as e:
            error = e
        if k + 1 < attempts:
            time.sleep(pause * 2**k)
    raise error


def fetch(urls: DataFrame, timeout: float = 60.0) -> DataFrame:
    """(url, content) of a table of urls, fetched on the executors; missing
    objects are absent rows."""

    def run(batches):
        for rows in batches:
            got = rows.assign(content=[http_get(u, timeout) for u in rows["url"]])
            yield got[got["content"].notna()]

    return urls.select("url").mapInPandas(run, "url string, content binary")


def list_objects(bucket_url: str, prefix: str, delimiter: str = "") -> tuple[list[str], list[str]]:
    """Keys and common prefixes of a bucket listing, page after page."""
    keys, prefixes, token = [], [], None
    while True:
        query = {"list-type": "2", "prefix": prefix} | ({"delimiter": delimiter} if delimiter else {}) | ({"continuation-token": token} if token else {})
        page = ET.fromstring(http_get(f"{bucket_url}?{urllib.parse.urlencode(query)}") or b"<x/>")
        plain = lambda e: e.tag.rpartition("}")[2]
        for e in page:
            inner = {plain(c): c.text for c in e}
            if plain(e) == "Contents":
                keys.append(inner["Key"])
            elif plain(e) == "CommonPrefixes":
                prefixes.append(inner["Prefix"])
        token = next((e.text for e in page if plain(e) == "NextContinuationToken"), None)
        if not token:
            return keys, prefixes
