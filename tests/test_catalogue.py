"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from sheafray.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalogue.ORACLE_SQL:
        assert name in ("snap_full", "profile_peaks_prominence")
        return
    r = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(x[k]) for k in at) for x in r.fetchall())
