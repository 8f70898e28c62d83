"""Registered text queries against their SQL on whole small tables."""

import math

import duckdb
import pytest

from panelspring.llm import oracles, queries

TABLES = "documents pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name, sf):
    if sf.endswith("0.01") and name in ("op6_mixing", "op7_decontamination", "op10_minhash"):
        pytest.skip("compared with loops on this table")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*cols).collect())
    r = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(cell(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_checksum_of_the_sql(spark):
    """CRC-32 as the SQL spells it out, against Spark's."""
    words = ["0", "17", "-1", "12:straße", "99:ÿÀé", ""]
    con = duckdb.connect()
    got = dict(con.execute(f"WITH {oracles._crc_table()} SELECT s, {oracles._crc('s')} FROM (SELECT unnest(?) AS s) CROSS JOIN crct WHERE s <> ''", [words]).fetchall())
    want = {r["s"]: r["c"] for r in spark.createDataFrame([(w,) for w in words if w], "s string").selectExpr("s", "crc32(cast(s as binary)) AS c").collect()}
    assert got == want
