"""Checks of data sets and results: equality, drift, claims, acceptance rules. Each returns rows, not exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges


def row_text(cols: list[tuple[str, str]]) -> Column:
    """A row of columns (name, type) as text that tells any two different rows apart: each value with its length, nulls as such."""
    text = lambda c, t: F.to_json(F.struct(c)) if t.startswith(("array", "map", "struct")) else F.base64(c) if t == "binary" else F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text(c, t)).cast("string"), F.lit(":"), text(c, t)), F.lit("-")) for c, t in cols])


def digests(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, d1, d2): count and digest of the multiset of rows of each key, 128 bits as two sums, whatever the order of rows.

    One aggregate of three numbers, added up before the shuffle.
    """
    hashed = df.select(*by, F.md5(row_text(df.dtypes)).alias("__h"))
    half = lambda at: F.conv(F.substring("__h", at, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(half(1)).alias("d1"), F.sum(half(17)).alias("d2"))


def unequal(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose rows differ between a and b, as multisets."""
    left, right = digests(a, by), digests(b, by).select(*by, F.col("n").alias("__n"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2"))
    both = left.select(*by, "n", "d1", "d2", *[F.lit(None).cast(t).alias(c) for c, t in (("__n", "long"), ("__d1", "decimal(38,0)"), ("__d2", "decimal(38,0)"))])
    other = right.select(*by, *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("d1", "decimal(38,0)"), ("d2", "decimal(38,0)"))], "__n", "__d1", "__d2")
    # Keys may be null: both sides are stacked and grouped instead of joined.
    met = both.unionByName(other).groupBy(*by).agg(*[F.max(c).alias(c) for c in ("n", "d1", "d2", "__n", "__d1", "__d2")])
    return met.where(~(F.col("n").eqNullSafe(F.col("__n")) & F.col("d1").eqNullSafe(F.col("__d1")) & F.col("d2").eqNullSafe(F.col("__d2")))).select(*by)


def equality(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row: rows only in a and only in b, with multiplicity.

    With `by`, parts of the data by these columns are compared by digest first, and only rows of parts that differ row by row.
    """
    if by:
        keys = unequal(a, b, by)
        a, b = ranges.same(a, keys, by, "left_semi"), ranges.same(b, keys, by, "left_semi")
    left = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    return left.crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def differing_days(stored: DataFrame, computed: DataFrame, by: tuple[str, ...] = ("market", "date")) -> DataFrame:
    """(by, n_stored, n_computed, only_stored, only_computed) of the days whose rows differ; equal ones have no row.

    Digests by key and month are compared first, then digests by day within the months that differ, then rows.
    """
    cols = stored.columns
    computed = computed.select(*cols)
    month = lambda df: df.withColumn("__month", F.trunc(by[-1], "month"))
    coarse = [*by[:-1], "__month"]
    months = unequal(month(stored), month(computed), coarse)
    part = lambda df: ranges.same(month(df), months, coarse, "left_semi").select(*cols)
    a, b = part(stored), part(computed)
    days = unequal(a, b, list(by))
    a, b = ranges.same(a, days, list(by), "left_semi"), ranges.same(b, days, list(by), "left_semi")
    parts = [("n_stored", a), ("n_computed", b), ("only_stored", a.exceptAll(b)), ("only_computed", b.exceptAll(a))]
    counts = [d.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__c", F.lit(c)) for c, d in parts]
    rows = reduce(lambda x, y: x.unionByName(y), counts)
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("__c") == c, F.col("__n"))), F.lit(0)).alias(c) for c, _ in parts])


def unchanged(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(column, changed): rows of a common key whose values differ, nulls being equal."""
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols]), keys)
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("changed")) for c in cols]
    return both.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(column, max_abs_diff, unmatched) over a full outer join."""
    left = a.select(*keys, F.lit(1).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    both = left.join(b.select(*keys, F.lit(1).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in cols]), keys, "full")
    alone = F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull())
    cells = [F.struct(F.lit(c).alias("column"), F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("max_abs_diff"), alone.alias("unmatched")) for c in cols]
    return both.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def claims(claimed: DataFrame, computed: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """claimed (keys, claim) beside computed (keys, value), with verdict ok, differs or missing."""
    joined = claimed.join(computed, keys, "left")
    return joined.withColumn("verdict", F.when(F.col("value").isNull(), "missing").when(F.abs(F.round("value", digits) - F.col("claim")) < 0.5 * 10**-digits, "ok").otherwise("differs"))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, null_share, mean, sd, p50); the median is exact (see ranges.selected)."""
    sums = df.agg(F.count("*").alias("n"), *[x for c in cols for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"z_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    one = sums.crossJoin(ranges.selected(df, [], cols, [0.5]))
    cells = [F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"z_{c}").alias("null_share"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("sd"), F.col(f"{c}_0").alias("p50")) for c in cols]
    return one.select(F.inline(F.array(*cells)))


def acceptance(news: DataFrame, days: DataFrame, start: str, end: str, summary: Column) -> DataFrame:
    """(rule, violations): empty days, rows out of range or blank, repeated (date, headline), close summaries."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    empty = days.join(news.select("market", "date"), ["market", "date"], "left_anti").agg(F.count("*").alias("empty_days"))
    rows = news.agg(
        F.count_if(~F.col("date").between(lo, hi) | F.coalesce(F.trim("headline") == "", F.lit(True))).alias("invalid_rows"), F.count_if(summary).alias("close_summaries")
    )
    dup = news.groupBy("market", "date", "headline").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_headlines"))
    one = empty.crossJoin(rows).crossJoin(dup)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns])))


def return_correlation(a: DataFrame, b: DataFrame, keys: list[str], c: str = "ret") -> DataFrame:
    """Correlation of c of two frames over their common keys."""
    return a.select(*keys, F.col(c).alias("x")).join(b.select(*keys, F.col(c).alias("y")), keys).agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))
