"""Trading calendars: as-of joins, roll forward, fills, lags. Nothing here looks ahead unless its text says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, by_date
from . import ranges


def trading_day_filter(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(calendar.select("market", "date").distinct(), ["market", "date"], "left_semi")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", most: int = ranges.MOST) -> DataFrame:
    """left with the right row's `on` (as right_on) and values: the last at or before (backward) or first at or after (forward).

    Only the distinct times of both sides are put in order: rows of left that share a time share their match, and take it by
    an equi-join. A key with more than `most` times is cut into ranges of time, and the last (first) right row of each is
    carried into those after (before) it. Several right rows at one time: the greatest values row counts. Left rows with a
    null time have no match; null keys are equal.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    match = F.struct(F.col(on).alias("right_on"), F.col("__v").alias("v"))
    marks = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*values)).alias("__v")).select(*by, on, F.lit(0).alias("__side"), match.alias("__r"))
    times = left.where(F.col(on).isNotNull()).select(*by, on).distinct().withColumn("__side", F.lit(1))
    rows, hot = ranges.cut(times.unionByName(marks, allowMissingColumns=True), by, on, most)
    w = ranges.within(by, hot).orderBy(on if back else F.col(on).desc(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    if hot:
        at = F.when(F.col("__r").isNotNull(), F.col(on))
        totals = {"__end": F.max_by("__r", at) if back else F.min_by("__r", at)}
        rows = ranges.carry(rows, by, totals, {"__c": lambda v: F.last("__end", ignorenulls=True).over(v)}, back=not back).withColumn("__m", F.coalesce("__m", "__c"))
    found = rows.where("__side = 1").select(*by, on, "__m")
    joined = ranges.same(left, found, [*by, on])
    return joined.select(*left.columns, F.col("__m.right_on").alias("right_on"), *[F.col(f"__m.v.{v}").alias(v) for v in values])


def roll_to_next_trading_day(news: DataFrame, calendar: DataFrame) -> DataFrame:
    """news with trade_date, the first trading day at or after its date; null after the last one."""
    days = calendar.select("market", "date").distinct().withColumn("trade_date", F.col("date"))
    return asof_join(news, days, "date", ["market"], ["trade_date"], "forward").drop("right_on")


def rolled_volume(news: DataFrame, calendar: DataFrame) -> DataFrame:
    """Items by trading day, and how many of them came from other days."""
    rolled = roll_to_next_trading_day(news, calendar)
    return rolled.groupBy("market", "trade_date").agg(F.count("*").alias("n"), F.count_if(F.col("date") != F.col("trade_date")).alias("n_rolled"))


def join_news(panel: DataFrame, daily: DataFrame, fill: list[str]) -> DataFrame:
    """Panel rows with the day's news columns, zeros where there is none, and news_available."""
    news = daily.select("market", "date", *fill).withColumn("news_available", F.lit(1))
    joined = panel.join(news, ["market", "date"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in [*fill, "news_available"]})


def forward_fill(df: DataFrame, cols: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Last known value; nulls before the first one stay."""
    w = by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def legacy_calendar_fill(news: DataFrame, days: DataFrame, cols: list[str]) -> DataFrame:
    """The older rule: values carried over all calendar days of `days` (market, date), zeros before the first."""
    joined = days.join(news.select("market", "date", *cols), ["market", "date"], "left")
    return forward_fill(joined, cols, ("market",)).withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})


def news_lag(df: DataFrame, cols: list[str], n: int = 0) -> DataFrame:
    """cols of n trading days before; 0 leaves news on its own row."""
    return df.withColumns({c: F.lag(c, n).over(by_date()) for c in cols}) if n else df


def align_sessions(left: DataFrame, right: DataFrame, left_zone: str, right_zone: str, left_close: str, right_close: str, values: list[str], by: list[str]) -> DataFrame:
    """left days with the latest right day whose local close is at or before left's local close.

    Dates become UTC instants of the close; the rest is a backward as-of join.
    """

    def at(zone: str, close: str) -> Column:
        return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.lit(close))), zone)

    a = left.withColumn("__t", at(left_zone, left_close))
    b = right.withColumn("__t", at(right_zone, right_close)).withColumnRenamed("date", "right_date")
    return asof_join(a, b, "__t", by, ["right_date", *values], "backward").drop("__t", "right_on")


def winsorize(df: DataFrame, cols: list[str], train: Column, lo: float = 0.01, hi: float = 0.99, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """cols held between percentiles of the training rows of each key, which are exact (see ranges.selected)."""
    bounds = ranges.selected(df.where(train), list(keys), cols, [lo, hi])
    bounds = bounds.select(*keys, *[F.array(f"{c}_0", f"{c}_1").alias(f"__{c}") for c in cols])
    joined = df.join(bounds, list(keys), "left")
    return joined.withColumns({c: F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1]) for c in cols}).drop(*[f"__{c}" for c in cols])


def interpolate(df: DataFrame, cols: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Linear in rows between known neighbours. It looks ahead: not for features. Open ends stay null."""
    w = by_date(*keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__n", F.row_number().over(w))
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct("__n", F.col(c).alias("v")))
        a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        df = df.withColumn("__a", a).withColumn("__b", b)
        line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__n") - F.col("__a.__n")) / (F.col("__b.__n") - F.col("__a.__n"))
        df = df.withColumn(c, F.coalesce(F.col(c), line)).drop("__a", "__b")
    return df.drop("__n")


def pivot_indicators(long: DataFrame, codes: list[str]) -> DataFrame:
    """One column for each code; the list is given, so no pass is spent on finding it."""
    return long.groupBy("market", "date").pivot("code", codes).agg(F.first("value"))


def swap_columns(base: DataFrame, other: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """base with cols taken from other; all else untouched, and column order kept."""
    return base.drop(*cols).join(other.select(*keys, *cols), keys, "left").select(*base.columns)


def availability_window(df: DataFrame, cols: list[str], folds: DataFrame) -> DataFrame:
    """(fold, column, last_date, usable): a column that ends before a fold's test begins cannot be used in it."""
    ends = df.agg(*[F.max(F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in cols])
    long = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("last_date")) for c in cols])))
    return long.crossJoin(F.broadcast(folds.select("fold", "test_start", "test_end"))).select("fold", "column", "last_date", F.coalesce(F.col("last_date") >= F.col("test_end"), F.lit(False)).alias("usable"))


def stack_markets(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
