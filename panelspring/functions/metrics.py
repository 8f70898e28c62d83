"""Forecast metrics as aggregates over a prediction table (y, yhat or p). Every function takes the grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges
from .frames import rounded


def r2_of(y: Column, yhat: Column) -> Column:
    """1 - SSE / SST against the mean of the same rows; null if y does not vary."""
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return 1 - F.sum((y - yhat) * (y - yhat)) / F.nullif(sst, F.lit(0.0))


def r2(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """r2 on the given (log) scale and r2_raw after exp."""
    rows = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return rows.groupBy(*by).agg(r2_of(F.col(y), F.col(yhat)).alias("r2"), r2_of(F.exp(y), F.exp(yhat)).alias("r2_raw"), F.count("*").alias("n"))


def rmse_corr(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    rows = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = F.col(y) - F.col(yhat)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(y, yhat).alias("corr"))


def auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p", most: int = ranges.MOST) -> DataFrame:
    """Exact AUC with ties at one half, from counts by distinct score; null if a class is missing.

    Scores are aggregated first, so a score that many rows share is one row of the window; a key with more than `most`
    scores is counted by ranges of the score.
    """
    by_score = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("__1"), F.count("*").alias("__n"))
    zeros = F.col("__n") - F.col("__1")
    ranked = ranges.running(by_score, by, [p], {"__below": zeros}, most, own=False)
    wins = F.sum((F.col("__1") * (2 * F.col("__below") + zeros)).cast("decimal(38,0)")).cast("double") / 2
    return ranked.groupBy(*by).agg((wins / F.nullif(F.sum("__1").cast("double") * F.sum(zeros).cast("double"), F.lit(0.0))).alias("auc"))


def classification(df: DataFrame, by: list[str], y: str = "y", p: str = "p", eps: float = 1e-12) -> DataFrame:
    """accuracy and F1 at 0.5, Brier score, log loss."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    said, true = F.col(p) >= 0.5, F.col(y) == 1
    tp, fp, fn = F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return rows.groupBy(*by).agg(
        F.avg((said == true).cast("double")).alias("accuracy"), (2 * tp / F.nullif((2 * tp + fp + fn).cast("double"), F.lit(0.0))).alias("f1"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(-F.when(true, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
    )


def mse_improvement(df: DataFrame, by: list[str], base: str, model: str = "model", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """1 - MSE / MSE of the base model, for each other model."""
    mse = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by, model).agg(F.avg((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))).alias("mse"))
    zero = mse.where(F.col(model) == base).select(*by, F.col("mse").alias("mse_base"))
    return mse.where(F.col(model) != base).join(zero, by).select(*by, model, (1 - F.col("mse") / F.col("mse_base")).alias("improvement"))


def difference(metrics: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """value of a less that of b, and their ratio."""
    wide = metrics.groupBy(*by).agg(F.max(F.when(F.col(group) == a, F.col(value))).alias("a"), F.max(F.when(F.col(group) == b, F.col(value))).alias("b"))
    return wide.select(*by, (F.col("a") - F.col("b")).alias("delta"), (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))


def calibration_bins(df: DataFrame, by: list[str], order: list[str], bins: int = 10, y: str = "y", p: str = "p", most: int = ranges.MOST) -> DataFrame:
    """Equal-count bins of p: mean forecast, mean outcome, rows. Equal forecasts go by `order`. Large keys are numbered by ranges of p."""
    rows = ranges.numbered(df.where(F.col(y).isNotNull() & F.col(p).isNotNull()), by, [p, *order], "__at", most)
    rows = ranges.same(rows, rows.groupBy(*by).agg(F.count("*").alias("__n")), by)
    # As ntile(): the first n % bins bins have one row more.
    size, more, at = F.floor(F.col("__n") / bins), F.col("__n") % bins, F.col("__at")
    longer = more * (size + 1)
    rows = rows.withColumn("bin", (F.when(at < longer, F.floor(at / (size + 1))).otherwise(more + F.floor((at - longer) / F.nullif(size, F.lit(0)))) + 1).cast("int"))
    return rows.groupBy(*by, "bin").agg(F.avg(p).alias("forecast"), F.avg(F.col(y).cast("double")).alias("outcome"), F.count("*").alias("n"))


def cumulative_hits(df: DataFrame, by: list[str], order: list[str], y: str = "y", p: str = "p", most: int = ranges.MOST) -> DataFrame:
    """Running hit rate in the order of `order`; large keys by ranges of order[0]."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    hit = ((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("long")
    sums = ranges.running(rows, by, order, {"__hits": hit, "__rows": F.lit(1)}, most)
    return sums.withColumn("hit_rate", F.col("__hits") / F.col("__rows")).drop("__hits", "__rows")


def fold_summary(folds: DataFrame, by: list[str], value: str) -> DataFrame:
    return folds.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("folds"))


def score_vs_volatility(folds: DataFrame, by: list[str], value: str, stats: list[str]) -> DataFrame:
    """Correlation over folds of a score with each statistic of the fold."""
    return folds.groupBy(*by).agg(*[F.corr(value, s).alias(f"corr_{s}") for s in stats])


def league_table(metrics: DataFrame, by: list[str], model: str, value: str) -> DataFrame:
    """Models ranked by value, equal values sharing a rank."""
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc())))


def inner_outer(inner: DataFrame, outer: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same score inside and outside of selection, and its drop."""
    return inner.select(*by, F.col(value).alias("inner")).join(outer.select(*by, F.col(value).alias("outer")), by).withColumn("drop", F.col("inner") - F.col("outer"))


def error_correlation(df: DataFrame, keys: list[str], models: list[str], model: str = "model", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Correlation of the errors of each pair of models over the rows that both predict."""
    e = F.col(y) - F.col(yhat)
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(model) == m, e)).alias(f"e_{m}") for m in models])
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"e_{a}", f"e_{b}").alias("corr")) for a, b in pairs]
    return wide.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded to `digits`, other columns as they are."""
    return df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
