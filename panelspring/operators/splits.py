"""Chronological splits and folds: rows get a role by date or rank; fold tables are small and are joined by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, by_date
from . import ranges


def chrono_split(df: DataFrame, train: float = 0.70, valid: float = 0.15, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """role by position in the series: the first `train`, the next `valid`, then test."""
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(by_date(*keys))
    role = F.when(place <= F.floor(n * train), "train").when(place <= F.floor(n * (train + valid)), "valid").otherwise("test")
    return df.withColumn("role", role)


def cutoff_split(df: DataFrame, valid_from: str, test_from: str) -> DataFrame:
    d = F.col("date")
    return df.withColumn("role", F.when(d < F.to_date(F.lit(valid_from)), "train").when(d < F.to_date(F.lit(test_from)), "valid").otherwise("test"))


def _with_places(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).withColumn("__i", F.row_number().over(by_date(*keys)))


def walk_forward(df: DataFrame, folds: int = 5, start: float = 0.40, step: float = 0.12, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows with fold and role: fold k trains on the first start + k * step of the series and tests on the next step.

    Folds are a constant array that is exploded on the row, with no join.
    """
    fold = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(start + k * step).alias("a"), F.lit(start + (k + 1) * step).alias("b")) for k in range(folds)]))
    rows = _with_places(df, keys).withColumn("__f", fold)
    lo, hi = F.floor(F.col("__n") * F.col("__f.a") + 1e-9), F.floor(F.col("__n") * F.col("__f.b") + 1e-9)
    rows = rows.withColumn("fold", F.col("__f.fold")).withColumn("role", F.when(F.col("__i") <= lo, "train").when(F.col("__i") <= hi, "test"))
    return rows.where("role IS NOT NULL").drop("__n", "__i", "__f")


def date_quantile_folds(df: DataFrame, q: float = 0.35, n: int = 8, market: str | None = None) -> DataFrame:
    """(fold, test_start, test_end): the distinct dates (of one market) above quantile q in n blocks; both markets use them."""
    rows = df if market is None else df.where(F.col("market") == market)
    dates = rows.select("date").distinct()
    ranked = dates.withColumn("r", F.percent_rank().over(Window.orderBy("date"))).where(F.col("r") >= q)
    return ranked.withColumn("fold", F.ntile(n).over(Window.orderBy("date")) - 1).groupBy("fold").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with fold and role: train before the fold's first test date, test within it. folds is a handful of rows."""
    rows = df.crossJoin(F.broadcast(folds))
    role = F.when(F.col("date") < F.col("test_start"), "train").when(F.col("date") <= F.col("test_end"), "test")
    return rows.withColumn("role", role).where("role IS NOT NULL").drop("test_start", "test_end")


def embargo(df: DataFrame, n: int = 10, keys: tuple[str, ...] = (*KEYS, "fold")) -> DataFrame:
    """Training rows without the last n of each series and fold."""
    back = Window.partitionBy(*keys, "role").orderBy(F.col("date").desc())
    return df.withColumn("__b", F.row_number().over(back)).where((F.col("role") != "train") | (F.col("__b") > n)).drop("__b")


def inner_folds(df: DataFrame, blocks: int = 3, keys: tuple[str, ...] = (*KEYS, "fold")) -> DataFrame:
    """Inside each outer training window: its last half in `blocks` expanding folds (inner_fold, inner_role)."""
    return _expanding(df.where("role = 'train'"), 0.5, blocks, keys, "inner_fold", "inner_role")


def _expanding(df: DataFrame, start: float, blocks: int, keys: tuple[str, ...], fold: str, role: str) -> DataFrame:
    step = (1 - start) / blocks
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(start + k * step).alias("a"), F.lit(start + (k + 1) * step).alias("b")) for k in range(blocks)]))
    rows = _with_places(df, keys).withColumn("__f", parts)
    lo, hi = F.floor(F.col("__n") * F.col("__f.a") + 1e-9), F.floor(F.col("__n") * F.col("__f.b") + 1e-9)
    out = rows.withColumn(fold, F.col("__f.k")).withColumn(role, F.when(F.col("__i") <= lo, "train").when(F.col("__i") <= hi, "test"))
    return out.where(F.col(role).isNotNull()).drop("__n", "__i", "__f")


def pretest_blocks(df: DataFrame, cutoff: str, blocks: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Walk-forward on the last half of the rows before cutoff."""
    return _expanding(df.where(F.col("date") < F.to_date(F.lit(cutoff))), 0.5, blocks, keys, "fold", "role")


def expanding_oof(df: DataFrame, slices: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows with fold and role for out-of-fold predictions: slice k is predicted from the slices before it; the first never is."""
    tiles = df.withColumn("__s", F.ntile(slices).over(by_date(*keys)) - 1)
    rows = tiles.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("__s"), F.lit(1)), F.lit(slices - 1))))
    return rows.withColumn("role", F.when(F.col("__s") == F.col("fold"), "test").otherwise("train")).drop("__s")


def unshuffled_kfold(df: DataFrame, k: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """fold: contiguous slices. Training on the others breaks time order; kept to show that flaw."""
    return df.withColumn("fold", F.ntile(k).over(by_date(*keys)) - 1)


def scaled(df: DataFrame, cols: list[str], keys: tuple[str, ...] = ("fold",), train: Column | None = None) -> DataFrame:
    """cols less mean over population deviation of the training rows of each key; a constant column becomes 0."""
    train = F.col("role") == "train" if train is None else train
    stats = df.where(train).groupBy(*keys).agg(*[x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    joined = df.join(stats, list(keys), "left")
    z = {c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in cols}
    return joined.withColumns(z).drop(*[f"__{p}_{c}" for c in cols for p in "ms"])


def rank_scaled(df: DataFrame, col: str, keys: tuple[str, ...] = KEYS, most: int = ranges.MOST) -> DataFrame:
    """col_rank: share of training values of the key at or below the row's value (0 to 1). Large keys are ranked by ranges of the value."""
    by = list(keys)
    known = F.when((F.col("role") == "train") & F.col(col).isNotNull(), F.lit(1))
    rows, hot = ranges.cut(df, by, col, most)
    below = F.count(known).over(ranges.within(by, hot).orderBy(col).rangeBetween(Window.unboundedPreceding, 0))
    if hot:
        rows = ranges.carry(rows, by, {"__k": F.count(known)}, {"__before": lambda w: F.sum("__k").over(w)})
        below = below + F.coalesce("__before", F.lit(0))
    rows = ranges.same(rows, df.groupBy(*by).agg(F.count(known).alias("__all")), by)
    share = below / F.nullif(F.col("__all").cast("double"), F.lit(0.0))
    return rows.select(*df.columns, F.when(F.col(col).isNotNull(), share).alias(f"{col}_rank"))
