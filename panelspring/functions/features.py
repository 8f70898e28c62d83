"""Price and indicator features: all are window expressions that look back only, on one partitioning by (market, symbol)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import KEYS, by_date, full, mean, trailing


def returns(df: DataFrame, price: str = "close") -> DataFrame:
    """ret, the log return, and absret. The first row of a series has nulls."""
    r = F.log(F.col(price) / F.lag(price).over(by_date()))
    return df.withColumn("ret", r).withColumn("absret", F.abs(F.col("ret")))


def lags(df: DataFrame, c: str, n: int) -> DataFrame:
    """c_lag1 ... c_lagn."""
    return df.withColumns({f"{c}_lag{i}": F.lag(c, i).over(by_date()) for i in range(1, n + 1)})


def rolling_std(df: DataFrame, ks: tuple[int, ...] = (5, 20, 22)) -> DataFrame:
    """rolling_std_k of ret, null until k returns are there."""
    return df.withColumns({f"rolling_std_{k}": full(F.stddev_samp("ret"), "ret", k, trailing(k)) for k in ks})


def har_components(df: DataFrame, ks: tuple[int, ...] = (1, 5, 20, 22)) -> DataFrame:
    """har_k: mean absret of the last k rows."""
    return df.withColumns({f"har_{k}": mean("absret", k) for k in ks})


def leverage(df: DataFrame, ks: tuple[int, ...] = (5, 20)) -> DataFrame:
    """leverage_kd: mean of min(ret, 0), so days without a loss count as zero."""
    return df.withColumns({f"leverage_{k}d": full(F.avg(F.least("ret", F.lit(0.0))), "ret", k, trailing(k)) for k in ks})


def rsi(df: DataFrame, k: int = 14) -> DataFrame:
    """rsi_k from simple means of gains and losses; 100 without losses, 50 if nothing moved."""
    gain = full(F.avg(F.greatest("ret", F.lit(0.0))), "ret", k, trailing(k))
    loss = full(F.avg(F.greatest(-F.col("ret"), F.lit(0.0))), "ret", k, trailing(k))
    both = df.withColumn("__g", gain).withColumn("__l", loss)
    value = F.when(F.col("__g") + F.col("__l") == 0, 50.0).otherwise(100 * F.col("__g") / (F.col("__g") + F.col("__l")))
    return both.withColumn(f"rsi_{k}", value).drop("__g", "__l")


def sign_run(df: DataFrame) -> DataFrame:
    """sign_run: length of the current run of returns of one sign; a zero return is a sign of its own, null has no run."""
    sign = F.signum("ret")
    new = F.coalesce((~F.lag(sign).over(by_date()).eqNullSafe(sign)).cast("int"), F.lit(1))
    marked = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy(*KEYS, "__island").orderBy("date"))
    return marked.withColumn("sign_run", F.when(F.col("ret").isNotNull(), run)).drop("__new", "__island")


def vol_ratio(df: DataFrame) -> DataFrame:
    """vol_ratio_5_20 from rolling_std_5 and rolling_std_20; null if the latter is zero."""
    return df.withColumn("vol_ratio_5_20", F.col("rolling_std_5") / F.nullif(F.col("rolling_std_20"), F.lit(0.0)))


def absret_surprise(df: DataFrame, k: int = 20) -> DataFrame:
    """absret less its mean over the k rows before."""
    return df.withColumn("absret_surprise", F.col("absret") - mean("absret", k, 1))


def day_of_week(df: DataFrame) -> DataFrame:
    """dow (Monday 0) and dummies dow_0 ... dow_4."""
    return df.withColumn("dow", F.weekday("date")).withColumns({f"dow_{i}": (F.weekday("date") == i).cast("int") for i in range(5)})


def rolling_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({"rolling_ret_5d": mean("ret", 5), "rolling_ret_20d": mean("ret", 20), "rolling_absret": mean("absret", 5)})


def realised_vol(df: DataFrame, k: int = 5, eps: float = 1e-8) -> DataFrame:
    """rvk_past: log of the root of the sum of squared returns of the last k rows, plus eps."""
    return df.withColumn(f"rv{k}_past", F.log(F.sqrt(full(F.sum(F.col("ret") * F.col("ret")), "ret", k, trailing(k))) + eps))


def price_features(prices: DataFrame) -> DataFrame:
    """All price features; one shuffle by (market, symbol) serves the windows, sign_run adds one by island."""
    df = lags(lags(returns(prices), "ret", 5), "absret", 3)
    df = rsi(leverage(har_components(rolling_std(df))))
    return day_of_week(realised_vol(rolling_returns(absret_surprise(vol_ratio(sign_run(df))))))


def change(c: Column, n: int = 5, keys: tuple[str, ...] = ("market",)) -> Column:
    return c - F.lag(c, n).over(by_date(*keys))


def implied_vol_features(df: DataFrame, vix: str, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """vix_chg_5d and vix_ma5_ratio of column vix."""
    return df.withColumn("vix_chg_5d", F.col(vix) / F.lag(vix, 5).over(by_date(*keys)) - 1).withColumn("vix_ma5_ratio", F.col(vix) / mean(vix, 5, keys=keys))


def variance_risk_premium(df: DataFrame, vix: str) -> DataFrame:
    """vrp = ln(vix / 100 / sqrt(252)) - rv5_past."""
    return df.withColumn("vrp", F.log(F.col(vix) / 100 / F.sqrt(F.lit(252.0))) - F.col("rv5_past"))


def vhat_change(df: DataFrame, vhat: str = "vhat") -> DataFrame:
    return df.withColumn("vhat_chg", F.col(vhat) - F.col("rv5_past"))


def extended_financial(df: DataFrame, names: dict[str, str], keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """The extended set from columns named by vix9d, vix, vvix, hyg, lqd, y30, y5, tlt, uup: vix_term, vvix_dev, credit_5d, slope, slope_5d, tlt_5d, uup_5d."""
    c = {k: F.col(v) for k, v in names.items()}
    df = df.withColumn("vix_term", F.log(c["vix9d"] / c["vix"])).withColumn("__lv", F.log(c["vvix"]))
    df = df.withColumn("vvix_dev", F.col("__lv") - mean("__lv", 20, keys=keys)).drop("__lv")
    df = df.withColumn("credit_5d", change(F.log(c["hyg"] / c["lqd"]), 5, keys)).withColumn("slope", c["y30"] - c["y5"])
    df = df.withColumn("slope_5d", change(F.col("slope"), 5, keys))
    return df.withColumn("tlt_5d", change(F.log(c["tlt"]), 5, keys)).withColumn("uup_5d", change(F.log(c["uup"]), 5, keys))


def lag_exogenous(df: DataFrame, cols: list[str], n: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """cols of n rows before, under their own names: what is known strictly before the row's day. n = 0 changes nothing."""
    return df.withColumns({c: F.lag(c, n).over(by_date(*keys)) for c in cols}) if n else df
