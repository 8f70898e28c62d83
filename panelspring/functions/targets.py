"""Forward targets. They look ahead by design and are null where the series ends too soon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import KEYS, by_date, forward, full


def log_vol(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """y_logvol = ln(|next return| + eps)."""
    return df.withColumn("y_logvol", F.log(F.lead("absret").over(by_date()) + eps))


def next_day(df: DataFrame) -> DataFrame:
    """y_absret, y_ret and y_dir (1 if the next return is positive)."""
    nxt = F.lead("ret").over(by_date())
    return df.withColumns({"y_absret": F.lead("absret").over(by_date()), "y_ret": nxt, "y_dir": (nxt > 0).cast("int")})


def direction(df: DataFrame, hs: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """dir_h: 1 if the sum of the next h returns is positive."""
    return df.withColumns({f"dir_{h}": (full(F.sum("ret"), "ret", h, forward(h)) > 0).cast("int") for h in hs})


def volatility(df: DataFrame, hs: tuple[int, ...] = (1, 5), eps: float = 1e-8) -> DataFrame:
    """vol_h: log realised volatility of the next h rows."""
    return df.withColumns({f"vol_{h}": F.log(F.sqrt(full(F.sum(F.col("ret") * F.col("ret")), "ret", h, forward(h))) + eps) for h in hs})


def differenced(df: DataFrame, vol: str = "vol_5", past: str = "rv5_past") -> DataFrame:
    """d_vol = vol - past; add past to a prediction of it to come back."""
    return df.withColumn("d_" + vol, F.col(vol) - F.col(past))


def contemporaneous(df: DataFrame, features: list[str]) -> DataFrame:
    """r2_same and r2_strict by symbol for each feature: squared correlation with today's return of the feature itself and of the row before.

    The difference shows how much of a fit comes from looking at the same day.
    """
    strict = df.withColumns({f"__{c}": F.lag(c).over(by_date()) for c in features})
    parts = [F.struct(F.lit(c).alias("feature"), F.pow(F.corr("ret", c), 2).alias("r2_same"), F.pow(F.corr("ret", f"__{c}"), 2).alias("r2_strict")) for c in features]
    return strict.groupBy(*KEYS).agg(F.array(*parts).alias("x")).select(*KEYS, F.inline("x"))


def base_rate(df: DataFrame, y: str = "y_dir") -> DataFrame:
    """share of ones and of the larger class, by series."""
    return df.where(F.col(y).isNotNull()).groupBy(*KEYS).agg(F.avg(y).alias("base_rate"), F.greatest(F.avg(y), 1 - F.avg(y)).alias("majority"))


def effective_sample(df: DataFrame, y: str, h: int) -> DataFrame:
    """floor(n / h): labels over h days overlap."""
    return df.groupBy(*KEYS).agg(F.count(y).alias("n"), F.floor(F.count(y) / h).alias("n_effective"))
