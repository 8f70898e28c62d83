"""Least squares on hundreds of columns: covariances as blocks of a matrix, summed by Spark, and groups of columns solved from parts of it.

A row is an array of dense features and, for texts, a list of (index, value) of sparse ones. Tasks add up counts, means and
centred cross products of their rows, block by block, so no expression grows with the square of the columns; blocks of one
key meet by (key, block) and are merged in a way that loses no precision. Only solving sees a key's matrix whole: columns
squared, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.metrics import r2_of
from . import ranges

#: Columns on a side of a block.
BLOCK = 128
#: Numbers that a task holds before it hands its sums on.
HELD = 30_000_000
#: Rows that become one dense matrix at a time.
ROWS = 2_000


def blocks(df: DataFrame, by: list[str], dense: int, sparse: int, block: int = BLOCK) -> DataFrame:
    """(by, i, j, n, mi, mj, m): for i <= j the count, the means of both blocks of columns, and the centred sums of their products, packed.

    df has by, x (array of `dense` numbers), s (array of (i, v), i below `sparse`, or null) and y; columns are those of x, of s, and y.
    """
    size = dense + sparse + 1
    starts = list(range(0, size, block))
    fields = [df.schema[k] for k in by]
    schema = StructType([*fields, *StructType.fromDDL("i int, j int, n long, mi binary, mj binary, m binary").fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    held, some = HELD, ROWS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            out = []
            for key, (n, mean, m) in total.items():
                for i, a in enumerate(starts):
                    for j, b in enumerate(starts[i:], i):
                        out.append((*key, i, j, n, mean[a : a + block].tobytes(), mean[b : b + block].tobytes(), m[a : a + block, b : b + block].tobytes()))
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, some):
                batch = whole.slice(at, some)
                x = np.zeros((batch.num_rows, size))
                for k in range(batch.num_rows):
                    if dense:
                        x[k, :dense] = batch.column("x")[k].values.to_numpy(zero_copy_only=False)
                    if sparse and (s := batch.column("s")[k]).is_valid and len(s):
                        x[k, dense + s.values.field("i").to_numpy(zero_copy_only=False)] = s.values.field("v").to_numpy(zero_copy_only=False)
                x[:, -1] = batch.column("y").to_numpy(zero_copy_only=False)
                keys: dict[tuple, list[int]] = {}
                for k, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by])):
                    keys.setdefault(key, []).append(k)
                for key, rows in (keys or {(): list(range(batch.num_rows))}).items():
                    own = x[rows]
                    n, mean = len(own), own.mean(0)
                    own = own - mean
                    m = own.T @ own
                    if key in total:
                        n0, mean0, m0 = total[key]
                        d = mean - mean0
                        total[key] = (n0 + n, mean0 + d * n / (n0 + n), m0 + m + np.outer(d, d) * (n0 * n / (n0 + n)))
                    else:
                        total[key] = (n, mean, m)
                if len(total) * size * size > held:
                    yield flush()
        if total:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mi, mj, m = 0, 0.0, 0.0, 0.0
        for k, a, b, c in zip(pdf["n"], pdf["mi"], pdf["mj"], pdf["m"]):
            a, b, c = np.frombuffer(a), np.frombuffer(b), np.frombuffer(c)
            da, db = a - mi, b - mj
            m = m + c + np.outer(da, db).ravel() * (n * k / (n + k))
            mi, mj, n = mi + da * k / (n + k), mj + db * k / (n + k), n + k
        out = pdf.iloc[:1].copy()
        out["n"], out["mi"], out["mj"], out["m"] = n, [mi.tobytes()], [mj.tobytes()], [m.tobytes()]
        return out

    parts = df.where("y IS NOT NULL").mapInArrow(add, schema)
    return parts.groupBy(*by, "i", "j").applyInPandas(merge, schema)


def solve(moments: DataFrame, by: list[str], groups: dict[str, list[int]], alpha: float) -> DataFrame:
    """(by, feature_group, beta, intercept, n): ridge of y on each group of column numbers; beta has a number for every column, 0 outside the group.

    The penalty alpha is on the slopes of centred columns; of a singular system the solution with the least norm is taken.
    """
    schema = StructType([*[moments.schema[k] for k in by], *StructType.fromDDL("feature_group string, beta array<double>, intercept double, n long").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        width = {k: len(x) // 8 for i, x in (("i", "mi"), ("j", "mj")) for k, x in zip(pdf[i], pdf[x])}
        start = dict(zip(sorted(width), np.cumsum([0, *[width[k] for k in sorted(width)]])))
        size = sum(width.values())
        mean, cov = np.zeros(size), np.zeros((size, size))
        for i, j, mi, mj, m in zip(pdf["i"], pdf["j"], pdf["mi"], pdf["mj"], pdf["m"]):
            a, b = slice(start[i], start[i] + width[i]), slice(start[j], start[j] + width[j])
            mean[a], mean[b] = np.frombuffer(mi), np.frombuffer(mj)
            cov[a, b] = np.frombuffer(m).reshape(width[i], width[j]) / n
            cov[b, a] = cov[a, b].T
        out = []
        for name, use in groups.items():
            beta = np.zeros(size - 1)
            beta[use] = np.linalg.lstsq(cov[np.ix_(use, use)] + np.eye(len(use)) * alpha / n, cov[use, -1], rcond=None)[0]
            out.append((name, beta, float(mean[-1] - beta @ mean[:-1]), n))
        rows = pd.DataFrame(out, columns=["feature_group", "beta", "intercept", "n"])
        for k in reversed(by):
            rows.insert(0, k, [pdf[k].iloc[0]] * len(rows))
        return rows

    return moments.groupBy(*by).applyInPandas(run, schema)


def predicted(beta: Column, intercept: Column, dense: int, sparse: int) -> Column:
    """The prediction of a row (x, s) by a fit of all columns."""
    add = lambda a, p: a + p["b"] * p["x"]
    value = F.aggregate(F.arrays_zip(F.slice(beta, 1, dense).alias("b"), F.col("x").alias("x")), intercept, add) if dense else intercept
    if sparse:
        value = value + F.aggregate(F.coalesce("s", F.array().cast("array<struct<i:int,v:double>>")), F.lit(0.0), lambda a, e: a + e["v"] * F.get(beta, e["i"] + dense))
    return value


def group_scores(df: DataFrame, by: list[str], groups: dict[str, list[int]], dense: int, sparse: int = 0, alpha: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(by, feature_group, r2): R2 on the test rows of ridge of each group, fitted on the training rows, from df (by, role, x, s, y).

    One pass over the training rows for all groups, one over the test rows. Fits meet the test rows by key.
    """
    fits = solve(blocks(df.where("role = 'train'"), by, dense, sparse, block), by, groups, alpha)
    wide = fits.groupBy(*by).agg(*[F.max(F.when(F.col("feature_group") == g, F.struct("intercept", "beta"))).alias(f"__f{k}") for k, g in enumerate(groups)])
    test = ranges.same(df.where("role = 'test' AND y IS NOT NULL"), wide, by, "inner")
    scored = test.select(*by, "y", *[predicted(F.col(f"__f{k}.beta"), F.col(f"__f{k}.intercept"), dense, sparse).alias(f"__{k}") for k in range(len(groups))])
    cells = [F.struct(F.lit(g).alias("feature_group"), r2_of(F.col("y"), F.col(f"__{k}")).alias("r2")) for k, g in enumerate(groups)]
    return scored.groupBy(*by).agg(F.array(*cells).alias("__c")).select(*by, F.inline("__c"))
