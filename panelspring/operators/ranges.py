"""Ordered work over keys of any size: a large key's rows are cut into ranges of its order, and what a range needs of those before it is carried in.

A window over a key is one task. Where a key has more rows than `most`, its rows get a range number from approximate
quantiles of the order column; windows then run within (key, range), and a table with one row for each range tells what the
earlier ranges add up to. Keys of up to `most` rows are one range, 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a key that one task sorts, about.
MOST = 1_000_000
#: Ranges of a key at most; a key with more rows than this times `most` has larger ranges.
MOST_RANGES = 1_000
#: Tables of keys and ranges up to this number of rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 100_000
RANGE = "__range"


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """left joined with right on keys that are equal or both null; right's other columns follow. Without keys right is one row."""
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"__k_{c}"), keys, right)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys], F.lit(True))
    out = left.join(F.broadcast(renamed) if small or not keys else renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__k_{c}" for c in keys])


def cut(df: DataFrame, by: list[str], on: str, most: int = MOST) -> tuple[DataFrame, bool]:
    """(df with a range number, whether any key has several ranges): rows with equal `on` share a range, nulls come first.

    `on` is a number, date or timestamp. One row reaches the driver: the count of large keys and the size of the largest.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    top = counts.agg(F.count("*").alias("keys"), F.max("__n").alias("n")).first()
    if not top["keys"]:
        return df.withColumn(RANGE, F.lit(0)), False
    parts = min(MOST_RANGES, math.ceil(top["n"] / most))
    small = top["keys"] <= BROADCAST_ROWS
    quantiles = F.percentile_approx(on, [k / parts for k in range(1, parts)], 10 * parts).alias("__q")
    bounds = same(df.select(*by, on), counts, by, "inner", small).groupBy(*by, "__n").agg(quantiles)
    own = F.least(F.lit(parts), F.ceil(F.col("__n") / most).cast("int"))
    pick = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at("__q", F.greatest(F.lit(1), F.floor(i * parts / own).cast("int"))))
    bounds = bounds.select(*by, F.array_distinct(pick).alias("__bounds"))
    rows = same(df, bounds, by, "left", small)
    return rows.withColumn(RANGE, F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(on))), F.lit(0))).drop("__bounds"), True


def within(by: list[str], hot: bool) -> WindowSpec:
    """The window of one task: a range of a key if any key has several, else the key."""
    return Window.partitionBy(*by, RANGE) if hot else Window.partitionBy(*by)


def carry(rows: DataFrame, by: list[str], totals: dict[str, Column], over: dict[str, Callable[[WindowSpec], Column]], back: bool = False) -> DataFrame:
    """rows of cut() with what the earlier ranges of their key (the later ones, if back) come to.

    totals are aggregates of a range; over[c], given the window of those ranges, is column c of the result, null in a key's
    first range unless the expression says otherwise.
    """
    before = Window.partitionBy(*by).orderBy(F.col(RANGE).desc() if back else F.col(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy(*by, RANGE).agg(*[a.alias(c) for c, a in totals.items()])
    table = table.select(*by, RANGE, *[f(before).alias(c) for c, f in over.items()])
    return same(rows, table, [*by, RANGE])


def numbered(df: DataFrame, by: list[str], order: list[str], out: str, most: int = MOST) -> DataFrame:
    """df with `out`, the row's position within its key from 0, nulls first. Rows that are equal in order[0] share a range."""
    rows, hot = cut(df, by, order[0], most)
    rows = rows.withColumn(out, (F.row_number().over(within(by, hot).orderBy(*order)) - 1).cast("long"))
    if hot:
        rows = carry(rows, by, {"n": F.count("*")}, {"__before": lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))})
        rows = rows.withColumn(out, F.col(out) + F.col("__before")).drop("__before")
    return rows.drop(RANGE)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], most: int = MOST, own: bool = True) -> DataFrame:
    """df with running sums over its key, the row itself included (or not, where own is False: 0 on the first row)."""
    rows, hot = cut(df, by, order[0], most)
    w = within(by, hot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if hot:
        totals = {f"__t_{c}": F.sum(e) for c, e in sums.items()}
        rows = carry(rows, by, totals, {f"__b_{c}": (lambda v, c=c: F.sum(f"__t_{c}").over(v)) for c in sums})
    value = {c: F.coalesce(F.sum(e).over(w), F.lit(0)) + (F.coalesce(f"__b_{c}", F.lit(0)) if hot else F.lit(0)) for c, e in sums.items()}
    return rows.withColumns(value).drop(RANGE, *[f"__b_{c}" for c in sums])


def affine_scan(df: DataFrame, by: list[str], on: str, maps: dict[str, tuple[Column, Column]], start: Column, most: int = MOST) -> DataFrame:
    """df with a column for each of maps, (a, b): the value v of the recursion v <- a + b * v before the row's own step, in the order of `on`.

    v begins with `start`, which is one value for a key. A null a or b leaves v as it is. Maps of this kind compose to maps of
    this kind, so every range is folded by itself, from an unknown beginning, to a + b * v; ranges are then composed, and v
    put in. Tasks see one sorted stream of rows and hold two numbers for each map.
    """
    names = list(maps)
    rows, hot = cut(df, by, on, most)
    rows = rows.withColumn("__start", start.cast("double"))
    for i, (a, b) in enumerate(maps.values()):
        known = a.isNotNull() & b.isNotNull()
        rows = rows.withColumns({f"__a{i}": F.when(known, a).otherwise(0.0).cast("double"), f"__b{i}": F.when(known, b).otherwise(1.0).cast("double")})
    keys, n = [*by, RANGE], len(names)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, on)
    schema = StructType([*dealt.schema.fields, *[StructField(f"__{k}{i}", DoubleType()) for i in range(n) for k in ("u", "m")]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, [(0.0, 1.0)] * n
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            # Where a new key or range begins.
            new = np.zeros(size, bool)
            for k in keys:
                c = batch.column(k)
                codes = c.dictionary_encode() if not pa.types.is_dictionary(c.type) else c
                ix = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= ix[1:] != ix[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != last
            last = tuple(batch.column(k)[size - 1].as_py() for k in keys)
            begins = set(np.flatnonzero(new).tolist())
            columns = []
            for i in range(n):
                a, b = batch.column(f"__a{i}").to_pylist(), batch.column(f"__b{i}").to_pylist()
                u, m = state[i]
                us, ms = [0.0] * size, [0.0] * size
                for j in range(size):
                    if j in begins:
                        u, m = 0.0, 1.0
                    us[j], ms[j] = u, m
                    u, m = a[j] + b[j] * u, b[j] * m
                state[i] = (u, m)
                columns += [pa.array(us, pa.float64()), pa.array(ms, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f"__{k}{i}" for i in range(n) for k in ("u", "m")]])

    out = dealt.mapInArrow(fold, schema)
    if hot:
        end = lambda i: F.struct((F.col(f"__a{i}") + F.col(f"__b{i}") * F.col(f"__u{i}")).alias("u"), (F.col(f"__b{i}") * F.col(f"__m{i}")).alias("m"))
        totals = {"ends": F.max_by(F.struct(*[end(i).alias(f"e{i}") for i in range(n)]), F.struct(F.col(on).isNotNull(), on)), "start": F.first("__start")}
        step = lambda i: lambda v: F.aggregate(F.collect_list("ends").over(v), F.col("start"), lambda s, e: e[f"e{i}"]["u"] + e[f"e{i}"]["m"] * s)
        out = carry(out, by, totals, {f"__s{i}": step(i) for i in range(n)})
    value = {c: F.col(f"__u{i}") + F.col(f"__m{i}") * (F.col(f"__s{i}") if hot else F.col("__start")) for i, c in enumerate(names)}
    return out.withColumns(value).select(*df.columns, *names)


def selected(df: DataFrame, by: list[str], cols: list[str], shares: list[float], accuracy: int = 10_000, most: int = MOST) -> DataFrame:
    """(by, c_0, c_1, ... for each column c): exact interpolated percentiles at the shares, as F.percentile() has them, with bounded state.

    A quantile sketch brackets each wanted rank between two values; rows below the bracket are counted, and only those within it,
    about 6 / accuracy of all, are put in order. So the state of an aggregate does not grow with the number of distinct values.
    Keys of up to `accuracy` rows are put in order whole.
    """
    slack = 3 / accuracy
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
    sketch = [x for c in cols for x in (F.count(c).alias(f"__n_{c}"), F.percentile_approx(c, ends, accuracy).alias(f"__e_{c}"), F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__z_{c}"))]
    bounds = df.groupBy(*by).agg(*sketch)
    few = lambda c: F.col(f"__n_{c}") <= accuracy
    lo, hi = lambda c, k: F.when(few(c), F.col(f"__a_{c}")).otherwise(F.col(f"__e_{c}")[2 * k]), lambda c, k: F.when(few(c), F.col(f"__z_{c}")).otherwise(F.col(f"__e_{c}")[2 * k + 1])
    wanted = [(c, k) for c in cols for k in range(len(shares))]
    met = same(df.select(*by, *cols), bounds, by)
    below = met.groupBy(*by).agg(*[F.count_if(F.col(c) < lo(c, k)).alias(f"__l_{c}_{k}") for c, k in wanted])
    cells = F.array(*[F.when(F.col(c).between(lo(c, k), hi(c, k)), F.struct(F.lit(i).alias("id"), F.col(c).cast("double").alias("v"))) for i, (c, k) in enumerate(wanted)])
    inside = met.select(*by, F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy(*by, "id", "v").agg(F.count("*").alias("n"))
    inside = running(inside, [*by, "id"], ["v"], {"upto": F.col("n")}, most)
    table = same(bounds, below, by)
    for i, (c, k) in enumerate(wanted):
        rank = F.lit(shares[k]) * (F.col(f"__n_{c}") - 1)
        table = table.withColumns({f"__f_{i}": F.floor(rank) - F.col(f"__l_{c}_{k}"), f"__c_{i}": F.ceil(rank) - F.col(f"__l_{c}_{k}"), f"__w_{i}": rank - F.floor(rank)})
    found = same(inside, table, by).groupBy(*by).agg(
        *[F.min(F.when((F.col("id") == i) & (F.col("upto") > F.col(f"__{e}_{i}")), F.col("v"))).alias(f"__v{e}_{i}") for i in range(len(wanted)) for e in ("f", "c")], *[F.first(f"__w_{i}").alias(f"__w_{i}") for i in range(len(wanted))]
    )
    value = lambda i: F.col(f"__vf_{i}") + (F.col(f"__vc_{i}") - F.col(f"__vf_{i}")) * F.col(f"__w_{i}")
    found = found.select(*by, *[value(i).alias(f"{c}_{k}") for i, (c, k) in enumerate(wanted)])
    return same(bounds.select(*by), found, by) if by else found
