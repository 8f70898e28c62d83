"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight in every phase of training. Integrated over time, the weights give a cumulative token demand
for each source; inverting it places every copy of a document at a training position, and documents are range-sorted
by position. Within a source documents follow the order of a hash of their id, and running token counts come from
hash buckets of bounded size, so that a hot source is many small windows, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

WORD = r"[^\x20\x09-\x0D]+"
#: One phase, weights by the rank of a source among the sources by code point, repeated as needed.
WEIGHTS = (5, 2, 1)
LIMIT = 3
#: The schedule of training: most of it at the weights of the mix, then more of the lighter sources, then most of the lightest.
PHASES = ((0.6, (5, 2, 1)), (0.3, (3, 3, 2)), (0.1, (1, 2, 5)))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes (source, source_size) with weight and target: shares of the total by weight, at most limit times the size.

    What a source cannot take is shared again among the others by weight until none is above its limit. In closed form:
    with the first k sources by limit / weight at their limits, the rest fits at a level, and the right k is the one
    with the highest level. One row for each source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("weight")).withColumn("cap", (F.col("source_size") * limit).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("__level", level)
    lam = F.max("__level").over(everything)
    return rows.select("source", "source_size", "weight", F.least("cap", F.col("weight") * lam).alias("target"))


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, rank, tie, and keep): rank is the hexadecimal MD5 of the id as text, the order within a source.

    Rows without an id are ranked by their text, so that many of them are not one bucket. tie is a hash of the text, which
    orders rows that agree in all else.
    """
    by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(by.cast("binary")).alias("rank"), F.xxhash64("text").alias("tie"), *keep)


def running(rows: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """rows with `before`: words of the same source that come first by rank, then id, size and tie.

    Buckets are ranges of the rank, so many that each has about per_bucket rows; bucket sums give each bucket's start.
    """
    n = rows.count()
    digits = 1
    while 16**digits * per_bucket < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("rank", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("words").over(start), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, rows.source.eqNullSafe(F.col("__s")) & (rows.bucket == F.col("__b"))).withColumn("before", F.col("start") + F.col("within")).drop("__s", "__b", "start", "within", "bucket")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, keep, source_size, weight, target, before, copies, taken), one row per row of docs.

    Pass p (0, 1, 2 ...) over a source lays its documents end to end from p times its size on; a copy is taken if its
    middle lies at or before the target. taken is copies times size. Null text has size 0; null is a source of its own.
    Empty documents get copies like others and take nothing.
    """
    rows = write_shared(sized(docs, keep), "sized")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    t = targets.select(F.col("source").alias("__t"), "source_size", "weight", "target")
    out = running(rows)
    out = out.join(t, out.source.eqNullSafe(F.col("__t"))).drop("__t", "rank", "tie")
    fits = [((2 * (p * F.col("source_size") + F.col("before")) + F.col("size")).cast("double") <= 2 * F.col("target")).cast("int") for p in range(limit)]
    out = out.withColumn("copies", sum(fits[1:], fits[0]))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def scheduled(mixed: DataFrame, phases: tuple[tuple[float, tuple[float, ...]], ...] = PHASES) -> DataFrame:
    """mixed, as from mix(), with positions: for each copy that is taken the time (0 to 1) at which it is due; no copy, no position.

    phases: (length, weights by rank of the source) of each phase; lengths are relative, and weights repeat as in mix().
    A source's demand is the integral of its share of the weights over time, scaled so that it ends at its target; a
    copy's position inverts it: the time at which the demand reaches the copy's middle. A null source is a source of its
    own, rows that repeat are placed one after another, and documents of no words stand where the next one begins.
    """
    whole = sum(length for length, _ in phases)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = mixed.select("source").distinct().select("source", rank.alias("r"))
    everything = Window.partitionBy()
    gains = []
    for i, (length, weights) in enumerate(phases):
        w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("r"), F.lit(len(weights))) + 1).cast("int"))
        ranked = ranked.withColumn(f"g{i}", w / F.sum(w).over(everything) * (length / whole))
        gains.append(F.col(f"g{i}"))
    total = sum(gains[1:], gains[0])
    knots, time, at = [F.lit(0.0)], [0.0], F.lit(0.0)
    for (length, _), g in zip(phases, gains):
        at = at + g
        knots.append(at / total)
        time.append(time[-1] + length / whole)
    table = ranked.select(F.col("source").alias("__t"), F.array(*knots).alias("__demand"))
    rows = mixed.join(table, mixed.source.eqNullSafe(F.col("__t"))).drop("__t")

    def due(copy: Column) -> Column:
        share = F.when(F.col("target") > 0, F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"))).otherwise(0.0)
        position = F.lit(1.0)
        for i in reversed(range(len(phases))):
            lo, hi = F.col("__demand")[i], F.col("__demand")[i + 1]
            inside = F.lit(time[i]) + (share - lo) / F.greatest(hi - lo, F.lit(1e-300)) * (time[i + 1] - time[i])
            position = F.when(share <= hi, F.greatest(inside, F.lit(time[i]))).otherwise(position)
        return position

    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("positions", F.transform(copies, due)).drop("__demand")


def curriculum(mixed: DataFrame, phases: tuple[tuple[float, tuple[float, ...]], ...] | None = None) -> DataFrame:
    """One row for each copy that mix() takes, with copy (0, 1, ...) and position (0 to 1): see scheduled().

    Without phases demand grows evenly. Rows of no copy are left out; an empty table gives an empty one.
    """
    rows = scheduled(mixed, phases or ((1.0, WEIGHTS),))
    return rows.select(*mixed.columns, F.posexplode("positions").alias("copy", "position"))


def document_order(docs: DataFrame, phases: tuple[tuple[float, tuple[float, ...]], ...] = PHASES) -> DataFrame:
    """mix() of docs, one row per row of docs, with positions, copies and position (that of its first copy), range-sorted by it.

    Documents that the mix does not take have no position and come first.
    """
    rows = scheduled(write_shared(mix(docs), "mixed"), phases).withColumn("position", F.get("positions", F.lit(0)))
    keys = ["position", "source", "doc_id"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def whole_order(docs: DataFrame, phases: tuple[tuple[float, tuple[float, ...]], ...] = PHASES) -> DataFrame:
    """mix() of docs with a row for each copy and its position, in training order; what is not taken comes first, once, with a null copy and position."""
    mixed = write_shared(mix(docs), "mixed")
    left = mixed.where("copies = 0").withColumns({"copy": F.lit(None).cast("int"), "position": F.lit(None).cast("double")})
    return in_order(curriculum(mixed, phases).unionByName(left))


def in_order(positioned: DataFrame) -> DataFrame:
    """Rows range-sorted by position, then by source, id and copy, nulls first, so that files follow one another in training order.

    All rows and columns stay; rows equal in all four keys may stand in any order.
    """
    keys = ["position", "source", "doc_id", "copy"]
    return positioned.repartitionByRange(*keys).sortWithinPartitions(*keys)
