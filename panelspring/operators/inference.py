"""Statistical inference over predictions: block bootstrap, Diebold-Mariano, multiple testing, series diagnostics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import ranges

#: Modulus and multipliers of the portable draws.
P, M1, M2 = 2147483647, 48271, 69621
#: Replicates that one task counts at once.
CHUNK = 100


def draw(rep: Column, blk: Column, seed: int) -> Column:
    """A pseudo-random integer below P from integer arithmetic alone, equal on every engine.

    The four rounds are a fold, so that the expression stays small: written out, each round would copy the one before twice.
    """
    first = (M1 * (rep + 1) + M2 * (blk + 1) + seed) % P
    rounds = F.array(*[F.lit(0)] * 4)
    return F.aggregate(rounds, first, lambda x, _: (x * x + M1 * x + M2 * (blk + 1) + rep + 1) % P)


def block_starts(df: DataFrame, by: list[str], reps: int, lengths: Sequence[int], seed: int = 42) -> DataFrame:
    """(by, block_length, rep, start): ceil(n / length) block starts for each length, replicate and group; starts count from 0."""
    length = F.col("block_length")
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("block_length", F.explode(F.array(*[F.lit(k) for k in lengths]))).where(F.col("n") >= length)
    rows = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    # A few rows become millions: dealt by replicate first, so that the work is spread.
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "rep")
    rows = rows.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / length) - 1)))
    rows = rows.withColumn("x", draw(F.col("rep"), F.col("blk"), seed))
    return rows.select(*by, "block_length", "rep", (F.col("x") % (F.col("n") - length + 1)).alias("start"))


def replicates(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], reps: int, lengths: Sequence[int] = (10,), seed: int = 42) -> DataFrame:
    """(by, block_length, rep, sums): for each replicate the sums over its blocks, joined as sums by block start, so rows are reps x blocks.

    All lengths share one read of the rows and one join: a plan for each of them would be kept by the driver at once. Spark takes the block starts for as small as the keys that they are exploded from and would broadcast them: the join is asked to sort both sides.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ahead = lambda length: F.struct(F.lit(length).alias("block_length"), *[F.sum(e).over(w.rowsBetween(0, length - 1)).alias(k) for k, e in sums.items()])
    blocks = df.select(*by, (F.row_number().over(w) - 1).cast("long").alias("start"), F.array(*[ahead(k) for k in lengths]).alias("__sums"))
    blocks = blocks.select(*by, "start", F.inline("__sums"))
    starts = block_starts(df, by, reps, lengths, seed)
    return starts.hint("merge").join(blocks, [*by, "block_length", "start"]).groupBy(*by, "block_length", "rep").agg(*[F.sum(k).alias(k) for k in sums])


def _r2_sums(y: str, yhat: str, tag: str = "") -> dict[str, Column]:
    e = F.col(y) - F.col(yhat)
    return {f"se{tag}": e * e, "sy": F.col(y), "syy": F.col(y) * F.col(y), "k": F.lit(1)}


def _r2(tag: str = "") -> Column:
    return 1 - F.col(f"se{tag}") / F.nullif(F.col("syy") - F.col("sy") * F.col("sy") / F.col("k"), F.lit(0.0))


def interval(c: str) -> list[Column]:
    q = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return [q[0].alias("ci_lo"), q[1].alias("ci_hi")]


def bootstrap_r2(df: DataFrame, by: list[str], order: list[str], y: str = "y", yhat: str = "yhat", reps: int = 5000, length: int = 10, seed: int = 42) -> DataFrame:
    """95 % percentile interval of R2 under contiguous blocks."""
    return bootstrap_r2_lengths(df, by, order, y, yhat, reps, [length], seed).drop("block_length")


def bootstrap_r2_lengths(df: DataFrame, by: list[str], order: list[str], y: str = "y", yhat: str = "yhat", reps: int = 5000, lengths: Sequence[int] = (5, 10, 15, 20), seed: int = 42) -> DataFrame:
    """bootstrap_r2() for each of several block lengths, with `block_length`; a group has no row for a length that it is shorter than."""
    rows = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    r = replicates(rows, by, order, _r2_sums(y, yhat), reps, sorted(set(lengths)), seed).select(*by, "block_length", _r2().alias("r2"))
    return r.groupBy(*by, "block_length").agg(*interval("r2"), F.count("*").alias("reps"))


def paired_bootstrap_r2(df: DataFrame, by: list[str], order: list[str], a: str, b: str, y: str = "y", reps: int = 10000, length: int = 10, seed: int = 42) -> DataFrame:
    """Interval of R2(a) - R2(b) on the same draws, and whether it leaves out 0."""
    rows = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    r = replicates(rows, by, order, _r2_sums(y, a, "_a") | _r2_sums(y, b, "_b"), reps, [length], seed).select(*by, (_r2("_a") - _r2("_b")).alias("d"))
    out = r.groupBy(*by).agg(*interval("d"))
    return out.withColumn("differs", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def replicate_aucs(rows: DataFrame, by: list[str], order: list[str], y: str, p: str, reps: int, length: int, seed: int, most: int = ranges.MOST) -> DataFrame:
    """(by, rep, auc) of contiguous blocks; ranks are taken inside each replicate.

    The rows of a key are sorted by score once. A replicate is a vector of weights, how often its blocks cover each row, from
    counts of its block starts; one running sum of the weights of class 0 in the order of scores gives its wins. Tasks take
    ranges of replicates, and for large keys ranges of scores, whose wins across are added from their totals; so what is
    shuffled is the rows once for each CHUNK of replicates, and a row for each replicate. Keys of fewer rows than a block have none.
    """
    placed = ranges.numbered(rows.select(*by, F.col(y).cast("long").alias("y"), F.col(p).cast("double").alias("p"), *order), by, order, "at", most)
    placed, hot = ranges.cut(placed.select(*by, "y", "p", "at"), by, "p", most)
    part = [*by, ranges.RANGE] if hot else by
    sorted_rows = F.array_sort(F.collect_list(F.struct("p", "at", "y")))
    packed = ranges.same(placed.groupBy(*part).agg(sorted_rows.alias("r")), rows.groupBy(*by).agg(F.count("*").alias("n")), by).where(F.col("n") >= length)
    packed = packed.select(*part, "n", *[F.col(f"r.{c}").alias(c) for c in ("p", "at", "y")])
    tasks = packed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(CHUNK))))
    tasks = tasks.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *part, "rep")
    schema = StructType([*[packed.schema[c] for c in part], *[StructField(c, LongType()) for c in ("rep", "one", "zero", "wins")]])
    modulus, m1, m2, chunk = P, M1, M2, CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, first = batch.column("n")[i].as_py(), batch.column("rep")[i].as_py()
                score, at, label = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("p", "at", "y"))
                tie = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
                blk = np.arange(-(-n // length), dtype=np.int64)
                out = []
                for rep in range(first, min(first + chunk, reps)):
                    x = (m1 * (rep + 1) + m2 * (blk + 1) + seed) % modulus
                    for _ in range(4):
                        x = (x * x + m1 * x + m2 * (blk + 1) + rep + 1) % modulus
                    covered = np.cumsum(np.bincount(x % (n - length + 1), minlength=n))
                    covered[length:] -= covered[:-length].copy()
                    weight = covered[at]
                    one, zero = np.add.reduceat(weight * label, tie), np.add.reduceat(weight * (1 - label), tie)
                    below = np.cumsum(zero) - zero
                    out.append((rep, int(one.sum()), int(zero.sum()), int((one * (2 * below + zero)).sum())))
                same = batch.slice(i, 1).select(part).to_pydict() if part else {}
                columns = [pa.array(v * len(out), batch.schema.field(c).type) for c, v in same.items()]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([r[k] for r in out], pa.int64()) for k in range(4)]], names=[*part, "rep", "one", "zero", "wins"])

    counted = tasks.mapInArrow(count, schema)
    wins, one, zero = (F.col(c).cast("decimal(38,0)") for c in ("wins", "one", "zero"))
    if hot:
        lower = Window.partitionBy(*by, "rep").orderBy(ranges.RANGE).rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("wins", wins + 2 * one * F.coalesce(F.sum(zero).over(lower), F.lit(0)))
    total = lambda c: F.sum(c).cast("double")
    return counted.groupBy(*by, "rep").agg((total("wins") / 2 / F.nullif(total("one") * total("zero"), F.lit(0.0))).alias("auc"))


def bootstrap_auc(df: DataFrame, by: list[str], order: list[str], y: str = "y", p: str = "p", reps: int = 5000, length: int = 10, seed: int = 42) -> DataFrame:
    """Interval of AUC, and the one-sided p of AUC <= 0.5."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    aucs = replicate_aucs(rows, by, order, y, p, reps, length, seed)
    return aucs.groupBy(*by).agg(*interval("auc"), F.avg((F.col("auc") <= 0.5).cast("double")).alias("p_value"))


def paired_bootstrap_auc(df: DataFrame, by: list[str], order: list[str], a: str, b: str, y: str = "y", reps: int = 10000, length: int = 10, seed: int = 42) -> DataFrame:
    """Interval of AUC(a) - AUC(b) on the same draws, and whether it leaves out 0."""
    rows = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    first, second = (replicate_aucs(rows, by, order, y, p, reps, length, seed).withColumnRenamed("auc", f"auc_{k}") for k, p in (("a", a), ("b", b)))
    both = first.join(second, [*by, "rep"]).select(*by, (F.col("auc_a") - F.col("auc_b")).alias("d"))
    return both.groupBy(*by).agg(*interval("d")).withColumn("differs", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal value by the 26.2.17 polynomial of Abramowitz and Stegun."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-a * a / 2) / F.sqrt(F.lit(6.283185307179586)) * poly


def diebold_mariano(df: DataFrame, by: list[str], order: list[str], e1: Column, e2: Column, h: int = 1, bandwidth: int | None = None, hln: bool = False, most: int = ranges.MOST) -> DataFrame:
    """Mean difference of squared errors over its HAC deviation (Bartlett weights), and a two-sided normal p.

    bandwidth: lags; ceil(n^(1/3)) of each key's own n if not given. hln applies the small-sample factor for horizon h. Null
    statistic if the loss difference is constant. With Bartlett weights the sum over lags equals the scaled mean square of
    the sums of all blocks of bandwidth + 1 rows, those that reach over either end included. Block sums are differences of a
    running sum that lie bandwidth + 1 rows apart, so the plan is the same for any number of lags.
    """
    rows = df.withColumn("__d", e1 * e1 - e2 * e2).where("__d IS NOT NULL")
    lags = F.lit(bandwidth) if bandwidth is not None else F.ceil(F.pow(F.count("*"), F.lit(1 / 3)))
    stats = rows.groupBy(*by).agg(F.avg("__d").alias("__mean"), F.count("*").alias("__n"), (lags + 1).cast("long").alias("__m"))
    rows = ranges.same(rows.select(*by, *order, "__d"), stats, by)
    rows = ranges.running(rows, by, order, {"__p": F.col("__d") - F.col("__mean"), "__at": F.lit(1)}, most).select(*by, "__d", "__n", "__m", "__p", "__at")
    before = rows.select(*by, (F.col("__at") + F.col("__m")).alias("__at"), F.col("__p").alias("__q"))
    block = F.col("__p") - F.coalesce("__q", F.lit(0.0))
    # Blocks that begin in the last rows reach over the end.
    late = (F.col("__at") > F.col("__n") - F.col("__m")) & (F.col("__at") < F.col("__n"))
    sums = {
        "whole": F.sum(block * block), "late": F.coalesce(F.sum(F.when(late, F.col("__p"))), F.lit(0.0)), "late2": F.coalesce(F.sum(F.when(late, F.col("__p") * F.col("__p"))), F.lit(0.0)),
        "lates": F.count_if(late), "end": F.max(F.when(F.col("__at") == F.col("__n"), F.col("__p"))), "mean_diff": F.avg("__d"), "n": F.count("*"), "m": F.max("__m"),
    }
    out = ranges.same(rows, before, [*by, "__at"]).groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    end, n = F.col("end"), F.col("n").cast("double")
    over = F.col("late2") - 2 * end * F.col("late") + (F.col("lates") + F.greatest(F.col("m") - F.col("n"), F.lit(0))) * end * end
    out = out.withColumn("lrv", (F.col("whole") + over) / (F.col("m") * n))
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) if hln else F.lit(1.0)
    out = out.withColumn("dm", F.col("mean_diff") / F.sqrt(F.when(F.col("lrv") > 1e-300, F.col("lrv") / n)) * factor)
    return out.select(*by, "mean_diff", "lrv", "n", "dm", normal_tail(F.col("dm")).alias("p_value"))


def adjust(tests: DataFrame, family: list[str], p: str = "p_value", order: tuple[str, ...] = ()) -> DataFrame:
    """p_bonferroni, p_holm and p_bh within each family."""
    m = F.count(p).over(Window.partitionBy(*family))
    up = Window.partitionBy(*family).orderBy(p, *order)
    i = F.row_number().over(up)
    first = tests.withColumn("__h", F.col(p) * (m - i + 1)).withColumn("__b", F.col(p) * m / i)
    down = Window.partitionBy(*family).orderBy(F.col(p).desc(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumns({
        "p_bonferroni": F.least(F.lit(1.0), F.col(p) * m),
        "p_holm": F.least(F.lit(1.0), F.max("__h").over(up.rowsBetween(Window.unboundedPreceding, 0))),
        "p_bh": F.least(F.lit(1.0), F.min("__b").over(down)),
    }).drop("__h", "__b")


def verdict(df: DataFrame, ci_lo: str = "ci_lo", gains: tuple[str, ...] = ()) -> DataFrame:
    """verdict: significant if ci_lo, the lower bound of the AUC's interval, is over 0.5; improved only if every gain over a baseline is positive too; else none."""
    better = F.lit(True)
    for g in gains:
        better = better & (F.col(g) > 0)
    good = F.col(ci_lo) > 0.5
    return df.withColumn("verdict", F.when(good & better, "improved" if gains else "significant").when(good, "significant").otherwise("none"))


def moments(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic of c, population moments."""
    k, s = F.kurtosis(c), F.skewness(c)
    return df.groupBy(*by).agg(s.alias("skewness"), k.alias("kurtosis"), (F.count(c) / 6.0 * (s * s + k * k / 4)).alias("jarque_bera"))


def autocorrelation(df: DataFrame, by: list[str], c: str, lags: int, order: str = "date") -> DataFrame:
    """(by, lag, acf): correlation of c with its lag, one aggregate for all lags."""
    o = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumns({f"__{k}": F.lag(c, k).over(o) for k in range(1, lags + 1)})
    cells = [F.struct(F.lit(k).alias("lag"), F.corr(c, f"__{k}").alias("acf")) for k in range(1, lags + 1)]
    return rows.groupBy(*by).agg(F.array(*cells).alias("x")).select(*by, F.inline("x"))


def adf(df: DataFrame, by: list[str], c: str, order: str = "date") -> DataFrame:
    """Augmented Dickey-Fuller t statistic with a constant, no trend and one lagged difference, by normal equations."""
    o = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__x", F.lag(c).over(o)).withColumn("__d", F.col(c) - F.col("__x")).withColumn("__z", F.lag("__d").over(o)).where("__d IS NOT NULL AND __z IS NOT NULL")
    v = {a + b: F.covar_pop(f"__{a}", f"__{b}") for a, b in ("xx", "zz", "xz", "xd", "zd", "dd")}
    s = rows.groupBy(*by).agg(*[e.alias(k) for k, e in v.items()], F.count("*").alias("n"))
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    s = s.withColumn("b", (F.col("xd") * F.col("zz") - F.col("zd") * F.col("xz")) / det).withColumn("g", (F.col("zd") * F.col("xx") - F.col("xd") * F.col("xz")) / det)
    rss = (F.col("dd") - F.col("b") * F.col("xd") - F.col("g") * F.col("zd")) * F.col("n") / (F.col("n") - 3)
    return s.select(*by, "b", (F.col("b") / F.sqrt(rss * F.col("zz") / det / F.col("n"))).alias("adf"), "n")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, vif): diagonal of the inverse correlation matrix; only the matrix, one cell for each two columns, is collected."""
    import numpy as np

    rows = df.dropna(subset=cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    got = rows.agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.eye(len(cols))
    for i, j in pairs:
        m[i, j] = m[j, i] = got[f"c{i}_{j}"]
    inv = np.linalg.pinv(m)
    return df.sparkSession.createDataFrame([(c, float(inv[i, i])) for i, c in enumerate(cols)], "feature string, vif double")
