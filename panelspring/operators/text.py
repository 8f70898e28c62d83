"""Text features of headlines: token counts, lexicon and model scores, daily sentiment, intensity and vectors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, CountVectorizerModel, ElementwiseProduct, Normalizer, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.frames import by_date, full, mean, trailing
from . import ranges

#: Bytes of text that a scorer sees at once.
SCORED = 2_000_000
DAY = ("market",)
SENTIMENT = ["news_volume", "sent_pos_mean", "sent_neg_mean", "sent_neu_mean", "sent_score_mean", "sent_score_std", "sent_max_neg", "sent_pos_ratio", "sent_neg_ratio"]


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and letters beyond ASCII, without blanks."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-zà-ÿ]+"), "")


def term_weights(df: DataFrame, key: str = "headline_id", text: str = "headline", vocab: int = 500, norm: str | None = None, plus_one: bool = False) -> DataFrame:
    """(key, token, tf, idf, weight) for the `vocab` commonest tokens: idf = ln((N + 1) / (df + 1)), plus 1 if asked; norm "l2" scales a row to length 1.

    Commonness is the number of occurrences; ties go by token. The vocabulary is a bounded table and is broadcast.
    """
    n = df.select(F.count("*").alias("docs"))
    counts = df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    words = counts.groupBy("token").agg(F.sum("tf").alias("__all"), F.count("*").alias("__df")).orderBy(F.col("__all").desc(), "token").limit(vocab)
    idf = F.log((F.col("docs") + 1) / (F.col("__df") + 1)) + (1.0 if plus_one else 0.0)
    out = counts.join(F.broadcast(words.crossJoin(n).select("token", idf.alias("idf"))), "token").withColumn("weight", F.col("tf") * F.col("idf"))
    if norm == "l2":
        out = out.withColumn("weight", F.col("weight") / F.nullif(F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key))), F.lit(0.0)))
    return out.select(key, "token", "tf", "idf", "weight")


def score_headlines(df: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], text: str = "headline", with_vector: bool = False) -> DataFrame:
    """df with pos, neg, neu (and vec) from a batch scorer: a function from a series of texts to a frame of those columns.

    The scorer travels to the executors once a task and sees the texts of an Arrow batch in runs of rows of at most SCORED bytes,
    at least one row; one call gives classes and vectors together. Workers give memory back after each task.
    """
    extra = StructType.fromDDL("pos double, neg double, neu double" + (", vec array<float>" if with_vector else ""))
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema], *extra])
    types = [(f.name, to_arrow_type(f.dataType)) for f in extra]
    most = SCORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
                batch, at = whole.slice(at, end - at), end
                scores = scorer(pd.Series(batch.column(text).to_pylist(), dtype=object, name=text).fillna(""))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(scores[c], t, from_pandas=True) for c, t in types]], names=schema.names)
            # Free before the next batch is read.
            whole = batch = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


def fit_scorer(df: DataFrame, text: str = "headline", label: str = "label", vocab: int = 5_000, reg: float = 0.01) -> Callable[[pd.Series], pd.DataFrame]:
    """A scorer for score_headlines(), learned from rows with a label of 0 or 1 (others are left out).

    Logistic regression on log counts of the `vocab` commonest tokens, fitted by Spark. pos and neg share by its probability what
    neu leaves; neu is the share of a text's distinct tokens that the fit does not know, and 1 for a text without tokens.
    The scorer holds the vocabulary and its weights, so its size is bounded by vocab.
    """
    rows = df.where(F.col(label).isin(0, 1)).select(tokens(F.col(text)).alias("__t"), F.col(label).cast("double").alias("__y"))
    words = CountVectorizerModel.from_vocabulary(vocabulary(df.where(F.col(label).isin(0, 1)), text, vocab), "__t", "__c")
    # Log counts keep a long text from outweighing the others; they stay sparse, as a row of `vocab` numbers is larger than its text.
    logs = F.udf(lambda v: Vectors.sparse(v.size, v.indices, np.log1p(v.values)), VectorUDT())
    # The fit reads them twice before it keeps blocks of its own.
    vectors = words.transform(rows).select("__y", logs("__c").alias("__x")).persist()
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=reg, maxIter=100).fit(vectors)
    vectors.unpersist()
    weights, base = dict(zip(words.vocabulary, (float(w) for w in model.coefficients.toArray()))), float(model.intercept)
    pattern = re.compile("[a-zà-ÿ]+")

    def scorer(series: pd.Series) -> pd.DataFrame:
        out = []
        for one in series:
            counts = Counter(pattern.findall(one.lower()))
            known = [t for t in counts if t in weights]
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, base + sum(weights[t] * math.log1p(counts[t]) for t in known)))))
            neu = 1 - len(known) / len(counts) if counts else 1.0
            out.append((p * (1 - neu), (1 - p) * (1 - neu), neu))
        return pd.DataFrame(out, columns=["pos", "neg", "neu"], dtype=float)

    return scorer


def lexicon_scores(df: DataFrame, lexicon: DataFrame, key: str = "headline_id", text: str = "headline") -> DataFrame:
    """(key, n_tokens, n_hits, polarity): sum of token polarities; headlines without tokens are kept with zeros."""
    rows = df.select(key, F.explode_outer(tokens(F.col(text))).alias("token"))
    joined = rows.join(lexicon.select("token", "polarity"), "token", "left")
    return joined.groupBy(key).agg(F.count("token").alias("n_tokens"), F.count("polarity").alias("n_hits"), F.coalesce(F.sum("polarity"), F.lit(0.0)).alias("polarity"))


def sentiment_aggregates() -> list[Column]:
    """The nine aggregates of pos, neg and neu, named as in SENTIMENT; the deviation of a single headline is 0."""
    score, best = F.col("pos") - F.col("neg"), F.greatest("pos", "neg", "neu")
    return [
        F.count("*").alias("news_volume"), F.avg("pos").alias("sent_pos_mean"), F.avg("neg").alias("sent_neg_mean"), F.avg("neu").alias("sent_neu_mean"),
        F.avg(score).alias("sent_score_mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sent_score_std"), F.max("neg").alias("sent_max_neg"),
        F.avg((F.col("pos") == best).cast("double")).alias("sent_pos_ratio"), F.avg((F.col("neg") == best).cast("double")).alias("sent_neg_ratio"),
    ]


def daily_sentiment(df: DataFrame) -> DataFrame:
    """The nine daily aggregates of pos, neg, neu by (market, date)."""
    return df.groupBy("market", "date").agg(*sentiment_aggregates())


def vocabulary(df: DataFrame, text: str = "headline", vocab: int = 500) -> list[str]:
    """The `vocab` commonest tokens by number of occurrences, ties by token, in the order of their text; bounded by vocab, so it is collected."""
    words = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("__all"))
    return sorted(r["token"] for r in words.orderBy(F.col("__all").desc(), "token").limit(vocab).collect())


def sparse_terms(df: DataFrame, text: str = "headline", vocab: int = 500, out: str = "vec") -> DataFrame:
    """df without the text but with out: TF-IDF of `vocab` terms as a sparse vector of length 1, or empty for a text without any of the terms.

    Weights are those of term_weights() with norm "l2" and plus_one. Terms are numbered in the order of their text. A row's vector
    comes from its own text, so only counts of tokens are shuffled, and the vocabulary and its document frequencies collected.
    """
    words = vocabulary(df, text, vocab)
    # Names that no token can have fill the vectors up to their size.
    counter = CountVectorizerModel.from_vocabulary([*words, *[f"\0{i}" for i in range(vocab - len(words))]], "__t", "__c")
    counts = counter.transform(df.withColumn("__t", tokens(F.col(text))))
    idf = IDF(inputCol="__c", outputCol="__w").fit(counts).idf.toArray() if words else [0.0] * vocab
    weighted = ElementwiseProduct(scalingVec=Vectors.dense([float(w) + 1 for w in idf]), inputCol="__c", outputCol="__w").transform(counts)
    return Normalizer(p=2.0, inputCol="__w", outputCol="__n").transform(weighted).select(*[c for c in df.columns if c not in (text, out)], F.col("__n").alias(out))


def term_vectors(df: DataFrame, key: str = "headline_id", text: str = "headline", vocab: int = 500, out: str = "vec") -> DataFrame:
    """(key, vec): sparse_terms() as one array for each row of df; a text without any of the terms has zeros."""
    return sparse_terms(df.select(key, text), text, vocab, out).select(key, vector_to_array(out).alias(out))


def sentiment_dynamics(daily: DataFrame) -> DataFrame:
    """ma5, ma20, surprise (score less ma5), momentum_3d, vol_5d and news_volume_chg over news days."""
    s = "sent_score_mean"
    df = daily.withColumn("sent_ma5", mean(s, 5, keys=DAY)).withColumn("sent_ma20", mean(s, 20, keys=DAY))
    df = df.withColumn("sent_surprise", F.col(s) - F.col("sent_ma5")).withColumn("sent_momentum_3d", F.col(s) - F.lag(s, 3).over(by_date(*DAY)))
    df = df.withColumn("sent_vol_5d", full(F.stddev_samp(s), s, 5, trailing(5, keys=DAY)))
    return df.withColumn("news_volume_chg", F.col("news_volume") - F.lag("news_volume").over(by_date(*DAY)))


def ewma(df: DataFrame, cols: dict[str, tuple[str, int]], on: str = "date", rows: int = 60, keys: tuple[str, ...] = DAY, most: int = ranges.MOST) -> DataFrame:
    """df with exponentially weighted means: cols[out] is (column, span), weights (1 - 2/(span+1))^i, newest first, divided by their sum.

    The mean covers the known values of the last `rows` rows. The weighted sum of the whole past is a recursion (see
    ranges.affine_scan); what it was `rows` rows ago, times the weight of that age, is taken off.
    """
    by, keep = list(keys), {out: 1 - 2 / (span + 1) for out, (_, span) in cols.items()}
    known = {c: F.when(F.col(c).isNotNull(), F.lit(1.0)) for c, _ in cols.values()}
    maps = {f"__e_{out}": (F.col(c), F.lit(keep[out])) for out, (c, _) in cols.items()} | {f"__n_{c}": (x, F.lit(1.0)) for c, x in known.items()}
    scanned = ranges.affine_scan(df, by, on, maps, F.lit(0.0), most)
    # From before each row to after it.
    after = {f"__e_{out}": F.when(F.col(c).isNull(), F.col(f"__e_{out}")).otherwise(F.col(c) + keep[out] * F.col(f"__e_{out}")) for out, (c, _) in cols.items()}
    scanned = scanned.withColumns(after | {f"__n_{c}": F.col(f"__n_{c}") + F.coalesce(x, F.lit(0.0)) for c, x in known.items()})
    scanned, hot = ranges.cut(scanned, by, on, most)
    if hot:
        scanned = ranges.numbered(scanned.drop(ranges.RANGE), by, [on], "__at", most)
        old = scanned.select(*by, (F.col("__at") + rows).alias("__at"), *[F.col(c).alias(f"__old{c}") for c in maps])
        scanned = ranges.same(scanned, old, [*by, "__at"])
    else:
        scanned = scanned.withColumns({f"__old{c}": F.lag(c, rows).over(Window.partitionBy(*by).orderBy(on)) for c in maps})

    def value(out: str, c: str) -> Column:
        n = F.col(f"__n_{c}") - F.coalesce(f"__old__n_{c}", F.lit(0.0))
        gone = F.pow(F.lit(keep[out]), n)
        return (F.col(f"__e_{out}") - gone * F.coalesce(f"__old__e_{out}", F.lit(0.0))) / F.nullif((1 - gone) / (1 - keep[out]), F.lit(0.0))

    return scanned.select(*df.columns, *[value(out, c).alias(out) for out, (c, _) in cols.items()])


def smoothed_sentiment(daily: DataFrame, spans: tuple[int, ...] = (5, 20)) -> DataFrame:
    cols = {"score": "sent_score_mean", "neg": "sent_neg_mean", "maxneg": "sent_max_neg"}
    return ewma(daily, {f"ewm_{k}_{s}": (c, s) for k, c in cols.items() for s in spans})


def news_intensity(cands: DataFrame, topics: list[str], high: int = 3) -> DataFrame:
    """(market, date, n_cand, n_hi, mean_relevance, n_<topic>) from boolean topic columns."""
    return cands.groupBy("market", "date").agg(
        F.count("*").alias("n_cand"), F.count_if(F.col("relevance_score") >= high).alias("n_hi"), F.avg(F.col("relevance_score").cast("double")).alias("mean_relevance"),
        *[F.count_if(F.col(t)).alias("n_" + t.removeprefix("topic_")) for t in topics],
    )


def ratio_to_trailing(df: DataFrame, cols: list[str], k: int = 60, keys: tuple[str, ...] = DAY) -> DataFrame:
    """c_ratio: c over the mean of up to k rows before, today excluded; null on the first row or if that mean is zero."""
    w = trailing(k, 1, keys)
    return df.withColumns({f"{c}_ratio": F.col(c) / F.nullif(F.avg(c).over(w), F.lit(0.0)) for c in cols})


def mean_vector(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """(by, n, vec): element-wise mean, as partial sums by element."""
    rows = df.select(*by, F.posexplode(vec).alias("i", "x"))
    parts = rows.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"))


def _vector(df: DataFrame, c: str) -> Column:
    """c, an array of numbers or a vector, as a vector."""
    return F.col(c) if isinstance(df.schema[c].dataType, VectorUDT) else array_to_vector(F.col(c).cast("array<double>"))


def fit_pca(train: DataFrame, k: int, vec: str = "vec") -> PCAModel:
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(train.select(_vector(train, vec).alias("__v")))


def apply_pca(df: DataFrame, model: PCAModel, vec: str = "vec", out: str = "pca") -> DataFrame:
    """Components with the sign that makes each component's largest loading positive. The model knows training rows only."""
    loadings = model.pc.toArray()
    signs = [1.0 if abs(col.max()) >= abs(col.min()) else -1.0 for col in loadings.T]
    scored = model.transform(df.withColumn("__v", _vector(df, vec))).withColumn("__a", vector_to_array("__p"))
    return scored.withColumn(out, F.array(*[F.col("__a")[i] * s for i, s in enumerate(signs)])).drop("__v", "__p", "__a")


def explained_variance(spark, model: PCAModel) -> DataFrame:
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return spark.createDataFrame(rows, "component int, share double")


def interactions(df: DataFrame, score: str, vix: str, vol: str) -> DataFrame:
    return df.withColumn("sent_x_vix", F.col(score) * F.col(vix)).withColumn("sent_x_vol", F.col(score) * F.col(vol))


def comovement(df: DataFrame, score: str, ret: str, k: int = 20, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Rolling deviation of returns beside the rolling correlation of score and absolute return."""
    a = df.withColumn("__a", F.abs(ret))
    return a.withColumn("roll_vol", full(F.stddev_samp(ret), ret, k, trailing(k, keys=keys))).withColumn("roll_corr", F.when(F.count("__a").over(trailing(k, keys=keys)) == k, F.corr(score, "__a").over(trailing(k, keys=keys)))).drop("__a")
