"""Models: closed forms by sums that Spark aggregates, and MLlib learners. Fits read rows with role = 'train' only."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS
from ..functions.metrics import r2_of
from . import gram, ranges
from .text import SENTIMENT


def naive_mean(df: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Test rows with yhat, the mean of the training rows of their key."""
    means = df.where(F.col("role") == "train").groupBy(*by).agg(F.avg(y).alias("yhat"))
    return df.where(F.col("role") == "test").join(means, by, "left")


def _moments(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Means and covariances of xs and y over the training rows of each key that have them all: one aggregate."""
    rows = df.where(F.col("role") == "train").dropna(subset=[*xs, y])
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    agg = [F.count("*").cast("double").alias("n"), F.avg(y).alias("my")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    agg += [F.covar_pop(xs[i], xs[j]).alias(f"s{i}_{j}") for i, j in pairs] + [F.covar_pop(x, y).alias(f"c{i}") for i, x in enumerate(xs)]
    return rows.groupBy(*by).agg(*agg)


def _solve(m: DataFrame, by: list[str], groups: list[list[int]], alpha: float) -> DataFrame:
    """(by, n, and beta_g and intercept_g for each group of column numbers), from one row of moments a key."""
    keys = m.select(*by).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["n long"] + [f"beta_{g} array<double>, intercept_{g} double" for g in range(len(groups))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*by]].copy()
            out["n"] = pdf["n"].astype("int64")
            for g, use in enumerate(groups):
                slopes, shifts = [], []
                for r in pdf.to_dict("records"):
                    a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in use] for i in use]) + np.eye(len(use)) * alpha / r["n"]
                    b = np.linalg.lstsq(a, np.array([r[f"c{i}"] for i in use]), rcond=None)[0]
                    slopes.append(b)
                    shifts.append(r["my"] - float(b @ np.array([r[f"m{i}"] for i in use])))
                out[f"beta_{g}"], out[f"intercept_{g}"] = slopes, shifts
            yield out

    return m.mapInPandas(solve, schema)


def linear_fit(df: DataFrame, by: list[str], xs: list[str], y: str = "y", alpha: float = 0.0) -> DataFrame:
    """(by, beta, intercept, n) of least squares, or ridge with penalty alpha on the slopes of centred columns.

    One aggregate gives the moments; the small systems, one row a key, are solved in tasks, so keys may be many. Of a
    singular system the solution with the least norm is taken.
    """
    fit = _solve(_moments(df, by, xs, y), by, [list(range(len(xs)))], alpha)
    return fit.select(*by, F.col("beta_0").alias("beta"), F.col("intercept_0").alias("intercept"), "n")


def linear_predict(df: DataFrame, fit: DataFrame, by: list[str], xs: list[str], out: str = "yhat") -> DataFrame:
    value = F.col("intercept")
    for i, x in enumerate(xs):
        value = value + F.col("beta")[i] * F.col(x)
    return df.join(fit.select(*by, "beta", "intercept"), by, "left").withColumn(out, value).drop("beta", "intercept")


def har_rv(df: DataFrame, by: list[str], y: str = "y_logvol", xs: tuple[str, ...] = ("har_1", "har_5", "har_22")) -> DataFrame:
    """Test rows with yhat of least squares on daily, weekly and monthly volatility."""
    return linear_predict(df.where(F.col("role") == "test"), linear_fit(df, by, list(xs), y), by, list(xs))


#: Rows that one task of a tree learner takes; a learner runs thousands of short jobs, and more tasks than these need slow each.
ROWS_PER_TASK = 100_000


def dealt(df: DataFrame) -> DataFrame:
    """df in no more partitions than its rows need."""
    n = -(-df.count() // ROWS_PER_TASK)
    return df.coalesce(max(1, n))


def assemble(df: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol="features", handleInvalid="skip").transform(df)


def logistic_l2(train: DataFrame, xs: list[str], y: str = "y", c: float = 0.01):
    """Logistic regression with penalty 1 / (c n) on unscaled slopes, which is C = c in the usual notation."""
    n = max(1, train.count())
    return LogisticRegression(featuresCol="features", labelCol=y, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(assemble(train, xs))


def linear_l2(train: DataFrame, xs: list[str], y: str = "y", reg: float = 0.01):
    return LinearRegression(featuresCol="features", labelCol=y, regParam=reg, elasticNetParam=0.0).fit(assemble(train, xs))


def probability(model, df: DataFrame, xs: list[str], out: str = "p") -> DataFrame:
    """df (rows with all xs) with the probability of class 1."""
    return model.transform(assemble(df, xs)).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def prediction(model, df: DataFrame, xs: list[str], out: str = "yhat") -> DataFrame:
    return model.transform(assemble(df, xs)).withColumn(out, F.col("prediction")).drop("features", "prediction")


def random_forest(train: DataFrame, xs: list[str], y: str = "y", kind: str = "reg", trees: int = 100, depth: int = 15, min_leaf: int = 1, seed: int = 42):
    cls = RandomForestRegressor if kind == "reg" else RandomForestClassifier
    return cls(featuresCol="features", labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed).fit(assemble(dealt(train), xs))


def boosted_trees(train: DataFrame, xs: list[str], y: str = "y", kind: str = "reg", trees: int = 100, depth: int = 3, rate: float = 0.04, subsample: float = 0.8, colsample: float = 0.6, validation: str | None = None, tolerance: float = 0.01, seed: int = 42):
    """Boosted trees. With `validation` (a boolean column) adding trees stops once its loss no longer falls by the tolerance."""
    cls = GBTRegressor if kind == "reg" else GBTClassifier
    stop = {"validationIndicatorCol": validation, "validationTol": tolerance} if validation else {}
    return cls(featuresCol="features", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=str(colsample), seed=seed, **stop).fit(assemble(dealt(train), xs))


def validation_curve(spark, model, df: DataFrame, xs: list[str], loss: str = "squared") -> DataFrame:
    """(trees, loss) of a boosted model on df after each tree."""
    rows = assemble(df, xs)
    values = model.evaluateEachIteration(rows, loss) if isinstance(model, GBTRegressionModel) else model.evaluateEachIteration(rows)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "trees int, loss double")


def patience(losses: list[float], rounds: int = 40) -> tuple[int, int]:
    """(best, stop), numbers of trees from 1: stop is the first stage that lies `rounds` after the least loss so far, or the last one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= rounds:
            return best + 1, i + 1
    return best + 1, len(losses)


def truncated(spark, model, trees: int):
    """A boosted model cut to its first `trees` trees."""
    java, jvm, gateway = model._java_obj, spark._jvm, spark.sparkContext._gateway
    kind = "regression" if isinstance(model, GBTRegressionModel) else "classification"
    parts = gateway.new_array(getattr(jvm.org.apache.spark.ml.regression, "DecisionTreeRegressionModel"), trees)
    weights = gateway.new_array(jvm.double, trees)
    for i in range(trees):
        parts[i], weights[i] = java.trees()[i], float(java.treeWeights()[i])
    cls = getattr(getattr(jvm.org.apache.spark.ml, kind), type(model).__name__)
    return type(model)(cls(java.uid(), parts, weights).setFeaturesCol(model.getFeaturesCol()))


def early_stopped(spark, train: DataFrame, valid: DataFrame, xs: list[str], y: str = "y", kind: str = "reg", trees: int = 600, rounds: int = 40, **how):
    """(model, curve): boosted trees stopped by patience on the validation rows, and (trees, loss, best) up to where the rule stopped.

    One full fit; its stages' validation losses come from one more pass over the validation rows. The rule takes the least loss
    that is not bettered within `rounds` trees, and the model is cut to that stage.
    """
    model = boosted_trees(train, xs, y, kind, trees, **how)
    rows = assemble(valid, xs)
    losses = list(model.evaluateEachIteration(rows, "squared") if kind == "reg" else model.evaluateEachIteration(rows))
    best, stop = patience(losses, rounds)
    curve = spark.createDataFrame([(i + 1, float(v), i + 1 == best) for i, v in enumerate(losses[:stop])], "trees int, loss double, best boolean")
    return truncated(spark, model, best), curve


def importances(spark, model, xs: list[str], top: int = 20) -> DataFrame:
    """(feature, importance) of a tree model, the `top` largest."""
    rows = [(x, float(v)) for x, v in zip(xs, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(top)


def out_of_fold(df: DataFrame, xs: list[str], fit, predict, keys: list[str], out: str = "vhat") -> DataFrame:
    """Predictions for the test rows of each fold from a model fitted on that fold's training rows: keys and out.

    df has fold and role, as from splits.expanding_oof. Folds are few; each fit is a Spark job.
    """
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())
    parts = []
    for k in folds:
        fold = df.where(F.col("fold") == k)
        parts.append(predict(fit(fold.where("role = 'train'"), xs), fold.where("role = 'test'"), xs, out).select(*keys, out))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def stack(base: dict[str, DataFrame], keys: list[str], y: DataFrame, out: str = "yhat", meta: str = "ridge") -> DataFrame:
    """Meta model (ridge, or logistic on probabilities) on out-of-fold predictions of the base models: rows with y, every base's prediction and out.

    y has keys, y and role; the meta model is fitted on training rows that every base predicted.
    """
    wide = y
    for name, df in base.items():
        wide = wide.join(df.select(*keys, F.col(out).alias(name)), keys, "left")
    names = list(base)
    if meta == "logistic":
        wide = wide.dropna(subset=names)
        return probability(logistic_l2(wide.where("role = 'train'"), names, "y", 1.0), wide, names, out)
    wide = wide.withColumn("__all", F.lit(1))
    return linear_predict(wide, linear_fit(wide, ["__all"], names, "y", 1.0), ["__all"], names, out).drop("__all")


def _variances(returns: DataFrame, by: list[str], grid: list[tuple[float, float, float, float]], ret: str, most: int) -> DataFrame:
    """(by, date, ret, h0, h_0, h_1, ...): the conditional variance of every return at each grid point, in one scan."""
    rows = returns.where(F.col(ret).isNotNull()).select(*by, "date", ret)
    rows = ranges.same(rows, rows.groupBy(*by).agg(F.avg(F.col(ret) * F.col(ret)).alias("h0")), by)
    r = F.col(ret)
    shock = lambda omega, alpha, gamma: F.lit(float(omega)) * F.col("h0") + (F.lit(float(alpha)) + F.when(r < 0, F.lit(float(gamma))).otherwise(0.0)) * r * r
    return ranges.affine_scan(rows, by, "date", {f"h_{i}": (shock(o, a, g), F.lit(float(b))) for i, (o, a, b, g) in enumerate(grid)}, F.col("h0"), most)


def garch_grid(returns: DataFrame, by: list[str], grid: list[tuple[float, float, float, float]], ret: str = "ret", most: int = ranges.MOST) -> DataFrame:
    """(by, omega, alpha, beta, gamma, loglik): Gaussian log-likelihood of GARCH(1,1), or GJR where gamma is not 0, for each grid point.

    The variance recursion h <- a + beta * h is a scan of affine maps (see ranges.affine_scan), for all grid points at once; it
    starts at the mean squared return. Long series are scanned in many tasks.
    """
    rows = _variances(returns, by, grid, ret, most)
    loglik = lambda i: F.sum(-0.5 * (1.8378770664093453 + F.log(f"h_{i}") + F.col(ret) * F.col(ret) / F.col(f"h_{i}")))
    fits = rows.groupBy(*by).agg(F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("omega", "alpha", "beta", "gamma"), g)], loglik(i).alias("loglik")) for i, g in enumerate(grid)]).alias("x"))
    return fits.select(*by, F.inline("x"))


def garch_filter(returns: DataFrame, by: list[str], omega: float, alpha: float, beta: float, gamma: float = 0.0, ret: str = "ret", most: int = ranges.MOST) -> DataFrame:
    """(by, date, ret, variance): the conditional variance of every return, by the recursion of garch_grid() with omega times the mean square."""
    return _variances(returns, by, [(omega, alpha, beta, gamma)], ret, most).select(*by, "date", ret, F.col("h_0").alias("variance"))


def garch_best(fits: DataFrame, by: list[str]) -> DataFrame:
    best = F.max_by(F.struct("omega", "alpha", "beta", "gamma", "loglik"), F.struct("loglik", -F.col("omega"), -F.col("alpha"), -F.col("beta"), -F.col("gamma")))
    return fits.groupBy(*by).agg(best.alias("x")).select(*by, "x.*")


#: The eight parameters of the search space and their levels.
SPACE = {
    "trees": [50, 100], "depth": [2, 3, 5], "rate": [0.02, 0.04, 0.1], "subsample": [0.6, 0.8, 1.0],
    "colsample": [0.4, 0.6, 1.0], "min_leaf": [1, 10], "bins": [16, 32], "seed": [1, 2],
}


def search_space(n: int = 100, space: dict[str, list] = SPACE, seed: int = 7) -> list[dict]:
    """n points of the grid in an order fixed by integer mixing, without repeats while there are enough."""
    points = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    order = sorted(range(len(points)), key=lambda i: (((i + 1) * 48271 + seed * 69621) ** 2 % 2147483647, i))
    return [points[order[i % len(points)]] | {"trial": i} for i in range(n)]


def sweep(spark, train: DataFrame, valid: DataFrame, xs: list[str], y: str = "y", n: int = 100, space: dict[str, list] = SPACE, parallel: int = 4) -> DataFrame:
    """(trial, params, loss): validation RMSE of boosted trees at n points of the space, `parallel` fits at a time."""
    fit, check = assemble(dealt(train), xs).cache(), assemble(dealt(valid), xs).cache()

    def one(p: dict) -> tuple[int, str, float]:
        model = GBTRegressor(featuresCol="features", labelCol=y, maxIter=p["trees"], maxDepth=p["depth"], stepSize=p["rate"], subsamplingRate=p["subsample"], featureSubsetStrategy=str(p["colsample"]), minInstancesPerNode=p["min_leaf"], maxBins=p["bins"], seed=p["seed"]).fit(fit)
        loss = RegressionEvaluator(labelCol=y, metricName="rmse").evaluate(model.transform(check))
        return p["trial"], ",".join(f"{k}={p[k]}" for k in space), float(loss)

    with ThreadPool(parallel) as pool:
        rows = pool.map(inheritable_thread_target(spark)(one), search_space(n, space))
    fit.unpersist()
    check.unpersist()
    return spark.createDataFrame(rows, "trial int, params string, loss double")


def best_trial(trials: DataFrame):
    """The row of trials with the least loss; of equal losses the first trial."""
    return trials.where("loss IS NOT NULL").orderBy("loss", "trial").first()


def sweep_curve(trials: DataFrame, per_range: int = 100_000) -> DataFrame:
    """trials with best_so_far by trial number.

    In two levels: trials are cut into ranges of about per_range rows, and each range begins with the least loss before it.
    """
    k = max(1, -(-trials.count() // per_range))
    cuts = trials.approxQuantile("trial", [i / k for i in range(1, k)], 0.1 / k) if k > 1 else []
    splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="trial", outputCol="__range", handleInvalid="keep").transform(trials)
    ranged = ranged.withColumn("__range", F.when(F.col("trial").isNull(), -1.0).otherwise(F.col("__range")))
    before = F.min("__least").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("__range").agg(F.min("loss").alias("__least")).select("__range", before.alias("__before"))
    inside = F.min("loss").over(Window.partitionBy("__range").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0))
    curve = ranged.withColumn("__inside", inside).join(F.broadcast(starts), "__range")
    return curve.select(*trials.columns, F.least("__inside", "__before").alias("best_so_far"))


def nested_select(inner: DataFrame, by: list[str], candidate: str = "model", score: str = "auc") -> DataFrame:
    """The candidate with the best mean inner score for each key, ties by name, and how many there were."""
    means = inner.groupBy(*by, candidate).agg(F.avg(score).alias("inner_score"))
    w = Window.partitionBy(*by)
    ranked = means.withColumn("__n", F.row_number().over(w.orderBy(F.col("inner_score").desc_nulls_last(), candidate))).withColumn("candidates", F.count("*").over(w))
    return ranked.where("__n = 1").drop("__n")


def ensemble_mean(preds: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(p).alias(p), F.count("*").alias("members"))


def mz_calibrate(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Test rows with yhat_cal from a regression of y on yhat over the validation rows of the key."""
    fit = df.where("role = 'valid'").groupBy(*by).agg(F.regr_slope(y, yhat).alias("__b"), F.regr_intercept(y, yhat).alias("__a"))
    return df.where("role = 'test'").join(fit, by, "left").withColumn("yhat_cal", F.col("__a") + F.col("__b") * F.col(yhat)).drop("__a", "__b")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def platt_calibrate(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Test rows with p_cal: logistic regression of y on logit(p) over the validation rows."""
    rows = df.withColumn("__z", logit(F.col(p)))
    model = LogisticRegression(featuresCol="features", labelCol=y, maxIter=200).fit(assemble(rows.where("role = 'valid'"), ["__z"]))
    return probability(model, rows.where("role = 'test'"), ["__z"], "p_cal").drop("__z")


def fold_logit_standardize(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Test rows with z: logit(p) less mean over deviation of the same model's training predictions of the key. No labels."""
    rows = df.withColumn("__z", logit(F.col(p)))
    stats = rows.where("role = 'train'").groupBy(*by).agg(F.avg("__z").alias("__m"), F.stddev_samp("__z").alias("__s"))
    return rows.where("role = 'test'").join(stats, by, "left").withColumn("z", (F.col("__z") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__z", "__m", "__s")


#: Feature groups by name: which columns of the feature table a fit may see. F0 is AR_Only and F1 AR_News. AR is what learners see.
AR = ["ret_lag1", "ret_lag2", "absret_lag1", "absret_lag2", "absret_lag3", "rolling_std_5", "rolling_std_20", "har_22", "leverage_5d", "rsi_14"]
AR_ALL = [
    *AR, "ret", "absret", "ret_lag3", "ret_lag4", "ret_lag5", "rolling_std_22", "har_5", "har_20", "leverage_20d", "vol_ratio_5_20", "absret_surprise", "rolling_ret_5d", "rolling_ret_20d",
    "rv5_past", "sign_run",
]
DOW = [f"dow_{i}" for i in range(5)]
DYNAMICS = ["sent_ma5", "sent_ma20", "sent_surprise", "sent_momentum_3d", "sent_vol_5d", "news_volume_chg"]
NEWS = [*SENTIMENT, *DYNAMICS, "news_available"]
INTENSITY = ["n_cand", "n_hi", "mean_relevance", "n_cand_ratio", "n_hi_ratio", "mean_relevance_ratio"]
SMOOTHED = [f"ewm_{k}_{s}" for k in ("score", "neg", "maxneg") for s in (5, 20)]
CLEAN = ["vix_level", "vix_chg_5d", "vix_ma5_ratio", "vrp", "vix_term", "vvix_dev", "credit_5d", "slope", "slope_5d", "tlt_5d", "uup_5d"]
INTERACTIONS = ["sent_x_vix", "sent_x_vol"]
FINANCIAL = [*CLEAN, *INTERACTIONS]
GROUPS = {
    "AR_Only": AR_ALL, "News_Pure": NEWS, "News_Only": NEWS + INTENSITY + SMOOTHED, "AR_News": AR_ALL + NEWS, "Financial_Clean": CLEAN, "Financial_Only": FINANCIAL,
    "No_News": AR_ALL + DOW + CLEAN, "Full": AR_ALL + DOW + NEWS + INTENSITY + SMOOTHED + FINANCIAL, "F2": AR_ALL + INTENSITY, "F3": AR_ALL + INTENSITY + SMOOTHED, "F4": AR_ALL + INTENSITY + NEWS,
    "F5": AR_ALL + SMOOTHED,
}


def ablate(df: DataFrame, by: list[str], groups: dict[str, list[str]], y: str = "y", alpha: float = 1.0) -> DataFrame:
    """(by, feature_group, r2): out-of-sample R2 of ridge for each feature group, all on the rows that have every feature.

    The covariances of all features are taken once, as blocks of a matrix (see gram), and every group is solved from its part
    of them; one more pass over the test rows scores all groups. So the data is read twice, however many groups there are.
    """
    every = sorted({x for xs in groups.values() for x in xs})
    rows = df.dropna(subset=[*every, y]).select(*by, "role", F.array(*[F.col(x).cast("double") for x in every]).alias("x"), F.lit(None).cast("array<struct<i:int,v:double>>").alias("s"), F.col(y).cast("double").alias("y"))
    return gram.group_scores(rows, by, {g: [every.index(x) for x in xs] for g, xs in groups.items()}, len(every), 0, alpha)


def select_and_refit(df: DataFrame, by: list[str], groups: dict[str, list[str]], y: str = "y", alpha: float = 1.0) -> DataFrame:
    """(by, feature_group, r2_valid, r2_test, candidates): the group with the best R2 on validation rows, refitted on train and validation, scored on test once.

    Ridge for each group, as in ablate(): the choice sees training and validation rows, the second fit both together.
    """
    role = F.col("role")
    select = df.where(role != "test").withColumn("role", F.when(role == "valid", "test").otherwise(role))
    refit = df.withColumn("role", F.when(role == "valid", "train").otherwise(role))
    chosen = nested_select(ablate(select, by, groups, y, alpha), by, "feature_group", "r2")
    tested = ablate(refit, by, groups, y, alpha).withColumnRenamed("r2", "r2_test")
    return chosen.join(tested, [*by, "feature_group"]).select(*by, "feature_group", F.col("inner_score").alias("r2_valid"), "r2_test", "candidates")


def marginal_sweep(df: DataFrame, by: list[str], base: list[str], extra: list[str], y: str = "y") -> DataFrame:
    """ablate() of the base and of the base with one more column at a time."""
    return ablate(df, by, {"base": base} | {f"+{x}": [*base, x] for x in extra}, y)


def pooled_vs_single(df: DataFrame, xs: list[str], y: str = "y") -> DataFrame:
    """(market, symbol, r2_pooled, r2_single): one fit over all series against one for each."""
    rows = df.dropna(subset=[*xs, y]).withColumn("all", F.lit(1))
    test = rows.where("role = 'test'")
    pooled = linear_predict(test, linear_fit(rows, ["all"], xs, y), ["all"], xs, "pooled")
    both = linear_predict(pooled, linear_fit(rows, list(KEYS), xs, y), list(KEYS), xs, "single")
    return both.groupBy(*KEYS).agg(r2_of(F.col(y), F.col("pooled")).alias("r2_pooled"), r2_of(F.col(y), F.col("single")).alias("r2_single"))
