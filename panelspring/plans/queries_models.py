"""Queries of models, metrics, inference and checks; closed forms have their SQL, MLlib fits have invariant tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, metrics, targets
from ..functions.frames import KEYS
from ..functions.metrics import round_all
from ..operators import batched, calendar, checks, gram, inference, models, splits, text
from . import fixtures as X
from . import linear_sql
from .fixtures import WO, r6, sql
from .queries_features import NAMES, ORACLES, query

ROLE = "CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-06-01' THEN 'valid' ELSE 'test' END"
CUTS = ("1999-01-01", "2000-06-01")
_FR = f"SELECT *, {ROLE} AS role FROM feats"
_PR = f"SELECT *, {ROLE} AS role FROM preds"
BY = ["symbol"]


def _panel(spark, sf) -> DataFrame:
    return splits.cutoff_split(X.panel(spark, sf), *CUTS)


def _preds(spark, sf) -> DataFrame:
    return splits.cutoff_split(X.predictions(spark, sf), *CUTS)


def _ar(spark, sf) -> DataFrame:
    """Rows for learners: autoregressive features, the log-vol target as y, the direction as y_dir."""
    xs = models.AR
    return _panel(spark, sf).select("market", "symbol", "date", "role", *xs, "har_1", "har_5", F.col("y_logvol").alias("y"), "y_dir", "rv5_past", "vol_5").dropna()


def _learned(spark, sf) -> DataFrame:
    """_ar(), stored, for queries that fit on it many times."""
    return X.kept(spark, _ar(spark, sf), "learned")


AR = models.AR


@query("h1_naive_mean", sql(f"SELECT symbol, date, {r6('m')} AS yhat FROM fr JOIN (SELECT symbol, avg(y_logvol) AS m FROM fr WHERE role = 'train' GROUP BY symbol) USING (symbol) WHERE role = 'test'", "feats", fr=_FR))
def _(spark, sf):
    return round_all(models.naive_mean(_panel(spark, sf), BY, "y_logvol").select("symbol", "date", "yhat"))


_TWO = """SELECT symbol, avg(har_1) AS m1, avg(har_5) AS m2, avg(y_logvol) AS my, covar_pop(har_1, har_1) + 0.0001 / COUNT(*) AS a, covar_pop(har_1, har_5) AS b, covar_pop(har_5, har_5) + 0.0001 / COUNT(*) AS c,
covar_pop(har_1, y_logvol) AS p, covar_pop(har_5, y_logvol) AS q, COUNT(*) AS n FROM fr WHERE role = 'train' AND har_1 IS NOT NULL AND har_5 IS NOT NULL AND y_logvol IS NOT NULL GROUP BY symbol"""


@query("h2_ridge", sql(f"""SELECT symbol, {r6('(p * c - q * b) / (a * c - b * b)', 5)} AS b1, {r6('(q * a - p * b) / (a * c - b * b)', 5)} AS b2,
{r6('my - m1 * (p * c - q * b) / (a * c - b * b) - m2 * (q * a - p * b) / (a * c - b * b)', 5)} AS intercept, n FROM two""", "feats", fr=_FR, two=_TWO))
def _(spark, sf):
    fit = models.linear_fit(_panel(spark, sf), BY, ["har_1", "har_5"], "y_logvol", 0.0001)
    return round_all(fit.select("symbol", F.col("beta")[0].alias("b1"), F.col("beta")[1].alias("b2"), "intercept", "n"), 5)


@query("h3_logistic_l2")
def _(spark, sf):
    d = _learned(spark, sf)
    parts = []
    for c in (0.001, 0.01, 0.1):
        model = models.logistic_l2(d.where("role = 'train'"), AR, "y_dir", c)
        parts.append(models.probability(model, d.where("role = 'test'"), AR).select("symbol", "date", F.lit(c).alias("c"), "y_dir", "p"))
    return calendar.stack_markets(*parts)


#: Settings of the registered tree learners.
FOREST = {"trees": 100, "depth": 15, "min_leaf": 20}
SHALLOW = {"trees": 300, "depth": 4, "min_leaf": 50}
BOOSTED = {"trees": 50, "depth": 3}


def _test_rows(spark, sf, fit, y: str, predict) -> DataFrame:
    """symbol, date, y and what a model fitted on the training rows says of the test rows."""
    d = _learned(spark, sf)
    return predict(fit(d.where("role = 'train'")), d.where("role = 'test'"), AR).select("symbol", "date", y, "p" if y == "y_dir" else "yhat")


@query("h4_random_forest")
def _(spark, sf):
    return _test_rows(spark, sf, lambda t: models.random_forest(t, AR, **FOREST), "y", models.prediction)


@query("h4_random_forest_shallow")
def _(spark, sf):
    return _test_rows(spark, sf, lambda t: models.random_forest(t, AR, **SHALLOW), "y", models.prediction)


@query("h4_random_forest_direction")
def _(spark, sf):
    return _test_rows(spark, sf, lambda t: models.random_forest(t, AR, "y_dir", "clf", **SHALLOW), "y_dir", models.probability)


@query("h5_boosted_trees")
def _(spark, sf):
    return _test_rows(spark, sf, lambda t: models.boosted_trees(t, AR, **BOOSTED), "y", models.prediction)


@query("h5_boosted_direction")
def _(spark, sf):
    return _test_rows(spark, sf, lambda t: models.boosted_trees(t, AR, "y_dir", "clf", trees=50, depth=2), "y_dir", models.probability)


def _stacked(spark, sf, y: str, learners: dict, predict, meta: str) -> DataFrame:
    """Three bases out of fold, and a meta model on them."""
    d = _learned(spark, sf).withColumn("y", F.col(y).cast("double"))
    keys = ["market", "symbol", "date"]
    oof = splits.expanding_oof(d.where("role <> 'test'").drop("role"), 3).unionByName(d.withColumn("fold", F.lit(9)).withColumn("role", F.when(F.col("role") == "test", "test").otherwise("train")))
    base = {name: models.out_of_fold(oof, AR, fit, predict, keys, "yhat") for name, fit in learners.items()}
    rows = d.select(*keys, "y", F.when(F.col("role") == "test", "test").otherwise("train").alias("role"))
    return models.stack(base, keys, rows, meta=meta).where("role = 'test'").select("symbol", "date", "y", *learners, "yhat")


@query("h6_stacking")
def _(spark, sf):
    learners = {
        "forest": lambda t, xs: models.random_forest(t, xs, trees=100, depth=4, min_leaf=20),
        "boosted": lambda t, xs: models.boosted_trees(t, xs, trees=25),
        "linear": lambda t, xs: models.linear_l2(t, xs),
    }
    return _stacked(spark, sf, "y", learners, models.prediction, "ridge")


@query("h6_stacking_direction")
def _(spark, sf):
    learners = {
        "forest": lambda t, xs: models.random_forest(t, xs, kind="clf", trees=100, depth=4, min_leaf=20),
        "boosted": lambda t, xs: models.boosted_trees(t, xs, kind="clf", trees=25),
        "logistic": lambda t, xs: models.logistic_l2(t, xs),
    }
    return _stacked(spark, sf, "y_dir", learners, models.probability, "logistic")


_HAR = """SELECT symbol, COUNT(*) AS n, avg(y_logvol) AS my, avg(har_1) AS m1, avg(har_5) AS m2, avg(har_22) AS m3,
covar_pop(har_1, har_1) AS a, covar_pop(har_1, har_5) AS b, covar_pop(har_1, har_22) AS c, covar_pop(har_5, har_5) AS d, covar_pop(har_5, har_22) AS e, covar_pop(har_22, har_22) AS f,
covar_pop(har_1, y_logvol) AS p, covar_pop(har_5, y_logvol) AS q, covar_pop(har_22, y_logvol) AS r FROM fr WHERE role = 'train' AND har_22 IS NOT NULL AND y_logvol IS NOT NULL GROUP BY symbol"""
_HB = """SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS b1, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS b2,
(a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS b3 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM har)"""


@query("h7_har_rv", sql(f"SELECT symbol, date, {r6('my + b1 * (har_1 - m1) + b2 * (har_5 - m2) + b3 * (har_22 - m3)', 5)} AS yhat FROM fr JOIN hb USING (symbol) WHERE role = 'test'", "feats", fr=_FR, har=_HAR, hb=_HB))
def _(spark, sf):
    return round_all(models.har_rv(_panel(spark, sf), BY).select("symbol", "date", "yhat"), 5)


GRID = [(1 - a - b, a, b, g) for a, b, g in ((0.05, 0.9, 0.0), (0.1, 0.8, 0.0), (0.2, 0.7, 0.0), (0.05, 0.8, 0.1))]
_GRID_VALUES = ", ".join(f"(CAST({o!r} AS DOUBLE), CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))" for o, a, b, c in GRID)
_GARCH = f"""WITH RECURSIVE prices AS ({X.VIEWS["prices"]}), rets AS ({X.VIEWS["rets"]}),
s AS MATERIALIZED (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, avg(ret * ret) OVER (PARTITION BY symbol) AS h0 FROM rets WHERE ret IS NOT NULL),
g AS (SELECT * FROM (VALUES {_GRID_VALUES}) AS t(omega, alpha, beta, gamma)),
rec AS (SELECT symbol, omega, alpha, beta, gamma, i, h0, h0 AS h, ret FROM s CROSS JOIN g WHERE i = 1
UNION ALL SELECT rec.symbol, omega, alpha, beta, gamma, s.i, rec.h0, omega * rec.h0 + (alpha + CASE WHEN rec.ret < 0 THEN gamma ELSE 0.0 END) * rec.ret * rec.ret + beta * rec.h, s.ret FROM rec JOIN s ON s.symbol = rec.symbol AND s.i = rec.i + 1)
"""


@query("h8_garch_grid", _GARCH + f"SELECT symbol, omega, alpha, beta, gamma, {r6('sum(-0.5 * (1.8378770664093453 + ln(h) + ret * ret / h))', 4)} AS loglik FROM rec GROUP BY ALL")
def _(spark, sf):
    return models.garch_grid(X.returns(spark, sf), BY, GRID).withColumn("loglik", F.round("loglik", 4))


_GP = (0.05, 0.05, 0.85, 0.1)


@query("h8_garch_filter", _GARCH.replace("SELECT symbol, ret,", "SELECT symbol, date, ret,").replace(_GRID_VALUES, f"(CAST({_GP[0]!r} AS DOUBLE), CAST({_GP[1]!r} AS DOUBLE), CAST({_GP[2]!r} AS DOUBLE), CAST({_GP[3]!r} AS DOUBLE))").replace("gamma, i, h0, h0 AS h, ret", "gamma, i, h0, h0 AS h, ret, date").replace("beta * rec.h, s.ret FROM", "beta * rec.h, s.ret, s.date FROM")
    + "SELECT symbol, date, CASE WHEN abs(h * 1e6) < 0.0000005 THEN 0.0 ELSE round(h * 1e6, 4) END AS variance_e6 FROM rec")
def _(spark, sf):
    out = models.garch_filter(X.returns(spark, sf), BY, *_GP)
    return out.select("symbol", "date", F.round(F.col("variance") * 1e6, 4).alias("variance_e6"))


#: Trials of the registered sweep (100 in the survey).
TRIALS = 12


@query("h9_sweep")
def _(spark, sf):
    d = _learned(spark, sf)
    space = {**models.SPACE, "trees": [5, 10]}
    trials = models.sweep(spark, d.where("role = 'train'"), d.where("role = 'valid'"), AR, n=TRIALS, space=space)
    return models.sweep_curve(trials).withColumn("chosen", F.col("trial") == models.best_trial(trials)["trial"])


@query("h10_early_stop")
def _(spark, sf):
    d = _learned(spark, sf)
    return models.early_stopped(spark, d.where("role = 'train'"), d.where("role = 'valid'"), AR, trees=100)[1]


def _vhat(spark, sf) -> DataFrame:
    """Rows with vhat, the predicted volatility: fitted on the differenced target and added to the past level.

    Training rows are predicted out of fold, evaluation rows by a fit on all training rows.
    """
    d = _learned(spark, sf)
    keys = ["market", "symbol", "date"]
    change = d.withColumn("y", F.col("vol_5") - F.col("rv5_past"))
    oof = splits.expanding_oof(change.where("role = 'train'").drop("role"), 3)
    whole = change.withColumn("fold", F.lit(9)).withColumn("role", F.when(F.col("role") == "train", "train").otherwise("test"))
    vhat = models.out_of_fold(oof.unionByName(whole, allowMissingColumns=True), AR, lambda t, xs: models.boosted_trees(t, xs, trees=25), models.prediction, keys)
    return d.join(vhat, keys).withColumn("vhat", F.col("vhat") + F.col("rv5_past"))


@query("h11_oof_feature")
def _(spark, sf):
    return _vhat(spark, sf).select("symbol", "date", "role", "vhat", "vol_5")


@query("e16_vhat_change")
def _(spark, sf):
    return features.vhat_change(_vhat(spark, sf)).select("symbol", "date", "vhat", "rv5_past", "vhat_chg")


@query("h12_ensemble_mean", sql(f"SELECT symbol, date, {r6('avg(yhat)')} AS yhat, COUNT(*) AS members FROM longp GROUP BY symbol, date", "longp"))
def _(spark, sf):
    return round_all(models.ensemble_mean(X.long_predictions(spark, sf), ["symbol", "date"], "yhat"))


_INNER = f"SELECT symbol, fold, model, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM longp GROUP BY ALL"


@query("h13_nested_select", sql(f"SELECT symbol, model, {r6('inner_score')} AS inner_score, candidates FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY inner_score DESC, model) AS n, COUNT(*) OVER (PARTITION BY symbol) AS candidates FROM (SELECT symbol, model, avg(-rmse) AS inner_score FROM inn GROUP BY ALL)) WHERE n = 1", "longp", inn=_INNER))
def _(spark, sf):
    inner = metrics.rmse_corr(X.long_predictions(spark, sf), ["symbol", "fold", "model"]).withColumn("score", -F.col("rmse"))
    return round_all(models.nested_select(inner, BY, "model", "score"))


@query("h14_feature_importance")
def _(spark, sf):
    d = _learned(spark, sf)
    return models.importances(spark, models.random_forest(d.where("role = 'train'"), AR, **FOREST), AR)


NEWS = [*text.SENTIMENT, *models.DYNAMICS, *models.INTENSITY, *models.SMOOTHED]


def _full(spark, sf) -> DataFrame:
    p = _panel(spark, sf)
    fin = features.extended_financial(features.implied_vol_features(X.wide(spark, sf), "A_F"), NAMES).withColumn("vix_level", F.col("A_F"))
    fin = fin.select("market", "date", *[c for c in models.CLEAN if c != "vrp"])
    joined = calendar.join_news(p.join(fin, ["market", "date"], "left"), X.daily_news(spark, sf), NEWS)
    whole = text.interactions(features.variance_risk_premium(joined, "vix_level"), "sent_score_mean", "vix_level", "rolling_std_20")
    # Stored: fits read it more than once, and a filter over 71 derived columns is a plan too large to optimise.
    return X.kept(spark, whole, "full")


_EWM = lambda c, span: f"(SELECT sum(b.{c} * pow(CAST({1 - 2 / (span + 1)!r} AS DOUBLE), a.i - b.i)) / sum(pow(CAST({1 - 2 / (span + 1)!r} AS DOUBLE), a.i - b.i)) FROM num b WHERE b.i BETWEEN a.i - 59 AND a.i)"
_DAY = "DATE '1995-01-01' + CAST((event_id * 7919) % 2400 AS INTEGER)"
_RATIO = lambda c: f"{c} / nullif(avg({c}) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0) AS {c}_ratio"
_S = "sent_score_mean"
_FULL = {
    "spread": X.VIEWS["scores"].replace("CAST(ts AS DATE)", _DAY),
    "daily": X.VIEWS["sent"].replace("FROM scores", "FROM spread"),
    "num": f"""SELECT *, row_number() OVER (ORDER BY date) AS i, {X.roll(f'avg({_S})', _S, 5, w=X.WD)} AS sent_ma5, {X.roll(f'avg({_S})', _S, 20, w=X.WD)} AS sent_ma20, {_S} - {X.roll(f'avg({_S})', _S, 5, w=X.WD)} AS sent_surprise,
      {_S} - lag({_S}, 3) OVER ({X.WD}) AS sent_momentum_3d, {X.roll(f'stddev_samp({_S})', _S, 5, w=X.WD)} AS sent_vol_5d, news_volume - lag(news_volume) OVER ({X.WD}) AS news_volume_chg FROM daily""",
    "smooth": f"SELECT *, {', '.join(f'{_EWM(c, n)} AS ewm_{k}_{n}' for k, c in (('score', _S), ('neg', 'sent_neg_mean'), ('maxneg', 'sent_max_neg')) for n in (5, 20))} FROM num a",
    "inten": f"SELECT *, {_RATIO('n_cand')}, {_RATIO('n_hi')}, {_RATIO('mean_relevance')} FROM (SELECT {_DAY} AS date, COUNT(*) AS n_cand, COUNT(*) FILTER (event_id % 8 >= 3) AS n_hi, avg(CAST(event_id % 8 AS DOUBLE)) AS mean_relevance FROM events GROUP BY ALL)",
    "fin": f"""SELECT market, date, A_F AS vix_level, A_F / lag(A_F, 5) OVER ({X.WD}) - 1 AS vix_chg_5d, A_F / ({X.roll('avg(A_F)', 'A_F', 5, w=X.WD)}) AS vix_ma5_ratio, ln(A_O / A_F) AS vix_term,
      ln(N_F) - {X.roll('avg(ln(N_F))', 'N_F', 20, w=X.WD)} AS vvix_dev, ln(N_O / R_F) - lag(ln(N_O / R_F), 5) OVER ({X.WD}) AS credit_5d, R_O - A_F AS slope, (R_O - A_F) - lag(R_O - A_F, 5) OVER ({X.WD}) AS slope_5d,
      ln(N_O) - lag(ln(N_O), 5) OVER ({X.WD}) AS tlt_5d, ln(R_F) - lag(ln(R_F), 5) OVER ({X.WD}) AS uup_5d FROM wide""",
    "runs": """SELECT market, symbol, date, CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY market, symbol, island ORDER BY date) END AS sign_run
      FROM (SELECT *, SUM(isnew) OVER (PARTITION BY market, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM (SELECT *, CAST(lag(sign(ret)) OVER (PARTITION BY market, symbol ORDER BY date) IS DISTINCT FROM sign(ret) AS INTEGER) AS isnew FROM rets))""",
    "fullp": f"""SELECT fr.*, sign_run, {', '.join(c for c in models.CLEAN if c != 'vrp')}, ln(vix_level / 100 / sqrt(252.0)) - rv5_past AS vrp, {', '.join(f'coalesce({c}, 0) AS {c}' for c in NEWS)}, CAST(smooth.i IS NOT NULL AS INTEGER) AS news_available,
      coalesce({_S}, 0) * vix_level AS sent_x_vix, coalesce({_S}, 0) * rolling_std_20 AS sent_x_vol
      FROM fr JOIN runs USING (market, symbol, date) LEFT JOIN fin USING (market, date) LEFT JOIN smooth USING (market, date) LEFT JOIN inten USING (date)""",
}
_GROUP_R2 = "1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / count(*))"


def _ablation_sql(groups: dict[str, list[str]]) -> str:
    """R2 of ridge of every group on the rows that have all columns."""
    xs = sorted({x for g in groups.values() for x in g})
    body = f"SELECT g AS symbol, name AS feature_group, {r6(_GROUP_R2)} AS r2 FROM scored GROUP BY ALL"
    whole = sql("/*fits*/" + body, "feats", "wide", fr=_FR, **_FULL, rows=f"SELECT symbol, role, {', '.join(xs)}, y_logvol FROM fullp WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*xs, 'y_logvol'])}")
    return whole.replace("\n/*fits*/", ",\n" + linear_sql.scored("rows", "symbol", xs, "y_logvol", groups, 1.0) + "\n").replace("WITH ", "WITH RECURSIVE ", 1)


#: Columns that the marginal sweep adds to the base, one at a time: 34.
EXTRA = [
    "ret", "absret", "ret_lag3", "ret_lag4", "ret_lag5", "rolling_std_22", "har_5", "har_20", "leverage_20d", "vol_ratio_5_20", "absret_surprise", "rolling_ret_5d",
    "rolling_ret_20d", "rv5_past", "dow_0", "dow_1", "dow_2", "dow_3", "dow_4", "news_volume", "sent_score_mean", "sent_score_std", "sent_max_neg",
    "sent_pos_ratio", "n_cand_ratio", "n_hi_ratio", "mean_relevance_ratio", "ewm_score_5", "ewm_neg_5", "ewm_maxneg_5", "vix_chg_5d", "vix_ma5_ratio", "vix_term", "credit_5d",
]


@query("h15_ablation", _ablation_sql(models.GROUPS))
def _(spark, sf):
    return round_all(models.ablate(_full(spark, sf), BY, models.GROUPS, "y_logvol"))


_TEXT_SIZES = (len(models.AR_ALL) + 64, 500)
_TEXT_GROUPS = {
    "AR_Only": range(25), "Vectors": range(25, 89), "TFIDF": range(89, 589), "AR_Vectors": range(89), "AR_TFIDF": [*range(25), *range(89, 589)], "AR_Both": range(589),
}


def _texts(spark, sf) -> DataFrame:
    """(symbol, date, role, x, s, y): autoregressive columns and the day's mean vector, the day's terms, and the target; zeros and no terms on days without texts."""
    p = _full(spark, sf).dropna(subset=[*models.AR_ALL, "y_logvol"])
    joined = p.join(X.day_vectors(spark, sf), "date", "left").join(X.day_terms(spark, sf), "date", "left")
    vec = F.coalesce("vec", F.array_repeat(F.lit(0.0), 64))
    return joined.select("symbol", "date", "role", F.concat(F.array(*[F.col(c).cast("double") for c in models.AR_ALL]), vec).alias("x"), "s", F.col("y_logvol").alias("y"))


@query("h15_text_ablation")
def _(spark, sf):
    rows = X.kept(spark, _texts(spark, sf), "texts")
    return gram.group_scores(rows, BY, {g: list(ix) for g, ix in _TEXT_GROUPS.items()}, *_TEXT_SIZES)


@query("h16_marginal_sweep", _ablation_sql({"base": AR} | {f"+{x}": [*AR, x] for x in EXTRA}))
def _(spark, sf):
    return round_all(models.marginal_sweep(_full(spark, sf), BY, AR, EXTRA, "y_logvol"))


#: Groups that a refit chooses among.
CHOICE = {g: models.GROUPS[g] for g in ("AR_Only", "AR_News", "F2", "F3", "F4", "F5", "Financial_Only", "No_News", "Full")}


def _refit_sql() -> str:
    """Ridge of every group on training rows, scored on validation rows; and on both, scored on test rows; of the best of the first the second."""
    xs = sorted({x for g in CHOICE.values() for x in g})
    part = lambda tag: linear_sql.scored("rows" + tag, "symbol", xs, "y_logvol", CHOICE, 1.0, tag)
    rows = f"SELECT symbol, role, {', '.join(xs)}, y_logvol FROM fullp WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*xs, 'y_logvol'])}"
    r2 = lambda tag: f"SELECT g AS symbol, name AS feature_group, {_GROUP_R2} AS r2 FROM scored{tag} GROUP BY ALL"
    body = f"""SELECT v.symbol, v.feature_group, {r6('v.r2')} AS r2_valid, {r6('t.r2')} AS r2_test, CAST({len(CHOICE)} AS BIGINT) AS candidates
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r2 DESC NULLS LAST, feature_group) AS k FROM ({r2('_v')})) v JOIN ({r2('_t')}) t USING (symbol, feature_group) WHERE k = 1"""
    whole = sql("/*fits*/" + body, "feats", "wide", fr=_FR, **_FULL, rows=rows,
        rows_v="SELECT * REPLACE (CASE WHEN role = 'valid' THEN 'test' ELSE role END AS role) FROM rows WHERE role <> 'test'", rows_t="SELECT * REPLACE (CASE WHEN role = 'valid' THEN 'train' ELSE role END AS role) FROM rows")
    return whole.replace("\n/*fits*/", ",\n" + part("_v") + ",\n" + part("_t") + "\n").replace("WITH ", "WITH RECURSIVE ", 1)


@query("h23_refit_train_valid", _refit_sql())
def _(spark, sf):
    return round_all(models.select_and_refit(_full(spark, sf), BY, CHOICE, "y_logvol"))


#: 28 candidates of the nested choice: seven groups of columns with four penalties.
CANDIDATES = [batched.Candidate(f"{g}/{c}", tuple(models.GROUPS[g]), c) for g in ("AR_Only", "AR_News", "News_Only", "F3", "Financial_Only", "No_News", "Full") for c in (0.001, 0.01, 0.1, 1.0)]


def _outer(spark, sf) -> DataFrame:
    """Rows with fold and role of eight walk-forward folds of the dates above their 35 % quantile, ten rows of embargo, every column known."""
    xs = sorted({x for c in CANDIDATES for x in c.columns})
    rows = _full(spark, sf).select("market", "symbol", "date", *xs, "y_dir").dropna()
    rows = X.kept(spark, rows, "whole")
    return X.kept(spark, splits.embargo(splits.assign_folds(rows, splits.date_quantile_folds(rows)), 10), "outer")


@query("h13_nested_refit")
def _(spark, sf):
    chosen, preds = batched.nested(_outer(spark, sf), ["market", "fold"], "y_dir", CANDIDATES, ["symbol", "date", "y_dir"])
    return preds.join(F.broadcast(chosen), ["market", "fold", "candidate"]).select("market", "fold", "symbol", "date", "y_dir", "candidate", "inner_score", "candidates", "p")


@query("h17_mz_calibrate", sql(f"SELECT symbol, date, {r6('a + b * yhat_b')} AS yhat_cal FROM pr JOIN (SELECT symbol, regr_slope(y, yhat_b) AS b, regr_intercept(y, yhat_b) AS a FROM pr WHERE role = 'valid' GROUP BY symbol) USING (symbol) WHERE role = 'test'", "preds", pr=_PR))
def _(spark, sf):
    return round_all(models.mz_calibrate(_preds(spark, sf), BY, "y", "yhat_b").select("symbol", "date", "yhat_cal"))


@query("h18_platt_calibrate")
def _(spark, sf):
    return models.platt_calibrate(_preds(spark, sf), "y_dir", "p").select("symbol", "date", "y_dir", "p", "p_cal")


_LG = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


@query("h19_logit_standardize", sql(f"SELECT symbol, date, {r6('(lg - m) / s')} AS z FROM lg JOIN (SELECT symbol, avg(lg) AS m, stddev_samp(lg) AS s FROM lg WHERE role = 'train' GROUP BY symbol) USING (symbol) WHERE role = 'test'", "preds", pr=_PR, lg=f"SELECT *, {_LG} AS lg FROM pr"))
def _(spark, sf):
    return round_all(models.fold_logit_standardize(_preds(spark, sf), BY).select("symbol", "date", "z"))


_HX = ["har_1", "har_5", "har_22"]


def _pooled_sql() -> str:
    part = lambda key, tag: linear_sql.scored("rows", key, _HX, "y_logvol", {"a": _HX}, 0.0, tag)
    whole = sql("/*fits*/" + f"SELECT 'ALL' AS market, symbol, {r6('p.r2')} AS r2_pooled, {r6('s.r2')} AS r2_single FROM (SELECT s AS symbol, {_GROUP_R2} AS r2 FROM scored_p GROUP BY ALL) p JOIN (SELECT g AS symbol, {_GROUP_R2} AS r2 FROM scored_s GROUP BY ALL) s USING (symbol)", "feats", fr=_FR,
        rows=f"SELECT symbol, role, {', '.join(_HX)}, y_logvol FROM fr WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_HX, 'y_logvol'])}")
    # The pooled fit has one key for all rows; its test rows keep their symbol.
    pooled = part("1", "_p").replace("SELECT 1 AS g, role,", "SELECT 1 AS g, symbol AS s, role,").replace("scored_p AS (SELECT g, name,", "scored_p AS (SELECT s, g, name,")
    return whole.replace("\n/*fits*/", ",\n" + pooled + ",\n" + part("symbol", "_s") + "\n").replace("WITH ", "WITH RECURSIVE ", 1)


@query("h20_pooled_vs_single", _pooled_sql())
def _(spark, sf):
    return round_all(models.pooled_vs_single(_panel(spark, sf), _HX, "y_logvol"))


_R2 = "1 - sum((y - {0}) * (y - {0})) / (sum(y * y) - sum(y) * sum(y) / count(*))"


@query("h21_news_day_evaluation", sql(f"SELECT symbol, {r6(_R2.format('yhat_b'))} AS r2, COUNT(*) AS n FROM preds WHERE date IN (SELECT date FROM headlines) GROUP BY symbol", "preds", "headlines"))
def _(spark, sf):
    news = X.headlines(spark, sf).withColumn("market", F.lit("ALL"))
    days = calendar.trading_day_filter(X.predictions(spark, sf), news)
    return round_all(metrics.r2(days, BY, "y", "yhat_b").select("symbol", "r2", "n"))


@query("h22_sweep_curve", sql(f"SELECT event_id AS trial, {r6('value')} AS loss, {r6('min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS best_so_far, event_id + 1 IN (50, 100, 150) AS compared FROM candidates", "candidates"))
def _(spark, sf):
    curve = models.sweep_curve(X.candidates(spark, sf).select(F.col("event_id").alias("trial"), F.col("value").alias("loss")))
    return round_all(curve.withColumn("compared", (F.col("trial") + 1).isin(50, 100, 150)))


# Metrics.
@query("i1_r2", sql(f"SELECT symbol, fold, {r6(_R2.format('yhat_b'))} AS r2, {r6('1 - sum((exp(y) - exp(yhat_b)) * (exp(y) - exp(yhat_b))) / (sum(exp(y) * exp(y)) - sum(exp(y)) * sum(exp(y)) / count(*))', 5)} AS r2_raw, COUNT(*) AS n FROM preds GROUP BY ALL", "preds"))
def _(spark, sf):
    m = metrics.r2(X.predictions(spark, sf), ["symbol", "fold"], "y", "yhat_b")
    from ..functions.frames import rounded

    return m.select("symbol", F.col("fold").cast("long").alias("fold"), rounded(F.col("r2")).alias("r2"), rounded(F.col("r2_raw"), 5).alias("r2_raw"), "n")


@query("i2_rmse_corr", sql(f"SELECT symbol, model, {r6('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse, {r6('corr(y, yhat)')} AS corr FROM longp GROUP BY ALL", "longp"))
def _(spark, sf):
    return round_all(metrics.rmse_corr(X.long_predictions(spark, sf), ["symbol", "model"]))


_AUC = """SELECT {0}, (sum(CASE WHEN y_dir = 1 THEN rk END) - count(*) FILTER (y_dir = 1) * (count(*) FILTER (y_dir = 1) + 1) / 2.0) / (count(*) FILTER (y_dir = 1) * CAST(count(*) FILTER (y_dir = 0) AS DOUBLE)) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {0} ORDER BY p) + (count(*) OVER (PARTITION BY {0}, p) - 1) / 2.0 AS rk FROM preds) GROUP BY {0}"""


@query("i3_auc", sql(f"SELECT symbol, {r6('auc')} AS auc FROM a", "preds", a=_AUC.format("symbol")))
def _(spark, sf):
    return round_all(metrics.auc(X.predictions(spark, sf), BY, "y_dir", "p"))


_Q = "least(greatest(p, 1e-12), 1 - 1e-12)"


@query("i4_classification", sql(f"""SELECT symbol, {r6('avg(CAST((p >= 0.5) = (y_dir = 1) AS DOUBLE))')} AS accuracy,
{r6('2 * count(*) FILTER (p >= 0.5 AND y_dir = 1) / CAST(2 * count(*) FILTER (p >= 0.5 AND y_dir = 1) + count(*) FILTER (p >= 0.5 AND y_dir = 0) + count(*) FILTER (p < 0.5 AND y_dir = 1) AS DOUBLE)')} AS f1,
{r6('avg((p - y_dir) * (p - y_dir))')} AS brier, {r6(f'avg(-CASE WHEN y_dir = 1 THEN ln({_Q}) ELSE ln(1 - {_Q}) END)')} AS log_loss FROM preds GROUP BY symbol""", "preds"))
def _(spark, sf):
    return round_all(metrics.classification(X.predictions(spark, sf), BY, "y_dir", "p"))


_MSE = "SELECT symbol, model, avg((y - yhat) * (y - yhat)) AS mse FROM longp GROUP BY ALL"


@query("i5_mse_improvement", sql(f"SELECT a.symbol, a.model, {r6('1 - a.mse / b.mse')} AS improvement FROM m a JOIN m b ON a.symbol = b.symbol AND b.model = 'A' WHERE a.model <> 'A'", "longp", m=_MSE))
def _(spark, sf):
    return round_all(metrics.mse_improvement(X.long_predictions(spark, sf), BY, "A"))


_R2M = f"SELECT symbol, model, {_R2.format('yhat')} AS r2 FROM longp GROUP BY ALL"


@query("i6_metric_difference", sql(f"SELECT a.symbol, {r6('a.r2 - b.r2')} AS delta, {r6('a.r2 / b.r2')} AS ratio FROM m a JOIN m b ON a.symbol = b.symbol WHERE a.model = 'A' AND b.model = 'B'", "longp", m=_R2M))
def _(spark, sf):
    return round_all(metrics.difference(metrics.r2(X.long_predictions(spark, sf), ["symbol", "model"]), BY, "model", "A", "B", "r2"))


@query("i7_calibration_bins", sql(f"SELECT symbol, CAST(bin AS INTEGER) AS bin, {r6('avg(p)')} AS forecast, {r6('avg(CAST(y_dir AS DOUBLE))')} AS outcome, COUNT(*) AS n FROM (SELECT *, ntile(10) OVER (PARTITION BY symbol ORDER BY p, date) AS bin FROM preds) GROUP BY ALL", "preds"))
def _(spark, sf):
    return round_all(metrics.calibration_bins(X.predictions(spark, sf), BY, ["date"], 10, "y_dir", "p"))


@query("i7_cumulative_hits", sql(f"SELECT symbol, date, {r6('avg(CAST((p >= 0.5) = (y_dir = 1) AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS hit_rate FROM preds", "preds"))
def _(spark, sf):
    return round_all(metrics.cumulative_hits(X.predictions(spark, sf), BY, ["date"], "y_dir", "p").select("symbol", "date", "hit_rate"))


_FOLDS = f"SELECT symbol, model, fold, {_R2.format('yhat')} AS r2, stddev_samp(y) AS sd, max(y) - min(y) AS range, avg(y) AS level FROM longp GROUP BY ALL"


@query("i8_fold_summary", sql(f"SELECT symbol, model, {r6('avg(r2)')} AS mean, {r6('min(r2)')} AS min, {r6('max(r2)')} AS max, COUNT(r2) AS folds FROM f GROUP BY ALL", "longp", f=_FOLDS))
def _(spark, sf):
    return round_all(metrics.fold_summary(metrics.r2(X.long_predictions(spark, sf), ["symbol", "model", "fold"]), ["symbol", "model"], "r2"))


@query("i9_score_vs_volatility", sql(f"SELECT model, {r6('corr(r2, sd)')} AS corr_sd, {r6('corr(r2, range)')} AS corr_range, {r6('corr(r2, level)')} AS corr_level FROM f GROUP BY model", "longp", f=_FOLDS))
def _(spark, sf):
    df = X.long_predictions(spark, sf)
    by = ["symbol", "model", "fold"]
    stats = df.groupBy(*by).agg(F.stddev_samp("y").alias("sd"), (F.max("y") - F.min("y")).alias("range"), F.avg("y").alias("level"))
    return round_all(metrics.score_vs_volatility(metrics.r2(df, by).join(stats, by), ["model"], "r2", ["sd", "range", "level"]))


@query("i10_league_table", sql(f"SELECT symbol, model, {r6('r2')} AS r2, CAST(rank() OVER (PARTITION BY symbol ORDER BY r2 DESC) AS INTEGER) AS rank FROM m", "longp", m=_R2M))
def _(spark, sf):
    return round_all(metrics.league_table(metrics.r2(X.long_predictions(spark, sf), ["symbol", "model"]).select("symbol", "model", "r2"), BY, "model", "r2"))


@query("i11_inner_outer", sql(f"SELECT symbol, {r6('a.auc')} AS inner, {r6('b.auc')} AS outer, {r6('a.auc - b.auc')} AS drop FROM a JOIN b USING (symbol)".replace(" AS inner", ' AS "inner"').replace(" AS outer", ' AS "outer"').replace(" AS drop", ' AS "drop"'), "preds", a=_AUC.format("symbol").replace("FROM preds)", "FROM preds WHERE fold < 3)"), b=_AUC.format("symbol").replace("FROM preds)", "FROM preds WHERE fold >= 3)")))
def _(spark, sf):
    p = X.predictions(spark, sf)
    return round_all(metrics.inner_outer(metrics.auc(p.where("fold < 3"), BY, "y_dir", "p"), metrics.auc(p.where("fold >= 3"), BY, "y_dir", "p"), BY, "auc"))


@query("i12_error_correlation", sql(f"SELECT 'A' AS a, 'B' AS b, {r6('corr(y - yhat_a, y - yhat_b)')} AS corr FROM preds", "preds"))
def _(spark, sf):
    return round_all(metrics.error_correlation(X.long_predictions(spark, sf), ["symbol", "date"], ["A", "B"]))


# Inference.
P = inference.P


def _draws(reps: int, length: int) -> str:
    x = f"(48271 * (rep + 1) + 69621 * (blk + 1) + 42) % {P}"
    q = f"SELECT symbol, n, rep, blk, {x} AS x FROM (SELECT symbol, n, rep, unnest(range(CAST(ceil(n / {length}.0) AS BIGINT))) AS blk FROM (SELECT symbol, COUNT(*) AS n FROM preds GROUP BY symbol) CROSS JOIN range({reps}) AS r(rep))"
    for _ in range(4):
        q = f"SELECT symbol, n, rep, blk, (x * x + 48271 * x + 69621 * (blk + 1) + rep + 1) % {P} AS x FROM ({q})"
    return f"SELECT symbol, rep, x % (n - {length} + 1) AS start FROM ({q})"


_BLK = """SELECT symbol, row_number() OVER w - 1 AS start, sum((y - yhat_a) * (y - yhat_a)) OVER f AS sa, sum((y - yhat_b) * (y - yhat_b)) OVER f AS sb, sum(y) OVER f AS sy, sum(y * y) OVER f AS syy, count(*) OVER f AS k
FROM preds WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING)"""
_REP = "SELECT symbol, rep, 1 - sum(sa) / (sum(syy) - sum(sy) * sum(sy) / sum(k)) AS ra, 1 - sum(sb) / (sum(syy) - sum(sy) * sum(sy) / sum(k)) AS rb FROM draws JOIN blk USING (symbol, start) GROUP BY symbol, rep"
REPS, PAIRED = 5000, 10_000


@query("j1_block_bootstrap", sql(f"SELECT symbol, {r6('quantile_cont(rb, 0.025)', 5)} AS ci_lo, {r6('quantile_cont(rb, 0.975)', 5)} AS ci_hi, COUNT(*) AS reps FROM rep GROUP BY symbol", "preds", draws=_draws(REPS, 10), blk=_BLK.format(9), rep=_REP))
def _(spark, sf):
    return round_all(inference.bootstrap_r2(X.predictions(spark, sf), BY, ["date"], "y", "yhat_b", REPS), 5)


@query("j2_paired_bootstrap", sql(f"SELECT symbol, {r6('quantile_cont(ra - rb, 0.025)', 5)} AS ci_lo, {r6('quantile_cont(ra - rb, 0.975)', 5)} AS ci_hi, quantile_cont(ra - rb, 0.025) > 0 OR quantile_cont(ra - rb, 0.975) < 0 AS differs FROM rep GROUP BY symbol", "preds", draws=_draws(PAIRED, 10), blk=_BLK.format(9), rep=_REP))
def _(spark, sf):
    return round_all(inference.paired_bootstrap_r2(X.predictions(spark, sf), BY, ["date"], "yhat_a", "yhat_b", "y", PAIRED), 5)


_BAUC = """SELECT symbol, rep, sum(one * (2 * below + zero)) / 2.0 / (sum(one) * CAST(sum(zero) AS DOUBLE)) AS auc FROM (SELECT *, coalesce(sum(zero) OVER (PARTITION BY symbol, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT symbol, rep, p, sum(y_dir) AS one, sum(1 - y_dir) AS zero FROM (SELECT symbol, rep, unnest(range(start, start + 10)) AS place FROM draws) JOIN (SELECT symbol, y_dir, p, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS place FROM preds) USING (symbol, place) GROUP BY ALL)) GROUP BY symbol, rep"""


@query("j3_bootstrap_auc", sql(f"SELECT symbol, {r6('quantile_cont(auc, 0.025)', 5)} AS ci_lo, {r6('quantile_cont(auc, 0.975)', 5)} AS ci_hi, {r6('avg(CAST(auc <= 0.5 AS DOUBLE))', 5)} AS p_value FROM ba GROUP BY symbol", "preds", draws=_draws(REPS, 10), ba=_BAUC))
def _(spark, sf):
    return round_all(inference.bootstrap_auc(X.predictions(spark, sf), BY, ["date"], "y_dir", "p", REPS), 5)


#: A second forecast for the paired test: half of the first, half of the one of the day before.
_P2 = "SELECT *, round((p + coalesce(lag(p) OVER (PARTITION BY symbol ORDER BY date), p)) / 2, 3) AS p2 FROM preds"
_REPS_AUC = PAIRED


@query("j2_paired_bootstrap_auc", sql(f"SELECT symbol, {r6('quantile_cont(a.auc - b.auc, 0.025)', 5)} AS ci_lo, {r6('quantile_cont(a.auc - b.auc, 0.975)', 5)} AS ci_hi, quantile_cont(a.auc - b.auc, 0.025) > 0 OR quantile_cont(a.auc - b.auc, 0.975) < 0 AS differs FROM ba a JOIN bb b USING (symbol, rep) GROUP BY symbol",
    "preds", p2=_P2, draws=_draws(_REPS_AUC, 10), ba=_BAUC, bb=_BAUC.replace("SELECT symbol, y_dir, p, row_number()", "SELECT symbol, y_dir, p2 AS p, row_number()").replace("FROM preds)", "FROM p2)")))
def _(spark, sf):
    from pyspark.sql import Window

    d = X.predictions(spark, sf)
    d = d.withColumn("p2", F.round((F.col("p") + F.coalesce(F.lag("p").over(Window.partitionBy("market", "symbol").orderBy("date")), F.col("p"))) / 2, 3))
    return round_all(inference.paired_bootstrap_auc(d, BY, ["date"], "p", "p2", "y_dir", _REPS_AUC), 5)


_PT = "2 * exp(-abs(dm) * abs(dm) / 2) / sqrt(6.283185307179586) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"
_DMC = "SELECT symbol, date, dd, dd - avg(dd) OVER (PARTITION BY symbol) AS c, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, date, (y - yhat_a) * (y - yhat_a) - (y - yhat_b) * (y - yhat_b) AS dd FROM preds)"
_DMW = lambda width: f"SELECT *, {width} AS bw FROM (SELECT symbol, avg(dd) AS mean_diff, sum(c * c) AS v, COUNT(*) AS n FROM dmc GROUP BY symbol)"
_DML = "SELECT symbol, sum(2 * (1 - lag / (bw + 1.0)) * g) AS w FROM (SELECT a.symbol, bw, lag, sum(a.c * b.c) AS g FROM dmc a JOIN dmw USING (symbol) JOIN (SELECT unnest(range(1, 1000)) AS lag) ON lag <= bw JOIN dmc b ON a.symbol = b.symbol AND b.i = a.i - lag GROUP BY ALL) GROUP BY symbol"
_DMS = "SELECT s.symbol, s.mean_diff, s.n, (s.v + coalesce(l.w, 0)) / s.n AS lrv FROM dmw s LEFT JOIN dml l USING (symbol)"
_CUBE = "ceil(pow(n, 1 / 3.0))"


def _dm(factor: str) -> str:
    return f"SELECT *, 1 / (1 + 0.2316419 * abs(dm)) AS t FROM (SELECT *, mean_diff / sqrt(lrv / n){factor} AS dm FROM dms)"


_DMOUT = f"SELECT symbol, {r6('dm', 5)} AS dm, {r6(_PT, 5)} AS p_value, n FROM o"


@query("j4_diebold_mariano", sql(_DMOUT, "preds", dmc=_DMC, dmw=_DMW(_CUBE), dml=_DML, dms=_DMS, o=_dm("")))
def _(spark, sf):
    p = X.predictions(spark, sf)
    e1, e2 = F.col("y") - F.col("yhat_a"), F.col("y") - F.col("yhat_b")
    return round_all(inference.diebold_mariano(p, BY, ["date"], e1, e2).select("symbol", "dm", "p_value", "n"), 5)


@query("j5_small_sample_factor", sql(_DMOUT, "preds", dmc=_DMC, dmw=_DMW("5"), dml=_DML, dms=_DMS, o=_dm(" * sqrt((n + 1 - 10 + 20.0 / n) / n)")))
def _(spark, sf):
    p = X.predictions(spark, sf)
    e1, e2 = F.col("y") - F.col("yhat_a"), F.col("y") - F.col("yhat_b")
    return round_all(inference.diebold_mariano(p, BY, ["date"], e1, e2, h=5, bandwidth=5, hln=True).select("symbol", "dm", "p_value", "n"), 5)


_TESTS = "SELECT symbol, fold, CAST((row_number() OVER (ORDER BY symbol, fold) * 7919) % 997 AS DOUBLE) / 20000 AS p_value FROM (SELECT DISTINCT symbol, fold FROM preds)"


def _tests(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    t = X.predictions(spark, sf).select("symbol", "fold").distinct()
    return t.withColumn("p_value", ((F.row_number().over(Window.orderBy("symbol", "fold")) * 7919) % 997).cast("double") / 20000)


_ADJ = """SELECT symbol, fold, p_value, least(1.0, p_value * m) AS p_bonferroni, least(1.0, max(p_value * (m - i + 1)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm,
least(1.0, min(p_value * m / i) OVER (PARTITION BY symbol ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p_value, fold) AS i, COUNT(*) OVER (PARTITION BY symbol) AS m FROM tests)"""
for _n, _c in {"j6_holm": "p_holm", "j7_bonferroni": "p_bonferroni", "j8_bh_fdr": "p_bh"}.items():
    query(_n, sql(f"SELECT symbol, CAST(fold AS BIGINT) AS fold, {r6('p_value')} AS p_value, {r6(_c)} AS {_c} FROM adj", "preds", tests=_TESTS, adj=_ADJ))(
        lambda spark, sf, c=_c: round_all(inference.adjust(_tests(spark, sf), BY, order=("fold",)).select("symbol", F.col("fold").cast("long").alias("fold"), "p_value", c))
    )
#: The last is twice the longest horizon, 20 days.
_LENGTHS = (5, 10, 15, 20, 40)


@query("j9_block_length", " UNION ALL ".join(f"SELECT * FROM ({sql(f'''SELECT symbol, {n} AS length, {r6('quantile_cont(rb, 0.025)', 5)} AS ci_lo, {r6('quantile_cont(rb, 0.975)', 5)} AS ci_hi FROM rep GROUP BY symbol''', 'preds', draws=_draws(REPS, n), blk=_BLK.format(n - 1), rep=_REP)})" for n in _LENGTHS))
def _(spark, sf):
    r = inference.bootstrap_r2_lengths(X.predictions(spark, sf), BY, ["date"], "y", "yhat_b", REPS, _LENGTHS)
    return round_all(r, 5).select("symbol", F.col("block_length").alias("length"), "ci_lo", "ci_hi")


#: The forecast's interval, and its gain over two baselines: low volatility today, low volatility this week.
_VERDICT = """SELECT symbol, CASE WHEN ci_lo > 0.5 AND a.auc - b.auc > 0 AND a.auc - c.auc > 0 THEN 'improved' WHEN ci_lo > 0.5 THEN 'significant' ELSE 'none' END AS verdict,
{0} AS ci_lo, {1} AS gain_day, {2} AS gain_week FROM (SELECT symbol, quantile_cont(auc, 0.025) AS ci_lo FROM ba GROUP BY symbol) JOIN a USING (symbol) JOIN b USING (symbol) JOIN c USING (symbol)"""


def _auc_of(e: str) -> str:
    return _AUC.format("symbol").replace("FROM preds)", f"FROM (SELECT * REPLACE ({e} AS p) FROM preds))")


@query("j10_verdict", sql(_VERDICT.format(r6("ci_lo", 5), r6("a.auc - b.auc"), r6("a.auc - c.auc")), "preds", draws=_draws(REPS, 10), ba=_BAUC, a=_AUC.format("symbol"), b=_auc_of("-yhat_a"), c=_auc_of("-yhat_b")))
def _(spark, sf):
    from ..functions.frames import rounded

    d = X.predictions(spark, sf)
    score = lambda e, out: metrics.auc(d.withColumn("p", e), BY, "y_dir", "p").withColumnRenamed("auc", out)
    rows = inference.bootstrap_auc(d, BY, ["date"], "y_dir", "p", REPS).join(score(F.col("p"), "auc"), BY).join(score(-F.col("yhat_a"), "auc_day"), BY).join(score(-F.col("yhat_b"), "auc_week"), BY)
    rows = rows.withColumns({"gain_day": F.col("auc") - F.col("auc_day"), "gain_week": F.col("auc") - F.col("auc_week")})
    return inference.verdict(rows, "ci_lo", ("gain_day", "gain_week")).select("symbol", "verdict", rounded(F.col("ci_lo"), 5).alias("ci_lo"), rounded(F.col("gain_day")).alias("gain_day"), rounded(F.col("gain_week")).alias("gain_week"))


@query("j11_jarque_bera", sql(f"SELECT symbol, {r6('s')} AS skewness, {r6('k')} AS kurtosis, {r6('n / 6.0 * (s * s + k * k / 4)', 3)} AS jarque_bera FROM (SELECT symbol, count(ret) AS n, avg(pow(ret - m, 3)) / pow(var_pop(ret), 1.5) AS s, avg(pow(ret - m, 4)) / pow(var_pop(ret), 2) - 3 AS k FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m FROM rets) GROUP BY symbol)", "rets"))
def _(spark, sf):
    from ..functions.frames import rounded

    return inference.moments(X.returns(spark, sf), BY, "ret").select("symbol", rounded(F.col("skewness")).alias("skewness"), rounded(F.col("kurtosis")).alias("kurtosis"), rounded(F.col("jarque_bera"), 3).alias("jarque_bera"))


@query("j12_adf", sql(f"""SELECT symbol, {r6('b', 5)} AS b, {r6('b / sqrt((dd - b * xd - g * zd) * n / (n - 3) * zz / det / n)', 4)} AS adf, n FROM (SELECT *, (xd * zz - zd * xz) / det AS b, (zd * xx - xd * xz) / det AS g FROM (SELECT *, xx * zz - xz * xz AS det FROM (
SELECT symbol, COUNT(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, d) AS xd, covar_pop(z, d) AS zd, covar_pop(d, d) AS dd FROM (SELECT *, lag(d) OVER ({WO}) AS z FROM (SELECT *, lag(close) OVER ({WO}) AS x, close - lag(close) OVER ({WO}) AS d FROM prices)) WHERE d IS NOT NULL AND z IS NOT NULL GROUP BY symbol)))""", "prices"))
def _(spark, sf):
    from ..functions.frames import rounded

    return inference.adf(X.prices(spark, sf), BY, "close").select("symbol", rounded(F.col("b"), 5).alias("b"), rounded(F.col("adf"), 4).alias("adf"), "n")


def _vif_sql(xs: list[str]) -> str:
    """Diagonal of the inverse correlation matrix: elimination of the matrix beside the identity."""
    n = len(xs)
    whole = sql(f"/*fits*/SELECT ['{"', '".join(xs)}'][i] AS feature, {r6('m[i][' + str(n) + ' + i]', 5)} AS vif FROM (SELECT m, unnest(range(1, {n + 1})) AS i FROM inverse WHERE k = {n + 1})", "feats", fr=_FR,
        rows=f"SELECT [{', '.join(xs)}]::DOUBLE[] AS f FROM fr WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*xs, 'har_1', 'har_5', 'har_22', 'y_logvol', 'y_dir', 'rv5_past', 'vol_5'])}",
        start=f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list_concat(list(v ORDER BY j), list_transform(range(1, {n + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END)) AS r FROM (SELECT i, j, corr(f[i], f[j]) AS v FROM rows CROSS JOIN range(1, {n + 1}) AS a(i) CROSS JOIN range(1, {n + 1}) AS b(j) GROUP BY ALL) GROUP BY i)")
    return whole.replace("\n/*fits*/", ",\n" + linear_sql.elimination("inverse", "start") + "\n").replace("WITH ", "WITH RECURSIVE ", 1)


@query("j13_vif", _vif_sql(AR))
def _(spark, sf):
    return round_all(inference.vif(_ar(spark, sf), AR), 5)


@query("j14_autocorrelation", " UNION ALL ".join(f"SELECT * FROM ({sql(f'SELECT symbol, {k} AS lag, {r6('corr(absret, x)')} AS acf FROM (SELECT *, lag(absret, {k}) OVER ({WO}) AS x FROM rets) GROUP BY symbol', 'rets')})" for k in range(1, 6)))
def _(spark, sf):
    return round_all(inference.autocorrelation(X.returns(spark, sf), BY, "absret", 5))


# Checks.
@query("k1_equality", sql("SELECT (SELECT COUNT(*) FROM (SELECT symbol, date FROM prices EXCEPT ALL SELECT symbol, date FROM prices WHERE volume > 1)) AS only_a, CAST(0 AS BIGINT) AS only_b", "prices"))
def _(spark, sf):
    p = X.prices(spark, sf)
    # Compared by symbol: a symbol without a lone volume has equal digests, and its rows are not read again.
    return checks.equality(p.select("symbol", "date"), p.where("volume > 1").select("symbol", "date"), ["symbol"])


@query("k2_unchanged", sql("SELECT 'close' AS \"column\", CAST(0 AS BIGINT) AS changed UNION ALL SELECT 'volume', COUNT(*) FILTER (volume > 3) FROM prices", "prices"))
def _(spark, sf):
    p = X.prices(spark, sf)
    return checks.unchanged(p, p.withColumn("volume", F.least("volume", F.lit(3))), ["market", "symbol", "date"], ["close", "volume"])


@query("k3_largest_difference", sql(f"SELECT 'close' AS \"column\", {r6('max(abs(a.close - b.close))')} AS max_abs_diff, COUNT(*) FILTER (a.symbol IS NULL OR b.symbol IS NULL) AS unmatched FROM prices a FULL JOIN (SELECT market, symbol, date, close * 1.001 AS close FROM prices WHERE volume > 1) b ON a.symbol = b.symbol AND a.date = b.date", "prices"))
def _(spark, sf):
    p = X.prices(spark, sf)
    return round_all(checks.largest_difference(p, p.where("volume > 1").withColumn("close", F.col("close") * 1.001), ["market", "symbol", "date"], ["close"]))


@query("k4_claims", sql("SELECT symbol, claim, value, CASE WHEN value IS NULL THEN 'missing' WHEN abs(round(value, 3) - claim) < 0.0005 THEN 'ok' ELSE 'differs' END AS verdict FROM (SELECT symbol, CAST(0.5 AS DOUBLE) AS claim, round(avg(y_dir), 6) AS value FROM preds GROUP BY symbol UNION ALL SELECT 'none', 0.1, NULL)", "preds"))
def _(spark, sf):
    computed = X.predictions(spark, sf).groupBy("symbol").agg(F.round(F.avg("y_dir"), 6).alias("value"))
    claimed = computed.select("symbol", F.lit(0.5).alias("claim")).unionByName(spark.range(1).select(F.lit("none").alias("symbol"), F.lit(0.1).alias("claim")))
    return checks.claims(claimed, computed, BY).select("symbol", "claim", "value", "verdict")


@query("k5_profile", sql(f"SELECT 'ret' AS \"column\", COUNT(*) AS n, {r6('avg(CAST(ret IS NULL AS DOUBLE))')} AS null_share, {r6('avg(ret)')} AS mean, {r6('stddev_samp(ret)')} AS sd, {r6('quantile_cont(ret, 0.5)')} AS p50 FROM rets UNION ALL SELECT 'close', COUNT(*), 0.0, {r6('avg(close)', 3)}, {r6('stddev_samp(close)', 3)}, {r6('quantile_cont(close, 0.5)', 3)} FROM rets", "rets"))
def _(spark, sf):
    from ..functions.frames import rounded

    p = checks.profile(X.returns(spark, sf), ["ret", "close"])
    d = {c: F.when(F.col("column") == "close", rounded(F.col(c), 3)).otherwise(rounded(F.col(c))) for c in ("mean", "sd", "p50")}
    return p.withColumns(d | {"null_share": rounded(F.col("null_share"))})


@query("k7_return_correlation", sql(f"SELECT {r6('corr(a.ret, b.ret)')} AS corr, COUNT(*) AS n FROM rets a JOIN rets b ON a.date = b.date WHERE a.symbol = '5-LOW' AND b.symbol = '2-HIGH'", "rets"))
def _(spark, sf):
    r = X.returns(spark, sf)
    return round_all(checks.return_correlation(r.where("symbol = '5-LOW'"), r.where("symbol = '2-HIGH'"), ["market", "date"]))


def flagship(spark, sf) -> DataFrame:
    """HAR volatility forecasts out of sample, scored by symbol: prices to returns to features to a fit and its R2."""
    df = splits.chrono_split(targets.log_vol(features.har_components(features.returns(X.prices(spark, sf)))))
    return metrics.r2(models.har_rv(df, list(KEYS)), list(KEYS), "y_logvol", "yhat")


@query("flagship_har_r2", sql(f"""SELECT market, symbol, {r6('1 - sum((y_logvol - yhat) * (y_logvol - yhat)) / (sum(y_logvol * y_logvol) - sum(y_logvol) * sum(y_logvol) / count(*))', 5)} AS r2, COUNT(*) AS n
FROM (SELECT market, fr.symbol, y_logvol, my + b1 * (har_1 - m1) + b2 * (har_5 - m2) + b3 * (har_22 - m3) AS yhat FROM fr JOIN hb USING (symbol) WHERE role = 'test') WHERE y_logvol IS NOT NULL AND yhat IS NOT NULL GROUP BY market, symbol""", "feats",
    fr="SELECT *, CASE WHEN i <= floor(n * CAST(0.70 AS DOUBLE)) THEN 'train' WHEN i <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS role FROM (SELECT *, COUNT(*) OVER (PARTITION BY market, symbol) AS n, row_number() OVER (PARTITION BY market, symbol ORDER BY date) AS i FROM feats)", har=_HAR, hb=_HB))
def _(spark, sf):
    from ..functions.frames import rounded

    f = flagship(spark, sf)
    return f.select("market", "symbol", rounded(F.col("r2"), 5).alias("r2"), "n")


_C5 = X.VIEWS["sent"].replace("SELECT market, date, COUNT(*)", "SELECT day, topic, COUNT(*)").replace("GROUP BY market, date", "GROUP BY day, topic")
_C5_COLUMNS = ("sent_pos_mean", "sent_neg_mean", "sent_neu_mean", "sent_score_mean", "sent_score_std", "sent_max_neg", "sent_pos_ratio", "sent_neg_ratio")


@query("x1_daily_news_stream", sql(f"SELECT day, topic, news_volume, {', '.join(f'{r6(c)} AS {c}' for c in _C5_COLUMNS)} FROM c5 WHERE day < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM events)",
    scores=X.VIEWS["scores"].replace("'ALL' AS market, CAST(ts AS DATE) AS date", "event_type AS topic, CAST(ts AS DATE) AS day"), c5=_C5))
def _(spark, sf):
    from ..streaming.daily_news import upsert

    e = spark.readStream.schema(X.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    k = F.col("event_id") % 100
    pos, neg = (k + 1).cast("double") / 150.0, (100 - k).cast("double") / 300.0
    rows = e.select("ts", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("url"), F.col("event_type").alias("topic"), F.lit("").alias("headline"), pos.alias("pos"), neg.alias("neg"), (1.0 - pos - neg).alias("neu"))
    path = X.scratch(spark, "stream")
    upsert(rows, f"{path}/out", f"{path}/check").awaitTermination()
    return round_all(spark.read.parquet(f"{path}/out").select(F.col("day").cast("date").alias("day"), "topic", "news_volume", *_C5_COLUMNS))
