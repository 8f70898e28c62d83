"""Queries of sources, features, targets and splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, targets
from ..functions.frames import rounded
from ..functions.metrics import round_all
from ..operators import calendar, splits
from ..sources import io
from . import fixtures as X
from .fixtures import WD, WO, r6, roll, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ["symbol", "date"]


def add(name: str, fn, oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    def keep(fn):
        add(name, fn, oracle)
        return fn

    return keep


def _columns(name: str, make, view: str, cols: list[str], ints: tuple[str, ...] = ()) -> None:
    """A query of some columns of the panel, computed by `make` from prices and no more, and its SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return round_all(make(X.prices(spark, sf)).select(*KEY, *cols))

    add(name, run, sql(f"SELECT symbol, date, {', '.join(c if c in ints else f'{r6(c)} AS {c}' for c in cols)} FROM {view}", view))


R = features.returns
_columns("e1_ret", R, "rets", ["ret"])
_columns("e2_absret", R, "rets", ["absret"])
_columns("e3_ret_lags", lambda p: features.lags(R(p), "ret", 5), "feats", [f"ret_lag{i}" for i in range(1, 6)])
_columns("e4_absret_lags", lambda p: features.lags(R(p), "absret", 3), "feats", [f"absret_lag{i}" for i in range(1, 4)])
_columns("e5_rolling_std", lambda p: features.rolling_std(R(p)), "feats", ["rolling_std_5", "rolling_std_20", "rolling_std_22"])
_columns("e6_har_components", lambda p: features.har_components(R(p)), "feats", ["har_1", "har_5", "har_20", "har_22"])
_columns("e7_leverage", lambda p: features.leverage(R(p)), "feats", ["leverage_5d", "leverage_20d"])
_columns("e8_rsi", lambda p: features.rsi(R(p)), "feats", ["rsi_14"])
_columns("e10_vol_ratio", lambda p: features.vol_ratio(features.rolling_std(R(p))), "feats", ["vol_ratio_5_20"])
_columns("e11_absret_surprise", lambda p: features.absret_surprise(R(p)), "feats", ["absret_surprise"])
_columns("e12_day_of_week", features.day_of_week, "feats", ["dow", "dow_0", "dow_1", "dow_2", "dow_3", "dow_4"], ("dow", "dow_0", "dow_1", "dow_2", "dow_3", "dow_4"))
_columns("e13_rolling_returns", lambda p: features.rolling_returns(R(p)), "feats", ["rolling_ret_5d", "rolling_ret_20d", "rolling_absret"])
_columns("e22_rv5_past", lambda p: features.realised_vol(R(p)), "feats", ["rv5_past"])
_columns("f1_log_vol", lambda p: targets.log_vol(R(p)), "feats", ["y_logvol"])
_columns("f2_next_absret", lambda p: targets.next_day(R(p)), "feats", ["y_absret"])
_columns("f3_next_direction", lambda p: targets.next_day(R(p)), "feats", ["y_dir"], ("y_dir",))
_columns("f4_next_return", lambda p: targets.next_day(R(p)), "feats", ["y_ret"])
_columns("f5_direction_h", lambda p: targets.direction(R(p)), "feats", ["dir_1", "dir_5", "dir_20"], ("dir_1", "dir_5", "dir_20"))
_columns("f6_volatility_h", lambda p: targets.volatility(R(p)), "feats", ["vol_1", "vol_5"])


@query("a1_read_prices", sql(f"SELECT market, symbol, date, {r6('close')} AS close, volume FROM prices", "prices"))
def _(spark, sf):
    path = X.scratch(spark, "prices")
    io.write_table(X.prices(spark, sf), path, io.PRICES)
    return round_all(io.read_prices(spark, path).select("market", "symbol", "date", "close", "volume"))


@query("a2_read_indicators", sql(f"SELECT market, date, code, {r6('value')} AS value FROM indicators", "indicators"))
def _(spark, sf):
    path = X.scratch(spark, "indicators")
    io.write_table(X.indicators(spark, sf), path, io.INDICATORS)
    return round_all(io.read_indicators(spark, path))


@query("a3_read_headlines", sql("SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, date, headline, section AS source FROM headlines", "headlines"))
def _(spark, sf):
    path = X.scratch(spark, "headlines")
    rows = X.headlines(spark, sf).select(F.year("date").alias("year"), F.month("date").alias("month"), "date", "headline", F.col("section").alias("source"))
    io.write_table(rows, path, io.HEADLINES, "csv")
    return io.read_headlines(spark, path, multiline=True)


@query("e9_sign_run", sql("""SELECT symbol, date, CASE WHEN ret IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY market, symbol, island ORDER BY date) AS INTEGER) END AS sign_run
FROM (SELECT *, SUM(isnew) OVER (PARTITION BY market, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
FROM (SELECT *, CAST(lag(sign(ret)) OVER (PARTITION BY market, symbol ORDER BY date) IS DISTINCT FROM sign(ret) AS INTEGER) AS isnew FROM rets))""", "rets"))
def _(spark, sf):
    return features.sign_run(X.returns(spark, sf)).select(*KEY, "sign_run")


@query("e14_vix_changes", sql(f"SELECT date, {r6('A_F / lag(A_F, 5) OVER w - 1')} AS vix_chg_5d, {r6('A_F / (' + roll('avg(A_F)', 'A_F', 5, w=WD) + ')')} AS vix_ma5_ratio FROM wide WINDOW w AS ({WD})", "wide"))
def _(spark, sf):
    return round_all(features.implied_vol_features(X.wide(spark, sf), "A_F").select("date", "vix_chg_5d", "vix_ma5_ratio"))


@query("e15_vrp", sql(f"SELECT symbol, date, {r6('ln(A_F / 100 / sqrt(252.0)) - rv5_past')} AS vrp FROM feats JOIN wide USING (market, date)", "feats", "wide"))
def _(spark, sf):
    df = features.realised_vol(X.returns(spark, sf)).join(X.wide(spark, sf), ["market", "date"])
    return round_all(features.variance_risk_premium(df, "A_F").select(*KEY, "vrp"))


NAMES = {"vix9d": "A_O", "vix": "A_F", "vvix": "N_F", "hyg": "N_O", "lqd": "R_F", "y30": "R_O", "y5": "A_F", "tlt": "N_O", "uup": "R_F"}
_EXT = f"""SELECT date, ln(A_O / A_F) AS vix_term, ln(N_F) - {roll('avg(ln(N_F))', 'N_F', 20, w=WD)} AS vvix_dev, ln(N_O / R_F) - lag(ln(N_O / R_F), 5) OVER ({WD}) AS credit_5d,
 R_O - A_F AS slope, (R_O - A_F) - lag(R_O - A_F, 5) OVER ({WD}) AS slope_5d, ln(N_O) - lag(ln(N_O), 5) OVER ({WD}) AS tlt_5d, ln(R_F) - lag(ln(R_F), 5) OVER ({WD}) AS uup_5d, market FROM wide"""
for _name, _cols in {"e17_vix_term": ["vix_term"], "e18_vvix_dev": ["vvix_dev"], "e19_credit_5d": ["credit_5d"], "e20_slope": ["slope", "slope_5d"], "e21_tlt_uup_5d": ["tlt_5d", "uup_5d"]}.items():
    add(_name, lambda spark, sf, c=_cols: round_all(features.extended_financial(X.wide(spark, sf), NAMES).select("date", *c)), sql(f"SELECT date, {', '.join(f'{r6(c)} AS {c}' for c in _cols)} FROM ext", "wide", ext=_EXT))
_ALL = ["vix_term", "vvix_dev", "credit_5d", "slope_5d", "tlt_5d", "uup_5d"]


@query("e23_fin_ext_lagged", sql(f"SELECT date, {', '.join(f'{r6(f'lag({c}) OVER ({WD})')} AS {c}' for c in _ALL)} FROM ext", "wide", ext=_EXT))
def _(spark, sf):
    df = features.extended_financial(X.wide(spark, sf), NAMES)
    return round_all(features.lag_exogenous(df, _ALL, 1, ("market",)).select("date", *_ALL))


@query("f7_differenced_target", sql(f"SELECT symbol, date, {r6('vol_5 - rv5_past')} AS d_vol_5 FROM feats", "feats"))
def _(spark, sf):
    return round_all(targets.differenced(targets.volatility(features.realised_vol(X.returns(spark, sf)))).select(*KEY, "d_vol_5"))


@query("f8_contemporaneous", sql(f"""SELECT symbol, 'absret' AS feature, {r6('pow(corr(ret, absret), 2)')} AS r2_same, {r6('pow(corr(ret, lagged), 2)')} AS r2_strict
FROM (SELECT *, lag(absret) OVER ({WO}) AS lagged FROM rets) GROUP BY symbol""", "rets"))
def _(spark, sf):
    return round_all(targets.contemporaneous(X.returns(spark, sf), ["absret"]).drop("market"))


@query("f9_alternative_series", sql(f"SELECT date, {r6('y_logvol')} AS y_logvol FROM feats WHERE symbol = '5-LOW'", "feats"))
def _(spark, sf):
    return round_all(targets.log_vol(R(X.prices(spark, sf).where("symbol = '5-LOW'"))).select("date", "y_logvol"))


@query("f10_base_rate", sql(f"SELECT symbol, {r6('avg(y_dir)')} AS base_rate, {r6('greatest(avg(y_dir), 1 - avg(y_dir))')} AS majority FROM feats WHERE y_dir IS NOT NULL GROUP BY symbol", "feats"))
def _(spark, sf):
    return round_all(targets.base_rate(targets.next_day(X.returns(spark, sf))).drop("market"))


@query("f11_effective_sample", sql("SELECT symbol, COUNT(dir_5) AS n, CAST(floor(COUNT(dir_5) / 5) AS BIGINT) AS n_effective FROM feats GROUP BY symbol", "feats"))
def _(spark, sf):
    return targets.effective_sample(targets.direction(X.returns(spark, sf)), "dir_5", 5).drop("market")


# Splits.
_N = "SELECT *, COUNT(*) OVER (PARTITION BY market, symbol) AS n, row_number() OVER (PARTITION BY market, symbol ORDER BY date) AS i FROM prices"


@query("g1_chrono_split", sql("SELECT symbol, date, CASE WHEN i <= floor(n * CAST(0.70 AS DOUBLE)) THEN 'train' WHEN i <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS role FROM numbered", "prices", numbered=_N))
def _(spark, sf):
    return splits.chrono_split(X.prices(spark, sf)).select(*KEY, "role")


@query("g2_cutoff_split", sql("SELECT symbol, date, CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-06-01' THEN 'valid' ELSE 'test' END AS role FROM prices", "prices"))
def _(spark, sf):
    return splits.cutoff_split(X.prices(spark, sf), "1999-01-01", "2000-06-01").select(*KEY, "role")


_WF = """SELECT market, symbol, date, CAST(k AS INTEGER) AS fold, CASE WHEN i <= floor(n * (CAST(0.40 AS DOUBLE) + k * CAST(0.12 AS DOUBLE)) + 1e-9) THEN 'train' WHEN i <= floor(n * (CAST(0.40 AS DOUBLE) + (k + 1) * CAST(0.12 AS DOUBLE)) + 1e-9) THEN 'test' END AS role
FROM numbered CROSS JOIN range(5) AS r(k)"""


@query("g3_walk_forward", sql("SELECT symbol, date, fold, role FROM wf WHERE role IS NOT NULL", "prices", numbered=_N, wf=_WF))
def _(spark, sf):
    return splits.walk_forward(X.prices(spark, sf)).select(*KEY, "fold", "role")


_DQ = """SELECT CAST(fold AS INTEGER) AS fold, min(date) AS test_start, max(date) AS test_end FROM (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS fold
FROM (SELECT date, percent_rank() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM prices)) WHERE r >= 0.35) GROUP BY fold"""


@query("g4_date_quantile_folds", sql("SELECT symbol, date, fold, CASE WHEN date < test_start THEN 'train' ELSE 'test' END AS role FROM prices CROSS JOIN folds WHERE date <= test_end", "prices", folds=_DQ))
def _(spark, sf):
    p = X.prices(spark, sf)
    return splits.assign_folds(p, splits.date_quantile_folds(p)).select(*KEY, "fold", "role")


@query("g5_embargo", sql("""SELECT symbol, date, fold, role FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol, fold, role ORDER BY date DESC) AS b FROM wf WHERE role IS NOT NULL)
WHERE role <> 'train' OR b > 10""", "prices", numbered=_N, wf=_WF))
def _(spark, sf):
    return splits.embargo(splits.walk_forward(X.prices(spark, sf))).select(*KEY, "fold", "role")


def _expand(source: str, part: str, blocks: int) -> str:
    step = f"(CAST(0.5 AS DOUBLE) / {blocks})"
    return f"""SELECT *, CASE WHEN i2 <= floor(n2 * (CAST(0.5 AS DOUBLE) + k * {step}) + 1e-9) THEN 'train' WHEN i2 <= floor(n2 * (CAST(0.5 AS DOUBLE) + (k + 1) * {step}) + 1e-9) THEN 'test' END AS r2
    FROM (SELECT *, COUNT(*) OVER (PARTITION BY {part}) AS n2, row_number() OVER (PARTITION BY {part} ORDER BY date) AS i2 FROM {source}) CROSS JOIN range({blocks}) AS r(k)"""


@query("g6_inner_folds", sql("SELECT symbol, date, fold, CAST(k AS INTEGER) AS inner_fold, r2 AS inner_role FROM ex WHERE r2 IS NOT NULL", "prices", numbered=_N, wf=_WF, tr="SELECT * FROM wf WHERE role = 'train'", ex=_expand("tr", "market, symbol, fold", 3)))
def _(spark, sf):
    return splits.inner_folds(splits.walk_forward(X.prices(spark, sf))).select(*KEY, "fold", "inner_fold", "inner_role")


@query("g7_pretest_blocks", sql("SELECT symbol, date, CAST(k AS INTEGER) AS fold, r2 AS role FROM ex WHERE r2 IS NOT NULL", "prices", pre="SELECT * FROM prices WHERE date < DATE '2000-06-01'", ex=_expand("pre", "market, symbol", 5)))
def _(spark, sf):
    return splits.pretest_blocks(X.prices(spark, sf), "2000-06-01").select(*KEY, "fold", "role")


@query("g8_expanding_oof", sql("""SELECT symbol, date, CAST(k AS INTEGER) AS fold, CASE WHEN s = k THEN 'test' ELSE 'train' END AS role
FROM (SELECT *, ntile(5) OVER (PARTITION BY market, symbol ORDER BY date) - 1 AS s FROM prices) JOIN range(1, 5) AS r(k) ON k >= s""", "prices"))
def _(spark, sf):
    return splits.expanding_oof(X.prices(spark, sf)).select(*KEY, "fold", "role")


@query("g9_unshuffled_kfold", sql("SELECT symbol, date, CAST(ntile(5) OVER (PARTITION BY market, symbol ORDER BY date) - 1 AS INTEGER) AS fold FROM prices", "prices"))
def _(spark, sf):
    return splits.unshuffled_kfold(X.prices(spark, sf)).select(*KEY, "fold")


@query("g10_scaler", sql(f"""SELECT symbol, date, fold, role, {r6('(close - m) / s')} AS close FROM wf JOIN prices USING (market, symbol, date)
JOIN (SELECT fold, avg(close) AS m, stddev_pop(close) AS s FROM wf JOIN prices USING (market, symbol, date) WHERE role = 'train' GROUP BY fold) USING (fold) WHERE role IS NOT NULL""", "prices", numbered=_N, wf=_WF))
def _(spark, sf):
    return round_all(splits.scaled(splits.walk_forward(X.prices(spark, sf)), ["close"]).select(*KEY, "fold", "role", "close"))


@query("g11_rank_scaler", sql(f"""SELECT symbol, date, {r6('count(k) OVER (PARTITION BY market, symbol ORDER BY close RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(k) OVER (PARTITION BY market, symbol) AS DOUBLE)')} AS close_rank
FROM (SELECT *, CASE WHEN date < DATE '1999-01-01' THEN 1 END AS k FROM prices)""", "prices"))
def _(spark, sf):
    return round_all(splits.rank_scaled(splits.cutoff_split(X.prices(spark, sf), "1999-01-01", "2000-06-01"), "close").select(*KEY, "close_rank"))


# Calendar and alignment.
_CAL = "SELECT DISTINCT market, date FROM prices"
_NEWS = "SELECT headline_id, 'ALL' AS market, date FROM headlines"


def _news(spark, sf) -> DataFrame:
    return X.headlines(spark, sf).select("headline_id", F.lit("ALL").alias("market"), "date", "headline")


@query("d1_trading_day_filter", sql("SELECT headline_id, n.date FROM news n SEMI JOIN cal USING (market, date)", "prices", "headlines", news=_NEWS, cal=_CAL))
def _(spark, sf):
    return calendar.trading_day_filter(_news(spark, sf), X.prices(spark, sf)).select("headline_id", "date")


_ROLL = "SELECT n.*, (SELECT min(date) FROM cal c WHERE c.date >= n.date) AS trade_date FROM news n"


@query("d2_roll_to_trading_day", sql("SELECT trade_date, COUNT(*) AS n, COUNT(*) FILTER (date <> trade_date) AS n_rolled FROM rolled GROUP BY trade_date", "prices", "headlines", news=_NEWS, cal=_CAL, rolled=_ROLL))
def _(spark, sf):
    return calendar.rolled_volume(_news(spark, sf), X.prices(spark, sf)).drop("market")


@query("d3_join_news", sql("""SELECT symbol, date, coalesce(n, 0) AS n, CAST(n IS NOT NULL AS INTEGER) AS news_available FROM prices LEFT JOIN (SELECT market, date, COUNT(*) AS n FROM news GROUP BY market, date) USING (market, date)""", "prices", "headlines", news=_NEWS))
def _(spark, sf):
    daily = _news(spark, sf).groupBy("market", "date").agg(F.count("*").alias("n"))
    return calendar.join_news(X.prices(spark, sf), daily, ["n"]).select(*KEY, "n", "news_available")


_RAW = f"SELECT market, date, {', '.join(f'''max(CASE WHEN code = '{c}' THEN value END) AS {c}''' for c in X.CODES)} FROM indicators GROUP BY market, date"


@query("d4_forward_fill", sql(f"SELECT date, {', '.join(f'{r6(c)} AS {c}' for c in X.CODES)} FROM wide", "wide"))
def _(spark, sf):
    return round_all(X.wide(spark, sf).drop("market"))


@query("d5_legacy_fill", sql(f"""SELECT d.date, coalesce(last_value(n IGNORE NULLS) OVER (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n
FROM (SELECT CAST(unnest(generate_series(DATE '{X.SPAN[0]}', DATE '{X.SPAN[1]}', INTERVAL 1 DAY)) AS DATE) AS date) d LEFT JOIN (SELECT date, COUNT(*) AS n FROM news GROUP BY date) USING (date)""", "headlines", news=_NEWS))
def _(spark, sf):
    from ..operators.news import spine

    news = _news(spark, sf)
    daily = news.groupBy("market", "date").agg(F.count("*").alias("n"))
    return calendar.legacy_calendar_fill(daily, spine(daily, *X.SPAN), ["n"]).select("date", "n")


@query("d6_lag_exogenous", sql(f"SELECT symbol, date, {r6(f'lag(close) OVER ({WO})')} AS close FROM prices", "prices"))
def _(spark, sf):
    return round_all(features.lag_exogenous(X.prices(spark, sf), ["close"]).select(*KEY, "close"))


@query("d7_news_lag", sql(f"SELECT symbol, date, lag(volume, 2) OVER ({WO}) AS volume FROM prices", "prices"))
def _(spark, sf):
    return calendar.news_lag(X.prices(spark, sf), ["volume"], 2).select(*KEY, "volume")


@query("d8_align_sessions", sql(f"""SELECT date, {r6('close')} AS close, right_date, {r6('other')} AS other FROM (SELECT a.date, a.close, b.date AS right_date, b.close AS other
FROM (SELECT *, date + INTERVAL 21 HOUR AS t FROM prices WHERE symbol = '5-LOW') a ASOF LEFT JOIN (SELECT *, date + INTERVAL 6 HOUR AS t FROM prices WHERE symbol = '2-HIGH') b ON a.market = b.market AND a.t >= b.t)""", "prices"))
def _(spark, sf):
    p = X.prices(spark, sf)
    a = p.where("symbol = '5-LOW'").select("market", "date", "close")
    b = p.where("symbol = '2-HIGH'").select("market", "date", F.col("close").alias("other"))
    return round_all(calendar.align_sessions(a, b, "UTC", "Asia/Tokyo", "21:00:00", "15:00:00", ["other"], ["market"]).drop("market"))


@query("d9_winsorize", sql(f"""SELECT symbol, date, {r6('least(greatest(close, lo), hi)')} AS close FROM prices JOIN (SELECT symbol, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi
FROM prices WHERE date < DATE '1999-01-01' GROUP BY symbol) USING (symbol)""", "prices"))
def _(spark, sf):
    return round_all(calendar.winsorize(X.prices(spark, sf), ["close"], F.col("date") < F.to_date(F.lit("1999-01-01")), keys=("market", "symbol")).select(*KEY, "close"))


@query("d10_interpolate", sql(f"""SELECT date, {r6('CASE WHEN A_F IS NOT NULL THEN A_F ELSE va + (vb - va) * (n - na) / (nb - na) END')} AS A_F FROM (SELECT date, A_F, n,
last_value(CASE WHEN A_F IS NOT NULL THEN n END IGNORE NULLS) OVER b AS na, last_value(A_F IGNORE NULLS) OVER b AS va,
first_value(CASE WHEN A_F IS NOT NULL THEN n END IGNORE NULLS) OVER f AS nb, first_value(A_F IGNORE NULLS) OVER f AS vb
FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM raw) WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "indicators", raw=_RAW))
def _(spark, sf):
    raw = calendar.pivot_indicators(X.indicators(spark, sf), X.CODES)
    return round_all(calendar.interpolate(raw, ["A_F"], ("market",)).select("date", "A_F"))


@query("d11_pivot_indicators", sql(f"SELECT date, {', '.join(f'{r6(c)} AS {c}' for c in X.CODES)} FROM raw", "indicators", raw=_RAW))
def _(spark, sf):
    return round_all(calendar.pivot_indicators(X.indicators(spark, sf), X.CODES).drop("market"))


@query("d12_swap_columns", sql(f"SELECT p.symbol, p.date, {r6('p.close')} AS close, q.volume * 2 AS volume FROM prices p LEFT JOIN (SELECT * FROM prices WHERE volume > 1) q USING (market, symbol, date)", "prices"))
def _(spark, sf):
    p = X.prices(spark, sf)
    other = p.where("volume > 1").withColumn("volume", F.col("volume") * 2)
    return round_all(calendar.swap_columns(p, other, ["volume"], ["market", "symbol", "date"]).select(*KEY, "close", "volume"))


@query("d13_availability", sql("""SELECT fold, c AS "column", last_date, coalesce(last_date >= test_end, false) AS usable FROM folds CROSS JOIN (SELECT 'A_F' AS c, max(date) FILTER (A_F IS NOT NULL AND date < DATE '1999-01-01') AS last_date FROM raw UNION ALL SELECT 'R_O', max(date) FILTER (R_O IS NOT NULL) FROM raw)""", "prices", "indicators", folds=_DQ, raw=_RAW))
def _(spark, sf):
    raw = calendar.pivot_indicators(X.indicators(spark, sf), X.CODES)
    raw = raw.withColumn("A_F", F.when(F.col("date") < F.to_date(F.lit("1999-01-01")), F.col("A_F")))
    return calendar.availability_window(raw, ["A_F", "R_O"], splits.date_quantile_folds(X.prices(spark, sf)))


@query("d14_asof_join", sql(f"""SELECT symbol, date, right_on, {r6('value')} AS value FROM (SELECT p.symbol, p.date, i.date AS right_on, i.value FROM prices p ASOF LEFT JOIN (SELECT * FROM indicators WHERE code = 'A_F') i ON p.market = i.market AND p.date >= i.date)""", "prices", "indicators"))
def _(spark, sf):
    right = X.indicators(spark, sf).where("code = 'A_F'")
    return round_all(calendar.asof_join(X.prices(spark, sf).select("market", "symbol", "date"), right, "date", ["market"], ["value"]).drop("market"))


@query("d15_stack_markets", sql(f"SELECT 'M' || symbol[1:1] AS market, date, {r6('close')} AS close, CASE WHEN symbol = '5-LOW' THEN volume END AS volume FROM prices WHERE symbol IN ('5-LOW', '2-HIGH')", "prices"))
def _(spark, sf):
    p = X.prices(spark, sf)
    one = [p.where(F.col("symbol") == s).select(F.lit("M" + s[0]).alias("market"), "date", "close", "volume") for s in ("2-HIGH", "5-LOW")]
    return round_all(calendar.stack_markets(one[0].drop("volume"), one[1]).select("market", "date", "close", "volume"))
