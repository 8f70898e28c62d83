"""Panel views over the given tables, as DataFrames and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features, targets
from ..functions.frames import by_date, mean
from ..operators import calendar

CODES = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]
SPAN = ("1995-01-01", "2001-12-31")
NEWS_SPAN = ("2023-12-30", "2024-02-02")
HIGH, LOW = ["that", "elle", "sich"], ["with", "pour", "this"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count("*")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.lit("ALL").alias("market"), F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return o.groupBy("market", "symbol", "date").agg(money("o_totalprice").alias("close"), F.count("*").alias("volume"))


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.lit("ALL").alias("market"), F.to_date("l_shipdate").alias("date"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("code"), "l_quantity")
    return rows.groupBy("market", "date", "code").agg(money("l_quantity").alias("value"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.lit("ALL").alias("market"), F.col("event_type").alias("section"), F.to_date("ts").alias("date"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), (F.col("event_id") % 8).cast("int").alias("relevance_score"), "value",
    )


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("headline_id"), F.col("lang").alias("market"), F.col("source").alias("section"), F.col("text").alias("headline"), F.date_add(F.to_date(F.lit("1995-01-01")), ((F.col("doc_id") * 7919) % 2400).cast("int")).alias("date"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id") % 100
    pos, neg = (k + 1).cast("double") / 150.0, (100 - k).cast("double") / 300.0
    return e.select("event_id", F.lit("ALL").alias("market"), F.to_date("ts").alias("date"), pos.alias("pos"), neg.alias("neg"), (1.0 - pos - neg).alias("neu"))


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.text import daily_sentiment

    return daily_sentiment(scores(spark, sf))


def daily_news(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sentiment with its dynamics and smoothed forms, and intensity with its ratios, of events spread over the days of the price calendar."""
    from ..operators import text

    day = F.date_add(F.to_date(F.lit("1995-01-01")), ((F.col("event_id") * 7919) % 2400).cast("int"))
    daily = text.smoothed_sentiment(text.sentiment_dynamics(text.daily_sentiment(scores(spark, sf).withColumn("date", day))))
    intensity = text.ratio_to_trailing(text.news_intensity(candidates(spark, sf).withColumn("date", day), []), ["n_cand", "n_hi", "mean_relevance"])
    return daily.join(intensity, ["market", "date"])


def day_terms(spark: SparkSession, sf: str, vocab: int = 500) -> DataFrame:
    """(date, s): the day's mean TF-IDF of its headlines as (i, v) of the terms that it has; terms are numbered in the order of their text."""
    from ..operators import text

    h = headlines(spark, sf).select("date", "headline")
    terms = text.sparse_terms(h, vocab=vocab).select("date", F.unwrap_udt("vec").alias("vec"))
    sums = terms.select("date", F.inline(F.arrays_zip(F.col("vec.indices").alias("i"), F.col("vec.values").alias("w")))).groupBy("date", "i").agg(F.sum("w").alias("w"))
    sizes = h.groupBy("date").agg(F.count("*").alias("n"))
    return sums.join(sizes, "date").groupBy("date").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("w") / F.col("n")).alias("v")))).alias("s"))


def day_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(date, vec): the day's mean vector, of vectors spread over the days of the price calendar."""
    from ..operators import text

    e = table(spark, sf, "embeddings").withColumn("date", F.date_add(F.to_date(F.lit("1995-01-01")), ((F.col("vec_id") * 7919) % 2400).cast("int")))
    return text.mean_vector(e, ["date"], "embedding").select("date", "vec")


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again, for what is read by many fits."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return features.returns(prices(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Price features with targets, one row a symbol and day."""
    df = features.price_features(prices(spark, sf))
    return targets.differenced(targets.volatility(targets.direction(targets.next_day(targets.log_vol(df)))))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.forward_fill(calendar.pivot_indicators(indicators(spark, sf), CODES), CODES, ("market",))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(market, symbol, date, fold, y, y_dir, yhat_a, yhat_b, p): y is the next absolute return, guesses are today's and the 5-day mean."""
    df = returns(spark, sf)
    nxt = F.lead("ret").over(by_date())
    df = df.select(*df.columns, F.lead("absret").over(by_date()).alias("y"), (nxt > 0).cast("int").alias("y_dir"), F.col("absret").alias("yhat_a"), mean("absret", 5).alias("yhat_b"))
    df = df.where("y IS NOT NULL AND yhat_b IS NOT NULL")
    p = F.round(0.5 - F.col("ret") / (1 + F.abs("ret")) / 2, 2)
    fold = F.ntile(5).over(Window.partitionBy("market", "symbol").orderBy("date")) - 1
    return df.select("market", "symbol", "date", fold.alias("fold"), "ret", "y", "y_dir", "yhat_a", "yhat_b", p.alias("p"))


def long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    df = predictions(spark, sf)
    return df.select("market", "symbol", "date", "fold", "y", F.inline(F.array(F.struct(F.lit("A").alias("model"), F.col("yhat_a").alias("yhat")), F.struct(F.lit("B").alias("model"), F.col("yhat_b").alias("yhat")))))


# SQL text of the same views; `sql` puts those that a query needs in front of it.
WO = "PARTITION BY market, symbol ORDER BY date"
WD = "PARTITION BY market ORDER BY date"


def roll(agg: str, of: str, k: int, skip: int = 0, w: str = WO) -> str:
    frame = f"OVER ({w} ROWS BETWEEN {k - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"
    return f"CASE WHEN count({of}) {frame} = {k} THEN {agg} {frame} END"


def ahead(agg: str, of: str, h: int) -> str:
    frame = f"OVER ({WO} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count({of}) {frame} = {h} THEN {agg} {frame} END"


def r6(e: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({e}) < {0.5 * 10**-digits:.10f} THEN 0.0 ELSE round({e}, {digits}) END"


VIEWS = {
    "prices": """SELECT 'ALL' AS market, o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS close, COUNT(*) AS volume FROM orders GROUP BY ALL""",
    "indicators": """SELECT 'ALL' AS market, CAST(l_shipdate AS DATE) AS date, CONCAT(l_returnflag, '_', l_linestatus) AS code,
      CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS value FROM lineitem GROUP BY ALL""",
    "candidates": """SELECT event_id, 'ALL' AS market, event_type AS section, CAST(ts AS DATE) AS date, ts, CONCAT('u', CAST(user_id AS VARCHAR)) AS url,
      CAST(event_id % 8 AS INTEGER) AS relevance_score, value FROM events""",
    "headlines": """SELECT doc_id AS headline_id, lang AS market, source AS section, text AS headline,
      DATE '1995-01-01' + CAST((doc_id * 7919) % 2400 AS INTEGER) AS date FROM documents""",
    "scores": """SELECT event_id, 'ALL' AS market, CAST(ts AS DATE) AS date, CAST(event_id % 100 + 1 AS DOUBLE) / 150.0 AS pos,
      CAST(100 - event_id % 100 AS DOUBLE) / 300.0 AS neg, 1.0 - CAST(event_id % 100 + 1 AS DOUBLE) / 150.0 - CAST(100 - event_id % 100 AS DOUBLE) / 300.0 AS neu FROM events""",
    "rets": f"SELECT *, abs(ret) AS absret FROM (SELECT *, ln(close / lag(close) OVER ({WO})) AS ret FROM prices)",
    "feats": f"""SELECT *, rolling_std_5 / nullif(rolling_std_20, 0) AS vol_ratio_5_20,
        CASE WHEN g + l = 0 THEN 50.0 ELSE 100 * g / (g + l) END AS rsi_14 FROM (SELECT *,
        {", ".join(f"lag(ret, {i}) OVER ({WO}) AS ret_lag{i}" for i in range(1, 6))}, {", ".join(f"lag(absret, {i}) OVER ({WO}) AS absret_lag{i}" for i in range(1, 4))},
        {", ".join(f"{roll('stddev_samp(ret)', 'ret', k)} AS rolling_std_{k}" for k in (5, 20, 22))},
        {", ".join(f"{roll('avg(absret)', 'absret', k)} AS har_{k}" for k in (1, 5, 20, 22))},
        {", ".join(f"{roll('avg(least(ret, 0.0))', 'ret', k)} AS leverage_{k}d" for k in (5, 20))},
        {roll('avg(greatest(ret, 0.0))', 'ret', 14)} AS g, {roll('avg(greatest(-ret, 0.0))', 'ret', 14)} AS l,
        absret - {roll('avg(absret)', 'absret', 20, 1)} AS absret_surprise,
        {roll('avg(ret)', 'ret', 5)} AS rolling_ret_5d, {roll('avg(ret)', 'ret', 20)} AS rolling_ret_20d, {roll('avg(absret)', 'absret', 5)} AS rolling_absret,
        ln(sqrt({roll('sum(ret * ret)', 'ret', 5)}) + 1e-8) AS rv5_past,
        CAST(isodow(date) - 1 AS INTEGER) AS dow, {", ".join(f"CAST(isodow(date) = {i + 1} AS INTEGER) AS dow_{i}" for i in range(5))},
        ln(lead(absret) OVER ({WO}) + 1e-8) AS y_logvol, lead(absret) OVER ({WO}) AS y_absret, lead(ret) OVER ({WO}) AS y_ret, CAST(lead(ret) OVER ({WO}) > 0 AS INTEGER) AS y_dir,
        {", ".join(f"CAST({ahead('sum(ret)', 'ret', h)} > 0 AS INTEGER) AS dir_{h}" for h in (1, 5, 20))},
        {", ".join(f"ln(sqrt({ahead('sum(ret * ret)', 'ret', h)}) + 1e-8) AS vol_{h}" for h in (1, 5))}
      FROM rets)""",
    "wide": f"""SELECT market, date, {", ".join(f"last_value({c} IGNORE NULLS) OVER ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in CODES)}
      FROM (SELECT market, date, {", ".join(f"max(CASE WHEN code = '{c}' THEN value END) AS {c}" for c in CODES)} FROM indicators GROUP BY market, date)""",
    "sent": """SELECT market, date, COUNT(*) AS news_volume, avg(pos) AS sent_pos_mean, avg(neg) AS sent_neg_mean, avg(neu) AS sent_neu_mean, avg(pos - neg) AS sent_score_mean,
      coalesce(stddev_samp(pos - neg), 0.0) AS sent_score_std, max(neg) AS sent_max_neg, avg(CAST(pos = greatest(pos, neg, neu) AS DOUBLE)) AS sent_pos_ratio,
      avg(CAST(neg = greatest(pos, neg, neu) AS DOUBLE)) AS sent_neg_ratio FROM scores GROUP BY market, date""",
    "preds": f"""SELECT market, symbol, date, ntile(5) OVER ({WO}) - 1 AS fold, ret, y, y_dir, yhat_a, yhat_b, round(0.5 - ret / (1 + abs(ret)) / 2, 2) AS p
      FROM (SELECT *, lead(absret) OVER ({WO}) AS y, CAST(lead(ret) OVER ({WO}) > 0 AS INTEGER) AS y_dir, absret AS yhat_a, {roll('avg(absret)', 'absret', 5)} AS yhat_b FROM rets)
      WHERE y IS NOT NULL AND yhat_b IS NOT NULL""",
    "longp": "SELECT market, symbol, date, fold, y, 'A' AS model, yhat_a AS yhat FROM preds UNION ALL SELECT market, symbol, date, fold, y, 'B', yhat_b FROM preds",
}
NEEDS = {"rets": ["prices"], "feats": ["rets"], "wide": ["indicators"], "sent": ["scores"], "preds": ["rets"], "longp": ["preds"]}


def sql(body: str, *views: str, **more: str) -> str:
    """body behind WITH clauses for the views it needs and for further named queries."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a sink's query: below the shared checkpoint folder, or on a single machine a temporary one where that is unset."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="panelspring-")
    return f"{base.rstrip('/')}/panelspring/{uuid.uuid4().hex}/{name}"
