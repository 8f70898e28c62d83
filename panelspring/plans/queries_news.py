"""Queries of news selection and text features, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import rounded
from ..functions.metrics import round_all
from ..operators import calendar, checks, news, text
from ..sources import io
from . import fixtures as X
from .fixtures import WD, r6, roll, sql
from .queries_features import ORACLES, QUERIES, query

CLOSE = ["that the", "elle", "und die"]
CLOSE_RE = "(?i)(" + "|".join(CLOSE) + ")"
TOPICS = {"policy": ["that", "la"], "macro": ["with", "de"], "trade": ["this", "und"], "market": ["from", "el"], "company": ["elle", "y"], "commodity_fx": ["pour", "sich"]}


def _word(words: list[str]) -> str:
    return f"regexp_matches(lower(headline), '(^|[^\\p{{L}}])({'|'.join(words)})([^\\p{{L}}]|$)')"


NOISE = ["the", "les"]
_REL = f"""SELECT *, CASE WHEN section IN ('src1', 'src2', 'src3') THEN 2 ELSE 0 END + CASE WHEN {_word(X.HIGH)} THEN 3 ELSE 0 END
 + CASE WHEN {_word(X.LOW)} THEN 1 ELSE 0 END + CASE WHEN {_word(NOISE)} THEN -3 ELSE 0 END AS relevance_score FROM headlines"""


def _rel(spark, sf) -> DataFrame:
    return news.relevance(X.headlines(spark, sf), X.HIGH, X.LOW, ["src1", "src2", "src3"], NOISE)


@query("a4_read_candidates", sql("SELECT event_id, section, date, url, relevance_score FROM candidates", "candidates"))
def _(spark, sf):
    path = X.scratch(spark, "candidates")
    io.write_table(X.candidates(spark, sf).withColumn("headline", F.col("event_id").cast("string")), path, io.CANDIDATES)
    return io.read_candidates(spark, path).select(F.col("headline").cast("long").alias("event_id"), "section", "date", "url", F.col("relevance_score").cast("int").alias("relevance_score"))


@query("a5_pages_to_candidates", rf"""SELECT page_id, CAST(n - 1 AS INTEGER) AS n, headline, url, regexp_extract(url, '^(?:[a-z]+://[^/]*)?/([^/?#]*)', 1) AS section, CAST(NULL AS DATE) AS url_date
FROM (SELECT page_id, n, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS headline, u AS url FROM (
SELECT page_id, unnest(range(1, len(us) + 1)) AS n, unnest(us) AS u, unnest(ts) AS t FROM (
SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS us, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS ts FROM pages)))
WHERE headline <> ''""")
def _(spark, sf):
    return io.pages_to_candidates(X.table(spark, sf, "pages"))


_LEX = "(VALUES ('that', 1.0), ('with', -1.0), ('this', 0.5), ('from', -0.5), ('elle', 1.0), ('pour', -1.0), ('sich', 0.25))"


def _lexicon(spark) -> DataFrame:
    return spark.sql(f"SELECT col1 AS token, 'x' AS sentiment, CAST(col2 AS DOUBLE) AS polarity FROM {_LEX}")


_TOK = "SELECT headline_id, unnest(list_filter(regexp_split_to_array(lower(headline), '[^a-zà-ÿ]+'), lambda x: x <> '')) AS token FROM headlines"


@query("a6_read_lexicon", sql(f"SELECT l.token, CAST(polarity AS DOUBLE) AS polarity, COUNT(DISTINCT headline_id) AS headlines FROM {_LEX} AS l(token, polarity) LEFT JOIN tok t ON t.token = l.token GROUP BY ALL", "headlines", tok=_TOK))
def _(spark, sf):
    path = X.scratch(spark, "lexicon")
    io.write_table(_lexicon(spark), path, io.LEXICON, "csv")
    lex = io.read_lexicon(spark, path).select("token", "polarity")
    tokens = X.headlines(spark, sf).select("headline_id", F.explode(text.tokens(F.col("headline"))).alias("token")).distinct()
    return lex.join(tokens, "token", "left").groupBy("token", "polarity").agg(F.count("headline_id").alias("headlines"))


@query("a7_read_vectors", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim, CASE WHEN abs(CAST(embedding[1] AS DOUBLE)) < 0.0000005 THEN 0.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def _(spark, sf):
    path = X.scratch(spark, "vectors")
    e = X.table(spark, sf, "embeddings")
    io.write_table(e.select(F.col("label").alias("market"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path, io.VECTORS)
    v = io.read_vectors(spark, path)
    return v.select(F.col("id").cast("long").alias("vec_id"), F.col("market").cast("int").alias("label"), F.size("vec").alias("dim"), rounded(F.col("vec")[0].cast("double")).alias("first"))


@query("a8_write_daily", sql("SELECT section, date, url, relevance_score, CAST(year(date) AS INTEGER) AS year FROM candidates WHERE relevance_score >= 6", "candidates"))
def _(spark, sf):
    path = X.scratch(spark, "daily")
    io.write_daily(X.candidates(spark, sf).where("relevance_score >= 6").select("market", "date", "section", "url", "relevance_score"), path)
    return spark.read.parquet(path).select("section", "date", "url", "relevance_score", "year")


_SPINE = f"SELECT CAST(unnest(generate_series(DATE '{X.NEWS_SPAN[0]}', DATE '{X.NEWS_SPAN[1]}', INTERVAL 1 DAY)) AS DATE) AS date"


@query("a9_pending_dates", sql("SELECT 'ALL' AS market, date FROM spine ANTI JOIN (SELECT DISTINCT date FROM candidates WHERE relevance_score = 7 AND section = 'view') USING (date)", "candidates", spine=_SPINE))
def _(spark, sf):
    c = X.candidates(spark, sf)
    return io.pending_dates(news.spine(c, *X.NEWS_SPAN), c.where("relevance_score = 7 AND section = 'view'"))


_TOP = "SELECT *, CAST(row_number() OVER (PARTITION BY market, date ORDER BY relevance_score DESC, url, event_id) AS INTEGER) AS day_rank, max(relevance_score) OVER (PARTITION BY market, date) AS best FROM candidates"


@query("a10_reselect", sql("""SELECT event_id, date, day_rank, CAST(relevance_score < 7 AS INTEGER) AS is_fallback FROM top WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
AND ((relevance_score >= 7 AND day_rank <= 3) OR (best < 7 AND day_rank = 1))""", "candidates", top=_TOP))
def _(spark, sf):
    return news.reselect(X.candidates(spark, sf), "ALL", "2024-01-05", "2024-01-20", 3, 7, ("url", "event_id")).select("event_id", "date", "day_rank", "is_fallback")


#: A stored selection that lost its rows of one section on some days and has a changed score on others.
_STORED = "SELECT event_id, market, date, CASE WHEN event_id % 11 = 3 AND day(date) = 9 THEN relevance_score + 1 ELSE relevance_score END AS relevance_score, day_rank FROM chosen WHERE NOT (section = 'view' AND day(date) % 5 = 0)"
_CHOSEN = "SELECT event_id, market, date, section, relevance_score, day_rank FROM top WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-02-01' AND ((relevance_score >= 7 AND day_rank <= 3) OR (best < 7 AND day_rank = 1))"
_SIDES = """SELECT market, date, event_id, relevance_score, day_rank, 1 AS a, 0 AS b FROM stored UNION ALL SELECT market, date, event_id, relevance_score, day_rank, 0, 1 FROM chosen"""


@query("a10_reselect_verify", sql("""SELECT date, CAST(sum(a) AS BIGINT) AS n_stored, CAST(sum(b) AS BIGINT) AS n_computed, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS only_stored, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS only_computed
FROM (SELECT market, date, event_id, relevance_score, day_rank, sum(a) AS a, sum(b) AS b FROM sides GROUP BY ALL) GROUP BY date HAVING sum(abs(a - b)) > 0""", "candidates", top=_TOP, chosen=_CHOSEN, stored=_STORED, sides=_SIDES))
def _(spark, sf):
    c = X.candidates(spark, sf)
    span = ("ALL", "2024-01-05", "2024-02-01", 3, 7, ("url", "event_id"))
    score = F.when((F.col("event_id") % 11 == 3) & (F.day("date") == 9), F.col("relevance_score") + 1).otherwise(F.col("relevance_score"))
    stored = news.reselect(c, *span).where("NOT (section = 'view' AND day(date) % 5 = 0)").select("event_id", "market", "date", score.alias("relevance_score"), "day_rank")
    return news.reselect(c, *span, stored=stored).drop("market")


@query("a11_write_metrics", sql("SELECT section, COUNT(*) AS n, 'run_b' AS run_id FROM candidates GROUP BY section UNION ALL SELECT section, COUNT(*) * 2, 'run_a' FROM candidates GROUP BY section", "candidates"))
def _(spark, sf):
    path = X.scratch(spark, "metrics")
    m = X.candidates(spark, sf).groupBy("section").agg(F.count("*").alias("n"))
    io.write_metrics(m, path, "run_a")
    io.write_metrics(m, path, "run_b")
    io.write_metrics(m.withColumn("n", F.col("n") * 2), path, "run_a")
    return spark.read.parquet(path).select("section", "n", "run_id")


@query("b1_drop_close_summaries", sql(f"SELECT headline_id FROM headlines WHERE NOT regexp_matches(headline, '{CLOSE_RE}')", "headlines"))
def _(spark, sf):
    return news.drop_close_summaries(X.headlines(spark, sf), CLOSE).select("headline_id")


@query("b2_flag_close_summary", sql(f"SELECT headline_id, regexp_matches(headline, '{CLOSE_RE}') AS is_close_summary FROM headlines", "headlines"))
def _(spark, sf):
    return news.flag_close_summary(X.headlines(spark, sf), CLOSE).select("headline_id", "is_close_summary")


@query("b3_valid_rows", sql("SELECT headline_id, date FROM headlines WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND trim(headline) <> ''", "headlines"))
def _(spark, sf):
    return news.valid_rows(X.headlines(spark, sf), "1996-01-01", "1999-12-31").select("headline_id", "date")


_HD = "SELECT headline_id, market, section, headline, DATE '1995-01-01' + CAST(headline_id % 7 AS INTEGER) AS date FROM headlines"


@query("b4_dedup_headlines", sql("SELECT min(headline_id) AS headline_id, market, date, headline FROM hd GROUP BY market, date, headline", "headlines", hd=_HD))
def _(spark, sf):
    h = X.headlines(spark, sf).withColumn("date", F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("headline_id") % 7).cast("int")))
    return news.dedup_headlines(h, ["headline_id"]).select("headline_id", "market", "date", "headline")


@query("b5_dedup_urls", sql("SELECT event_id FROM (SELECT event_id, date_diff('day', lag(date) OVER (PARTITION BY market, url ORDER BY date, event_id), date) AS g FROM candidates) WHERE g IS NULL OR g > 1", "candidates"))
def _(spark, sf):
    return news.dedup_urls(X.candidates(spark, sf), ["event_id"]).select("event_id")


@query("b6_url_date_tolerance", sql("SELECT event_id FROM (SELECT *, date + CAST(event_id % 4 AS INTEGER) - 1 AS url_date FROM candidates) WHERE abs(date_diff('day', url_date, date)) <= 1", "candidates"))
def _(spark, sf):
    return news.url_date_tolerance(X.candidates(spark, sf).withColumn("url_date", F.date_add("date", (F.col("event_id") % 4).cast("int") - 1))).select("event_id")


@query("b7_eligible_sections", sql("SELECT headline_id FROM (SELECT *, max(CAST(section IN ('src1', 'src2') AS INTEGER)) OVER (PARTITION BY market, date) AS others FROM hd) WHERE section IN ('src1', 'src2') OR others = 0", "headlines", hd=_HD.replace("% 7", "% 97")))
def _(spark, sf):
    h = X.headlines(spark, sf).withColumn("date", F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("headline_id") % 97).cast("int")))
    return news.eligible_sections(h, ["src1", "src2"]).select("headline_id")


@query("b8_relevance_score", sql("SELECT headline_id, CAST(relevance_score AS INTEGER) AS relevance_score FROM rel", "headlines", rel=_REL))
def _(spark, sf):
    return _rel(spark, sf).select("headline_id", "relevance_score")


@query("b9_noise_penalty", sql(f"SELECT headline_id, CAST(CASE WHEN {_word(NOISE)} THEN -3 ELSE 0 END AS INTEGER) AS penalty FROM headlines", "headlines"))
def _(spark, sf):
    return X.headlines(spark, sf).select("headline_id", news.noise_penalty(F.col("headline"), NOISE).alias("penalty"))


@query("b10_daily_top_k", sql("SELECT event_id, date, CAST(day_rank AS INTEGER) AS day_rank FROM (SELECT *, row_number() OVER (PARTITION BY market, date ORDER BY relevance_score DESC, url, event_id) AS day_rank FROM candidates WHERE relevance_score >= 3) WHERE day_rank <= 10", "candidates"))
def _(spark, sf):
    return news.daily_top_k(X.candidates(spark, sf), order=("url", "event_id")).select("event_id", "date", "day_rank")


_RANKED = "SELECT *, row_number() OVER (PARTITION BY market, date ORDER BY relevance_score DESC, headline_id) AS day_rank, max(relevance_score) OVER (PARTITION BY market, date) AS best FROM rel"


def _guaranteed(spark, sf) -> DataFrame:
    return news.guarantee_daily(_rel(spark, sf), 2, 3, ("headline_id",))


_GUAR = "SELECT *, CAST(relevance_score < 3 AS INTEGER) AS is_fallback FROM ranked WHERE (relevance_score >= 3 AND day_rank <= 2) OR (best < 3 AND day_rank = 1)"


@query("b11_guarantee_daily", sql("SELECT headline_id, market, date, CAST(day_rank AS INTEGER) AS day_rank, is_fallback FROM guar", "headlines", rel=_REL, ranked=_RANKED, guar=_GUAR))
def _(spark, sf):
    return _guaranteed(spark, sf).select("headline_id", "market", "date", "day_rank", "is_fallback")


@query("b12_holiday_supplement", sql("""SELECT headline_id, 0 AS supplement FROM rel WHERE section IN ('src1', 'src2', 'src3') UNION ALL
SELECT headline_id, 1 FROM (SELECT headline_id, row_number() OVER (PARTITION BY market, date ORDER BY relevance_score DESC, headline_id) AS n FROM rel r WHERE section NOT IN ('src1', 'src2', 'src3')
AND NOT EXISTS (SELECT 1 FROM rel m WHERE m.section IN ('src1', 'src2', 'src3') AND m.market = r.market AND m.date = r.date)) WHERE n = 1""", "headlines", rel=_REL))
def _(spark, sf):
    r = _rel(spark, sf)
    ok = F.col("section").isin("src1", "src2", "src3")
    return news.holiday_supplement(r.where(ok), r.where(~ok), ("headline_id",)).select("headline_id", "supplement")


@query("b13_weak_dates", sql("SELECT market, date, CAST(max(relevance_score) AS INTEGER) AS best FROM rel GROUP BY market, date HAVING max(relevance_score) <= 1", "headlines", rel=_REL))
def _(spark, sf):
    return news.weak_dates(_rel(spark, sf))


@query("b14_calendar_coverage", sql("SELECT 'ALL' AS market, date FROM spine ANTI JOIN candidates USING (date)", "candidates", spine=_SPINE))
def _(spark, sf):
    return news.calendar_coverage(X.candidates(spark, sf), *X.NEWS_SPAN)


@query("b15_yearly_report", sql(f"SELECT market, CAST(year(date) AS INTEGER) AS year, COUNT(*) AS n, {r6('COUNT(*) / CAST(COUNT(DISTINCT date) AS DOUBLE)')} AS per_day, {r6('avg(is_fallback)')} AS fallback_share FROM guar GROUP BY ROLLUP(market, year(date))", "headlines", rel=_REL, ranked=_RANKED, guar=_GUAR))
def _(spark, sf):
    return round_all(news.yearly_report(_guaranteed(spark, sf)))


_HASH = "((date_diff('day', DATE '1970-01-01', date) * 48271 + 7 * 69621) % 65521)"


@query("b16_audit_sample", sql(f"SELECT date, {_HASH} AS rank FROM (SELECT DISTINCT date FROM candidates) ORDER BY rank, date LIMIT 20", "candidates"))
def _(spark, sf):
    return news.audit_sample(X.candidates(spark, sf))


def _topic_sql() -> str:
    return ", ".join(f"{_word(w)} AS topic_{t}" for t, w in TOPICS.items())


@query("b17_tag_topics", sql(f"SELECT headline_id, {_topic_sql()} FROM headlines", "headlines"))
def _(spark, sf):
    return news.tag_topics(X.headlines(spark, sf), TOPICS).select("headline_id", *[f"topic_{t}" for t in TOPICS])


@query("b18_news_coverage", sql(f"""SELECT 'ALL' AS market, COUNT(*) AS days, {r6('avg(CAST(has AS DOUBLE))')} AS coverage, {r6("avg(CASE WHEN date <= DATE '1999-12-31' THEN CAST(has AS DOUBLE) END)")} AS train_coverage
FROM (SELECT date, date IN (SELECT date FROM headlines) AS has FROM (SELECT DISTINCT date FROM prices))""", "prices", "headlines"))
def _(spark, sf):
    h = X.headlines(spark, sf).withColumn("market", F.lit("ALL"))
    return round_all(news.news_coverage(h, X.prices(spark, sf), "1999-12-31"))


@query("b19_exclude_fallback", sql("SELECT headline_id FROM guar WHERE is_fallback = 0", "headlines", rel=_REL, ranked=_RANKED, guar=_GUAR))
def _(spark, sf):
    return news.exclude_fallback(_guaranteed(spark, sf)).select("headline_id")


@query("b20_thin_coverage", sql(f"SELECT headline_id FROM headlines WHERE {_HASH} < 19656", "headlines"))
def _(spark, sf):
    return news.thin_coverage(X.headlines(spark, sf), 0.3).select("headline_id")


@query("b21_fallback_by_weekday", sql(f"SELECT market, CAST(isodow(date) - 1 AS INTEGER) AS weekday, {r6('avg(is_fallback)')} AS fallback_share, COUNT(*) AS n FROM guar GROUP BY ALL", "headlines", rel=_REL, ranked=_RANKED, guar=_GUAR))
def _(spark, sf):
    return round_all(news.fallback_by_weekday(_guaranteed(spark, sf)))


@query("b22_candidates_per_day", sql("SELECT market, date, COUNT(*) AS n_cand FROM candidates GROUP BY ALL", "candidates"))
def _(spark, sf):
    return news.candidates_per_day(X.candidates(spark, sf))


# Text features.
@query("c1_tfidf", sql(f"""SELECT headline_id, token, tf, {r6('ln((docs + 1.0) / (df + 1.0))')} AS idf, {r6('tf * ln((docs + 1.0) / (df + 1.0))')} AS weight
FROM (SELECT headline_id, token, COUNT(*) AS tf FROM tok GROUP BY ALL) JOIN (SELECT token, COUNT(*) AS n, COUNT(DISTINCT headline_id) AS df FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 500) USING (token)
CROSS JOIN (SELECT COUNT(*) AS docs FROM headlines)""", "headlines", tok=_TOK))
def _(spark, sf):
    return round_all(text.term_weights(X.headlines(spark, sf)))


@query("c2_tfidf_pca")
def _(spark, sf):
    vectors = X.kept(spark, text.sparse_terms(X.headlines(spark, sf).select("headline_id", "headline")), "terms")
    return text.apply_pca(vectors, text.fit_pca(vectors, 30)).select("headline_id", "pca")


def _scorer(series: pd.Series) -> pd.DataFrame:
    pos = series.str.count("[aeiou]") + 1.0
    neg = series.str.count("[bcdfg]") + 1.0
    total = pos + neg + 1.0
    return pd.DataFrame({"pos": pos / total, "neg": neg / total, "neu": 1.0 / total})


@query("c3_score_headlines", sql(f"""SELECT headline_id, {r6('a / (a + b + 1)')} AS pos, {r6('b / (a + b + 1)')} AS neg, {r6('1 / (a + b + 1)')} AS neu
FROM (SELECT headline_id, len(regexp_extract_all(headline, '[aeiou]')) + 1.0 AS a, len(regexp_extract_all(headline, '[bcdfg]')) + 1.0 AS b FROM headlines)""".replace("1.0 AS", "CAST(1.0 AS DOUBLE) AS"), "headlines"))
def _(spark, sf):
    return round_all(text.score_headlines(X.headlines(spark, sf).select("headline_id", "headline"), _scorer).select("headline_id", "pos", "neg", "neu"))


@query("c3_learned_scores")
def _(spark, sf):
    """A scorer learned from the labels of documents whose id is even, toxic ones being negative, applied to all documents."""
    h = X.headlines(spark, sf).select("headline_id", "headline")
    labels = X.table(spark, sf, "labels").select(F.col("doc_id").alias("headline_id"), (1 - F.col("toxic")).alias("label"))
    known = X.kept(spark, h.where("headline_id % 2 = 0").join(labels, "headline_id"), "labelled")
    scorer = text.fit_scorer(known)
    return text.score_headlines(h, scorer).select("headline_id", "pos", "neg", "neu")


@query("c4_lexicon_scores", sql(f"""SELECT headline_id, COUNT(t.token) AS n_tokens, COUNT(polarity) AS n_hits, {r6('coalesce(SUM(CAST(polarity AS DOUBLE)), 0.0)')} AS polarity
FROM headlines LEFT JOIN tok t USING (headline_id) LEFT JOIN {_LEX} AS l(token, polarity) ON t.token = l.token GROUP BY headline_id""", "headlines", tok=_TOK))
def _(spark, sf):
    return round_all(text.lexicon_scores(X.headlines(spark, sf), _lexicon(spark)))


_SENT = ["sent_pos_mean", "sent_neg_mean", "sent_neu_mean", "sent_score_mean", "sent_score_std", "sent_max_neg", "sent_pos_ratio", "sent_neg_ratio"]


@query("c5_daily_sentiment", sql(f"SELECT date, news_volume, {', '.join(f'{r6(c)} AS {c}' for c in _SENT)} FROM sent", "sent"))
def _(spark, sf):
    return round_all(X.sentiment(spark, sf).drop("market"))


S = "sent_score_mean"


@query("c6_sentiment_dynamics", sql(f"""SELECT date, {r6(roll(f'avg({S})', S, 5, w=WD))} AS sent_ma5, {r6(roll(f'avg({S})', S, 20, w=WD))} AS sent_ma20, {r6(f"{S} - {roll(f'avg({S})', S, 5, w=WD)}")} AS sent_surprise,
{r6(f'{S} - lag({S}, 3) OVER ({WD})')} AS sent_momentum_3d, {r6(roll(f'stddev_samp({S})', S, 5, w=WD))} AS sent_vol_5d, news_volume - lag(news_volume) OVER ({WD}) AS news_volume_chg FROM sent""", "sent"))
def _(spark, sf):
    return round_all(text.sentiment_dynamics(X.sentiment(spark, sf)).select("date", "sent_ma5", "sent_ma20", "sent_surprise", "sent_momentum_3d", "sent_vol_5d", "news_volume_chg"))


def _ewm_sql(c: str, span: int) -> str:
    keep = 1 - 2 / (span + 1)
    return f"(SELECT sum(b.{c} * pow(CAST({keep!r} AS DOUBLE), a.n - b.n)) / sum(pow(CAST({keep!r} AS DOUBLE), a.n - b.n)) FROM num b WHERE b.n BETWEEN a.n - 59 AND a.n)"


@query("c7_smoothed_sentiment", sql(f"SELECT date, {', '.join(f'{r6(_ewm_sql(c, s))} AS ewm_{k}_{s}' for k, c in (('score', S), ('neg', 'sent_neg_mean'), ('maxneg', 'sent_max_neg')) for s in (5, 20))} FROM num a", "sent", num="SELECT *, row_number() OVER (ORDER BY date) AS n FROM sent"))
def _(spark, sf):
    return round_all(text.smoothed_sentiment(X.sentiment(spark, sf)).select("date", *[f"ewm_{k}_{s}" for k in ("score", "neg", "maxneg") for s in (5, 20)]))


_TOPIC_COLS = ", ".join(f"COUNT(*) FILTER (topic_{t}) AS n_{t}" for t in TOPICS)


@query("c8_news_intensity", sql(f"SELECT market, date, COUNT(*) AS n_cand, COUNT(*) FILTER (relevance_score >= 3) AS n_hi, {r6('avg(CAST(relevance_score AS DOUBLE))')} AS mean_relevance, {_TOPIC_COLS} FROM (SELECT *, {_topic_sql()} FROM rel) GROUP BY ALL", "headlines", rel=_REL))
def _(spark, sf):
    return round_all(text.news_intensity(news.tag_topics(_rel(spark, sf), TOPICS), [f"topic_{t}" for t in TOPICS]))


@query("c9_ratio_to_trailing", sql(f"SELECT date, {r6(f'news_volume / nullif(avg(news_volume) OVER ({WD} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0)')} AS news_volume_ratio FROM sent", "sent"))
def _(spark, sf):
    return round_all(text.ratio_to_trailing(X.sentiment(spark, sf), ["news_volume"]).select("date", "news_volume_ratio"))


@query("c10_daily_mean_vector", f"""SELECT label, COUNT(*) AS n, {r6('avg(CAST(embedding[1] AS DOUBLE))', 5)} AS v1, {r6('avg(CAST(embedding[64] AS DOUBLE))', 5)} AS v64 FROM embeddings GROUP BY label""")
def _(spark, sf):
    v = text.mean_vector(X.table(spark, sf, "embeddings"), ["label"], "embedding")
    return v.select("label", "n", rounded(F.col("vec")[0], 5).alias("v1"), rounded(F.col("vec")[63], 5).alias("v64"))


def _pca(spark, sf):
    e = X.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vec")
    return e, text.fit_pca(e.where("label < 7"), 15)


@query("c11_pca")
def _(spark, sf):
    e, model = _pca(spark, sf)
    return text.apply_pca(e, model).select("vec_id", "label", "pca")


@query("c12_explained_variance")
def _(spark, sf):
    return text.explained_variance(spark, _pca(spark, sf)[1])


@query("c13_interactions", sql(f"SELECT date, {r6('sent_score_mean * news_volume')} AS sent_x_vix, {r6('sent_score_mean * sent_score_std')} AS sent_x_vol FROM sent", "sent"))
def _(spark, sf):
    return round_all(text.interactions(X.sentiment(spark, sf), S, "news_volume", "sent_score_std").select("date", "sent_x_vix", "sent_x_vol"))


@query("c14_comovement", sql(f"SELECT date, {r6(roll(f'stddev_samp({S})', S, 20, w=WD))} AS roll_vol, {r6(roll(f'corr(sent_neg_mean, abs({S}))', S, 20, w=WD))} AS roll_corr FROM sent", "sent"))
def _(spark, sf):
    return round_all(text.comovement(X.sentiment(spark, sf), "sent_neg_mean", S).select("date", "roll_vol", "roll_corr"))


@query("k6_acceptance", sql(f"""SELECT 'empty_days' AS rule, (SELECT COUNT(*) FROM spine ANTI JOIN news USING (date)) AS violations
UNION ALL SELECT 'invalid_rows', (SELECT COUNT(*) FROM news WHERE NOT (date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') OR trim(headline) = '')
UNION ALL SELECT 'close_summaries', (SELECT COUNT(*) FROM news WHERE regexp_matches(headline, '{CLOSE_RE}'))
UNION ALL SELECT 'repeated_headlines', (SELECT coalesce(CAST(SUM(n - 1) AS BIGINT), 0) FROM (SELECT COUNT(*) AS n FROM news GROUP BY market, date, headline))""", "headlines",
    news="SELECT 'ALL' AS market, date, headline FROM headlines", spine="SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS date"))
def _(spark, sf):
    h = X.headlines(spark, sf).withColumn("market", F.lit("ALL"))
    return checks.acceptance(h, news.spine(h, "1995-01-01", "1998-12-31"), "1995-01-01", "1998-12-31", news.is_close_summary(patterns=CLOSE))
