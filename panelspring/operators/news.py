"""News selection: filters, relevance, daily ranks and coverage reports over (market, date, headline, url, section ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checks

# The five named close-summary phrases and documented variants of them.
CLOSE_PATTERNS = [
    "closed at", "stocks close", "ended the day", "after the bell", "market close", "markets close", "close higher", "close lower",
    "closes higher", "closes lower", "closed higher", "closed lower", "ended higher", "ended lower", "at the close", "closing bell",
]
# Default weights of the relevance score, (pattern, weight).
SECTION_WEIGHT, HIGH_WEIGHT, LOW_WEIGHT, NOISE_WEIGHT, THRESHOLD = 2, 3, 1, -3, 3
NOISE = ["obituary", "review", "crossword", "podcast", "quiz", "football", "celebrity"]
SECTIONS = ["business", "money", "economy", "markets"]
# Six topics.
TOPICS = {
    "policy": ["fed", "rate", "central bank"], "macro": ["inflation", "jobs", "gdp"], "trade": ["tariff", "trade", "sanction"],
    "market": ["stocks", "shares", "market"], "company": ["profit", "merger", "earnings"], "commodity_fx": ["oil", "gold", "dollar"],
}


def any_of(patterns: list[str]) -> str:
    return f"(?i)({'|'.join(patterns)})"


def has_word(c: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text between other characters than letters, whatever its case."""
    return F.rlike(F.lower(c), F.lit(rf"(^|[^\p{{L}}])({'|'.join(words)})([^\p{{L}}]|$)"))


def is_close_summary(c: Column | str = "headline", patterns: list[str] = CLOSE_PATTERNS) -> Column:
    """Null headlines are no summaries."""
    return F.coalesce(F.rlike(c if isinstance(c, Column) else F.col(c), F.lit(any_of(patterns))), F.lit(False))


def drop_close_summaries(df: DataFrame, patterns: list[str] = CLOSE_PATTERNS) -> DataFrame:
    return df.where(~is_close_summary(patterns=patterns))


def flag_close_summary(df: DataFrame, patterns: list[str] = CLOSE_PATTERNS) -> DataFrame:
    return df.withColumn("is_close_summary", is_close_summary(patterns=patterns))


def valid_rows(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from start to end (inclusive) whose headline is not blank."""
    return df.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & (F.trim("headline") != ""))


def dedup_headlines(df: DataFrame, order: list[str]) -> DataFrame:
    """One row for each market, date and headline: the first by `order`."""
    w = Window.partitionBy("market", "date", "headline").orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_urls(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a url on the day after an earlier row of it go, as do further rows of the day (first by `order` stays)."""
    w = Window.partitionBy("market", "url").orderBy("date", *order)
    gap = F.datediff("date", F.lag("date").over(w))
    return df.withColumn("__g", gap).where("__g IS NULL OR __g > 1").drop("__g")


def url_date_tolerance(df: DataFrame, days: int = 1) -> DataFrame:
    """Rows whose url date is missing or within `days` of the page's date, which counts."""
    return df.where(F.col("url_date").isNull() | (F.abs(F.datediff("date", "url_date")) <= days))


def eligible_sections(df: DataFrame, allow: list[str]) -> DataFrame:
    """Rows of the allowed sections; a day that has none keeps all its rows."""
    ok = F.coalesce(F.col("section").isin(allow), F.lit(False))
    some = F.max(ok.cast("int")).over(Window.partitionBy("market", "date"))
    return df.withColumn("__some", some).where(ok | (F.col("__some") == 0)).drop("__some")


def noise_penalty(c: Column, noise: list[str] = NOISE, weight: int = NOISE_WEIGHT) -> Column:
    return F.when(has_word(c, noise), weight).otherwise(0)


def relevance(df: DataFrame, high: list[str], low: list[str], sections: list[str] = SECTIONS, noise: list[str] = NOISE) -> DataFrame:
    """relevance_score: section weight, plus weight once for any high and any low keyword, less the noise penalty."""
    h = F.coalesce("headline", F.lit(""))
    score = F.when(F.col("section").isin(sections), SECTION_WEIGHT).otherwise(0)
    for words, weight in ((high, HIGH_WEIGHT), (low, LOW_WEIGHT)):
        score = score + F.when(has_word(h, words), weight).otherwise(0)
    return df.withColumn("relevance_score", score + noise_penalty(h, noise))


def _ranked(order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy("market", "date").orderBy(F.col("relevance_score").desc(), *order))


def daily_top_k(df: DataFrame, k: int = 10, threshold: int = THRESHOLD, order: tuple[str, ...] = ("url",)) -> DataFrame:
    """The k best rows of each day with a score of at least threshold, with day_rank; ties go by `order`."""
    return df.where(F.col("relevance_score") >= threshold).withColumn("day_rank", _ranked(list(order))).where(F.col("day_rank") <= k)


def guarantee_daily(df: DataFrame, k: int = 10, threshold: int = THRESHOLD, order: tuple[str, ...] = ("url",)) -> DataFrame:
    """As daily_top_k, but a day with nothing at the threshold keeps its best row, with is_fallback = 1.

    If the frame has is_close_summary, summaries rank last and serve only days that have nothing else.
    """
    day = Window.partitionBy("market", "date")
    score, keys = F.col("relevance_score"), list(order)
    if "is_close_summary" in df.columns:
        df = df.withColumn("__others", F.max((~F.col("is_close_summary")).cast("int")).over(day)).where("NOT is_close_summary OR __others = 0").drop("__others")
    ranked = df.withColumn("day_rank", _ranked(keys)).withColumn("__best", F.max(score).over(day))
    return ranked.where(((score >= threshold) & (F.col("day_rank") <= k)) | ((F.col("__best") < threshold) & (F.col("day_rank") == 1))).withColumn("is_fallback", (score < threshold).cast("int")).drop("__best")


def holiday_supplement(main: DataFrame, other: DataFrame, order: tuple[str, ...] = ("url",)) -> DataFrame:
    """main, and for the days without a row of main the best row of other."""
    missing = other.join(main.select("market", "date").distinct(), ["market", "date"], "left_anti")
    best = missing.withColumn("__n", _ranked(list(order))).where("__n = 1").drop("__n")
    return main.withColumn("supplement", F.lit(0)).unionByName(best.withColumn("supplement", F.lit(1)))


def weak_dates(df: DataFrame, most: int = 1) -> DataFrame:
    return df.groupBy("market", "date").agg(F.max("relevance_score").alias("best")).where(F.col("best") <= most)


def spine(df: DataFrame, start: str, end: str) -> DataFrame:
    """Every market of df on every day from start to end."""
    return df.select("market").distinct().select("market", F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))


def calendar_coverage(df: DataFrame, start: str, end: str) -> DataFrame:
    """Days of the spine without news."""
    return spine(df, start, end).join(df.select("market", "date"), ["market", "date"], "left_anti")


def yearly_report(df: DataFrame) -> DataFrame:
    """By market and year, with totals (year null, then market null too): rows, rows a day with news, fallback share."""
    return df.rollup("market", F.year("date").alias("year")).agg(F.count("*").alias("n"), (F.count("*") / F.count_distinct("date")).alias("per_day"), F.avg(F.col("is_fallback").cast("double")).alias("fallback_share"))


def audit_sample(df: DataFrame, n: int = 20, seed: int = 7) -> DataFrame:
    """n days in the order of an arithmetic hash of the date: the same on every run and engine."""
    day = F.datediff("date", F.to_date(F.lit("1970-01-01"))).cast("long")
    return df.select("date").distinct().withColumn("rank", F.pmod(day * 48271 + seed * 69621, F.lit(65521))).orderBy("rank", "date").limit(n)


def tag_topics(df: DataFrame, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    """One boolean topic_* for each topic; a headline may have several."""
    return df.withColumns({f"topic_{t}": F.coalesce(has_word(F.col("headline"), words), F.lit(False)) for t, words in topics.items()})


def news_coverage(news: DataFrame, trading_days: DataFrame, train_end: str) -> DataFrame:
    """Share of trading days with news by market, overall and up to train_end."""
    days = trading_days.select("market", "date").distinct().join(news.select("market", "date").distinct().withColumn("has", F.lit(1.0)), ["market", "date"], "left")
    has = F.coalesce("has", F.lit(0.0))
    return days.groupBy("market").agg(F.count("*").alias("days"), F.avg(has).alias("coverage"), F.avg(F.when(F.col("date") <= F.to_date(F.lit(train_end)), has)).alias("train_coverage"))


def exclude_fallback(df: DataFrame) -> DataFrame:
    return df.where("is_fallback = 0")


def thin_coverage(df: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """News of about `share` of the days, chosen by an arithmetic hash of the date."""
    day = F.datediff("date", F.to_date(F.lit("1970-01-01"))).cast("long")
    return df.where(F.pmod(day * 48271 + seed * 69621, F.lit(65521)) < int(share * 65521))


def fallback_by_weekday(df: DataFrame) -> DataFrame:
    return df.groupBy("market", F.weekday("date").alias("weekday")).agg(F.avg(F.col("is_fallback").cast("double")).alias("fallback_share"), F.count("*").alias("n"))


def candidates_per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("market", "date").agg(F.count("*").alias("n_cand"))


def reselect(candidates: DataFrame, market: str, start: str, end: str, k: int = 10, threshold: int = THRESHOLD, order: tuple[str, ...] = ("url",), stored: DataFrame | None = None) -> DataFrame:
    """Select again from stored candidates; market and dates are filters that reach a partitioned scan.

    With `stored`, an earlier selection, nothing is selected anew but compared: see checks.differing_days(). Its columns count.
    """
    part = candidates.where((F.col("market") == market) & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    chosen = guarantee_daily(part, k, threshold, order)
    if stored is None:
        return chosen
    return checks.differing_days(stored.where((F.col("market") == market) & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))), chosen)
