"""Tables of the panel: readers with declared schemas, and sinks by market and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = "market string, symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint"
INDICATORS = "market string, date date, code string, value double"
HEADLINES = "year int, month int, date date, headline string, source string"
CANDIDATES = HEADLINES + ", section string, url string, relevance_score double, day_rank int, is_fallback int, is_close_summary boolean"
LEXICON = "token string, sentiment string, polarity double"
VECTORS = "market string, date date, id string, vec array<float>"


#: Text files have a header, quotes doubled within quotes, and blanks as they are.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _read(spark: SparkSession, path: str, schema: str, format: str, multiline: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).format(format)
    return (reader.options(**_CSV, multiLine=multiline) if format == "csv" else reader).load(path)


def write_table(df: DataFrame, path: str, schema: str, format: str = "parquet") -> None:
    """df under path in one of the layouts of this module: its columns by name, null where df has none."""
    columns = [c.split() for c in schema.split(", ")]
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])
    (out.write.options(**_CSV) if format == "csv" else out.write).format(format).save(path)


def read_prices(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Daily prices; filters on market and date reach the scan."""
    return _read(spark, path, PRICES, format)


def read_indicators(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, path, INDICATORS, format)


def read_headlines(spark: SparkSession, path: str, format: str = "csv", multiline: bool = False) -> DataFrame:
    """The older five-column layout; a missing date comes from year and month, on the first. multiline: headlines may hold line breaks."""
    df = _read(spark, path, HEADLINES, format, multiline)
    return df.withColumn("date", F.coalesce("date", F.make_date("year", "month", F.lit(1))))


def read_candidates(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, path, CANDIDATES, format)


def read_lexicon(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    return _read(spark, path, LEXICON, format)


def read_vectors(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, path, VECTORS, format)


def write_daily(df: DataFrame, path: str) -> None:
    """Daily news under market=/year=, replacing only the partitions that df has."""
    df.withColumn("year", F.year("date")).repartition("market", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "year").parquet(path)


def write_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """Metrics of one run under run_id=; writing a run again replaces it and leaves others alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def pending_dates(spine: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("market", "date")) -> DataFrame:
    """Dates of the spine that the ledger lacks."""
    return spine.join(ledger.select(*keys), list(keys), "left_anti")


def pages_to_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, n, headline, url, section, url_date): every link of an archive page with its anchor text, blank ones left out.

    section is the url's first path step, url_date a yyyy/mm/dd or yyyy-mm-dd in it.
    """
    link = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    urls, texts = F.regexp_extract_all("html", F.lit(link), 1), F.regexp_extract_all("html", F.lit(link), 2)
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(urls.alias("url"), texts.alias("text"))).alias("n", "x"))
    text = F.trim(F.regexp_replace(F.regexp_replace("x.text", "<[^>]*>", " "), r"\s+", " "))
    day = F.regexp_extract("x.url", r"(\d{4})[/-](\d{2})[/-](\d{2})", 0)
    out = rows.select("page_id", "n", text.alias("headline"), F.col("x.url").alias("url"), F.regexp_extract("x.url", r"^(?:[a-z]+://[^/]*)?/([^/?#]*)", 1).alias("section"), F.try_to_date(F.when(day != "", F.replace(day, F.lit("/"), F.lit("-")))).alias("url_date"))
    return out.where("headline != ''")
