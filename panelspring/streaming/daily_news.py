"""Incremental daily news: a watermarked stream of headlines to daily topic aggregates, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.news import is_close_summary
from ..operators.text import SENTIMENT, sentiment_aggregates


def daily(stream: DataFrame, topic: str = "topic", late: str = "2 days") -> DataFrame:
    """(day, topic, the nine daily aggregates) of a stream (ts, url, topic, headline, pos, neg, neu): close summaries and repeated urls go.

    A url counts once within the watermark; rows later than `late` are dropped.
    """
    rows = stream.where(~is_close_summary()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = rows.dropDuplicatesWithinWatermark(["url"])
    agg = once.groupBy(F.window("ts", "1 day").alias("w"), topic).agg(*sentiment_aggregates())
    return agg.select(F.to_date("w.start").alias("day"), topic, *SENTIMENT)


def upsert(stream: DataFrame, path: str, checkpoint: str, topic: str = "topic") -> StreamingQuery:
    """Run over what is there and stop; each batch replaces the days it has under path (day=), so a repeated batch is harmless."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return daily(stream, topic).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
