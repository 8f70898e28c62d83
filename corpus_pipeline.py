"""Corpus preparation: quality, near-duplicates, repeated strings, benchmark overlap, and the training order.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() applies them in turn, each
result written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspring.llm import decontam, minhash, mixing, quality, suffix_dedup
from panelspring.llm.common import drop_shared, id_bucket, with_key, write_shared

#: Per cent of two documents' shingles that near-duplicates have in common at least.
SIMILARITY = 80

#: A number that tells the rows of a stage apart unless they are equal, whatever their ids.
KEY = "__key"


def one_of_each(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """keyed with one row of each KEY, where keys has the KEY of every row. Only rows whose key repeats are shuffled."""
    again = write_shared(keys.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY), "again")
    if again.isEmpty():
        return keyed
    return keyed.join(again, KEY, "left_anti").unionByName(keyed.join(again, KEY, "left_semi").dropDuplicates([KEY]))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; labels of the held-out third are not used.

    Each row is judged by its own text, repeated rows alike; null and empty texts get the model's bias. Columns named like
    the classifier's results pass through. Without labels of both classes all rows share one verdict; no rows, none.
    """
    held = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))
    model = quality.fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return quality.score_quality(docs, model, tuple(docs.columns), names=("__score", "__predicted")).where("__predicted = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least id (nulls last), of each group of near-duplicates, rows that repeat it included.

    Near-duplicates have a similarity of 0.8 or more of their sets of five-word shingles. Rows are judged by their own
    texts, whatever their ids (rows that share an id, or have none, are rows of their own); null, empty and blank texts
    have no duplicates and stay. No rows, none; other columns pass through.
    """
    keyed = with_key(docs, KEY, "doc_id", "text")
    found = minhash.near_duplicates(keyed.select(F.col(KEY).alias("doc_id"), "text"), SIMILARITY).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias(KEY), F.col("component_id").alias("__group"))
    rows = write_shared(found.join(keyed.select(KEY, "doc_id").distinct(), KEY), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", KEY)).getField(KEY)
    groups = rows.groupBy("__group").agg(first.alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    # A table of its own, so that a join can split the rows of a large group.
    groups = write_shared(groups, "groups")
    lost = rows.join(groups, "__group").where(F.col(KEY) != F.col("__first")).select(KEY).distinct()
    return one_of_each(keyed.join(lost, KEY, "left_anti"), rows).select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that stand at several places; all of these go, the first included.

    Every row stays, with its own columns; a null text stays null, a text that is repeated whole becomes empty. n_chars is
    counted anew. No rows, none.
    """
    return suffix_dedup.remove_repeats(docs)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item, each judged by its own text, whatever its id; rows that repeat go or stay together.

    Null texts and texts without a token stay. No rows, none; other columns pass through.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes, in training order: doc_id, source, size, copy, position, text.

    Rows that repeat, share an id or have none are placed each for itself; a null source is one of its own, a null text has
    no words and comes with the copies around it. No rows, none.
    """
    keyed = with_key(docs, KEY, "doc_id", "source", "text")
    mixed = write_shared(mixing.mix(keyed, keep=(KEY,)), "mixed")
    order = mixing.curriculum(mixed, mixing.PHASES).select("doc_id", "source", "size", "copy", "position", KEY)
    texts = one_of_each(keyed.select(KEY, "text"), mixed)
    # Merged whatever the size of order, so that small runs show the shuffle of texts that large ones need.
    return mixing.in_order(order.hint("merge").join(texts, KEY).select("doc_id", "source", "size", "copy", "position", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_overlap),
    ("mixing sources to target weights", training_order),
]

#: The model fits and hashes of the stages have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, write_shared(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            drop_shared(before)
    return docs
