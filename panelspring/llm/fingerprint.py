"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's shingles. Sketches merge across parts by keeping the k
smallest of their union, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, shingles, slices

K = 256
_RANGE = float(1 << 48)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    h = hashes >> np.uint64(16)
    u = np.unique(h)
    return u[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both parts."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles, exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / _RANGE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    j, n = resemblance(a, b, k), distinct(merge(a, b, k), k)
    return min(1.0, j * n / distinct(a, k)) if len(a) else 1.0


def to_text(a: np.ndarray) -> str:
    """6 bytes a hash, big-endian, as base64."""
    return base64.b64encode(np.ascontiguousarray(a.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offsets in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"]), "t"):
        out += [sketch(h, k) for h in shingles(data, offsets)]
    return out


def fingerprint(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), k: int = K) -> DataFrame:
    """Columns `keep` of docs with fingerprint (text form of the sketch) and n_distinct (estimated shingles), one row per row.

    Null, empty and blank texts have the empty fingerprint and 0.0; equal texts have equal ones; texts are read whole. A
    kept column of one of these names gives way.
    """
    kept = docs.select(*[c for c in keep if c not in ("fingerprint", "n_distinct")], F.col("text").alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["fingerprint string", "n_distinct double"])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "__text"):
                got = [sketch(h, k) for h in shingles(data, offsets)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([to_text(g) for g in got], pa.string()), pa.array([distinct(g, k) for g in got], pa.float64())], [*rows.schema.names[:-1], "fingerprint", "n_distinct"])

    return arrow(kept, run, out)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows of docs (doc_id, text) dealt into ranges of descending doc_id, each range followed by the first row of the next.

    Columns: part (ascending along the order), doc_id, text, guest (true for the row lent by the next range; after the
    last range the first lends its row). Within a part rows are sorted; a part stands in one partition. Null ids come
    last; equal ids go by a hash of the text, then the text. ranges is the number of ranges, the number of shuffle
    partitions unless given: that many bounds, not more, are known to the driver, however large docs is. Ids that alone
    fill a range, null among them, are cut further by the hash. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    want = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    bounds = {int(b) for b in docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / want for i in range(1, want)], 0.2 / want)} if want > 1 else set()
    # An id with more rows than a range ought to have is a bound itself; there are fewer of them than ranges.
    hot = docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin(sorted(bounds))).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > n // want).collect()
    pieces = {r["doc_id"]: -(-r["n"] * want // n) for r in hot}
    cuts = np.array(sorted(bounds | {i - s for i in pieces if i is not None for s in (0, 1)}), np.int64)
    place = {i: len(cuts) - int(np.searchsorted(cuts, i, "left")) for i in pieces if i is not None} | {None: len(cuts) + 1}
    size = np.ones(len(cuts) + 2, np.int64)
    for i, k in pieces.items():
        size[place[i]] = k
    offset = np.cumsum(size) - size

    @F.pandas_udf("int")
    def part(ids: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        """Number of the range: one for each stretch between bounds, several by the hash for ids that fill more than one."""
        at = np.where(none.to_numpy(), len(cuts) + 1, len(cuts) - np.searchsorted(cuts, ids.to_numpy(np.int64), "left"))
        high = (h.to_numpy(np.int64) >> 33) + (1 << 30)  # 0 to 2^31 - 1, ascending with the hash
        return pd.Series((offset[at] + (high * size[at] >> 31)).astype(np.int32))

    dealt = docs.withColumn("part", part(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), "h"))
    heads = dealt.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("head")).orderBy("part").collect()
    if not heads:
        return dealt.select("part", "doc_id", "text", F.lit(False).alias("guest"))
    ring = [(heads[i - 1]["part"], heads[i]["part"], heads[i]["head"]["doc_id"], ~heads[i]["head"]["h"]) for i in range(len(heads))]
    lend = F.broadcast(docs.sparkSession.createDataFrame(ring, "part_to int, part int, head long, head_h long"))
    # Rows equal in id and hash have equal texts but for a collision, in which the least goes first.
    guests = dealt.join(lend, "part").where(F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h"))).groupBy("part_to", "doc_id", "h").agg(F.min("text").alias("text"))
    guests = guests.select(F.col("part_to").alias("part"), "doc_id", "h", "text", F.lit(True).alias("guest"))
    both = dealt.select("part", "doc_id", "h", "text", F.lit(False).alias("guest")).unionByName(guests)
    return both.repartitionById(int(size.sum()), F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


def edited_pairs(docs: DataFrame, k: int = K, run_chars: int = 1_000_000) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses.

    Edited: the last floor(n_chars/2) code points give way to the first as many (or all) of the next document by
    descending doc_id, the last document's next being the first. Null texts are empty. Rows with equal ids follow one
    another by a hash of their texts; null ids come last. Of one row alone the next is that row. One row per row of docs;
    columns other than doc_id and text are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_distinct", pa.float64())])

    def flush(rows: list[tuple]) -> tuple[pa.RecordBatch, list[tuple]]:
        """All rows but the last of a run; the last waits for the one that follows."""
        texts, known = [r[2] for r in rows], rows[0][4]
        own = ([known] if known is not None else []) + sketches(texts[known is not None :], k)
        at = [i for i in range(len(rows) - 1) if not rows[i][3]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
        got = sketches(edited, k)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_text(own[i]) for i in at], pa.string()),
                pa.array([to_text(g) for g in got], pa.string()),
                pa.array([resemblance(own[i], g, k) for i, g in zip(at, got)], pa.float64()),
                pa.array([resemblance(own[i], own[i + 1], k) for i in at], pa.float64()),
                pa.array([distinct(own[i], k) for i in at], pa.float64()),
            ],
            schema=fields,
        )
        return out, [rows[-1][:4] + (own[-1],)]

    def run(batches: Iterator[pa.RecordBatch]):
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            ids, guests, col = batch.column("doc_id").to_pylist(), batch.column("guest").to_pylist(), batch.column("text")
            for i in range(batch.num_rows):
                text = col[i].as_py()
                rows.append((0, ids[i], text, guests[i], None))
                size += len(text)
                if size >= run_chars and len(rows) > 1:
                    out, rows = flush(rows)
                    size = 0
                    yield out
        if len(rows) > 1:
            yield flush(rows)[0]

    return arrow(with_next(docs), run, schema)
