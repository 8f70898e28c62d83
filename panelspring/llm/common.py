"""Helpers shared by the text operators: shared tables and vectorised byte-level text handling."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles, at least one document.
CHUNK_BYTES = 400_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application, as a small archive that the driver serves."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="panelspring-")) / "panelspring-llm.zip"
        with zipfile.ZipFile(archive, "w") as z:
            z.write(here.parent / "__init__.py", "panelspring/__init__.py")
            for f in sorted(here.glob("*.py")):
                z.write(f, f"panelspring/llm/{f.name}")
        context.addPyFile(str(archive))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and they keep the memory of their largest one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers, which give memory back after each task."""
    ship(df.sparkSession)

    def run(batches):
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a single machine a temporary one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="panelspring-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelspring/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables of write_shared() that no later step reads, and let go of finished shuffles.

    Spark removes shuffle files when the driver's JVM collects what refers to them, which may be much later; asking for
    that here keeps a many-step operator's disk at its largest step, not at the sum of all.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def id_bucket(col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


#: Bits of a row key's hash; tests take fewer.
KEY_BITS = 62


def with_key(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """df with column `name`, a 64-bit number that two rows share only if they agree in cols (nulls are values of their own).

    A hash, doubled. Where rows of different MD5 share it (in 10^10 rows a handful), they get odd numbers of their own instead,
    so no two different rows ever share a key. The table is read once more, for the hashes alone.
    """
    text = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols])
    digest, code = F.md5(text), F.shiftleft(F.xxhash64(*cols).bitwiseAND((1 << KEY_BITS) - 1), 1)
    hashes = df.select(code.alias("__h"), digest.alias("__d"))
    clash = hashes.groupBy("__h").agg(F.min("__d").alias("a"), F.max("__d").alias("b")).where("a != b").select("__h")
    clash = write_shared(clash, "clash")
    n = clash.count()
    if not n:
        drop_shared(clash)
        return df.withColumn(name, code)
    members = hashes.join(F.broadcast(clash) if n <= 100_000 else clash, "__h").distinct()
    members = write_shared(members.withColumn("__k", F.shiftleft(F.monotonically_increasing_id(), 1) + 1), "members")
    met = df.withColumns({"__h": code, "__d": digest}).join(F.broadcast(members) if n <= 100_000 else members, ["__h", "__d"], "left")
    return met.select(*df.columns, F.coalesce("__k", "__h").alias(name))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about `most` bytes of text: (rows, bytes, offsets of len(rows)+1); null is empty."""
    if not batch.num_rows:
        return
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def pieces(batch: pa.RecordBatch, column: str, overlap: int, most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """slices() with long texts cut into pieces of most bytes, each with the next `overlap` bytes of its text behind it.

    (row of each piece in the batch, where it begins in its text, bytes, offsets); a string of overlap + 1 bytes lies in
    exactly one piece, so that memory does not grow with the longest text.
    """
    at = 0
    for rows, data, offsets in slices(batch, column, most):
        if rows.num_rows == 1 and len(data) > 2 * most:
            for base in range(0, len(data) - overlap, most):
                part = data[base : base + most + overlap]
                yield np.array([at]), np.array([base]), part, np.array([0, len(part)])
        else:
            yield np.arange(at, at + rows.num_rows), np.zeros(rows.num_rows, np.int64), data, offsets
        at += rows.num_rows


_MULT, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["p"]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for key, base in (("p", _MULT), ("i", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for the polynomial hash of any substring: see span_hash."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal strings have equal hashes wherever they stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each document: (start, end, number of the first word of each document, and the total)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_pieces(data: np.ndarray, most: int = CHUNK_BYTES, back: int = 25) -> Iterator[np.ndarray]:
    """A text cut at words into pieces of about most bytes and more than `back` words, each but the first with the last `back` words before it.

    Whatever spans at most `back` words of the text stands whole in some piece, and pieces hold nothing that the text does not.
    """
    solid = ~_SPACE[data]
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    first, begin = 0, 0
    while True:
        stop = max(int(np.searchsorted(starts, begin + most)), first + back + 1)
        if stop >= len(starts):
            yield data[begin:]
            return
        yield data[begin : starts[stop]]
        first = stop - back
        begin = int(starts[first])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the number of each document's first word."""
    start, end, first = words(data, offsets)
    return span_hash(prefix_hash(_LOWER[data]), start, end), first


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5, cut: bool = True) -> list[np.ndarray]:
    """For each document the hashes of its word shingles, in text order, repeats included.

    A document of fewer than `width` words, but at least one, has its whole sequence as its one shingle. A very long one
    that stands alone is read in pieces, and a few of its shingles are there twice.
    """
    if cut and len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
        return [np.concatenate([shingles(part, np.array([0, len(part)]), width, False)[0] for part in word_pieces(data)])]
    wh, first = word_hashes(data, offsets)
    k = powers(width)[0]
    total = np.zeros(len(wh), np.uint64)
    for j in range(min(width, len(wh))):
        total[: len(wh) - j] += wh[j:] * k[j]
    total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(total[a : b - width + 1])
        elif b > a:
            out.append(mix((wh[a:b] * k[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(total[:0])
    return out
