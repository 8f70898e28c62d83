"""Near-duplicate documents: MinHash bands for candidates, odd sketches for verification, exact sets for confirmation.

Documents with equal shingle sets form a class, one representative each. Representatives that share a band of MinHash
values are candidates. In every bucket each member is compared with one leader, the member whose own buckets are
fullest (the centre of a family of copies has the commonest values in every band), so work is linear in the bucket.
Buckets whose members are then still in different components compare across components, in blocks of bounded size, with
an odd sketch and the least hashes of each member's set. Odd sketches (parities of the MinHash samples) reject pairs
first; whole sets, which only candidates are joined with, confirm what is left.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop_shared, mix, shingles, ship, slices, write_shared
from .graph import components

ROWS = 5
SKETCH_BITS = 256
#: A pair whose sketches estimate a similarity under the threshold less this much is rejected: 6 deviations of the estimate.
MARGIN = 0.2
#: Members of a bucket on one side of a comparison.
BLOCK = 1024
#: Hashes of a set that blocks hold at most, the least ones, and 6 deviations of what they estimate.
FEW, FEW_MARGIN = 1024, 0.07
#: Greatest chance that no band of a pair right at the threshold agrees.
MISS = 1e-6


def bands_for(percent: int) -> int:
    """Bands of ROWS values that miss a pair at the threshold with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


@lru_cache(maxsize=8)
def hash_family(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of bands * ROWS hash functions."""
    n = bands * ROWS
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(1001, n + 1001, dtype=np.uint64))


def minhashes(u: np.ndarray, bands: int) -> np.ndarray:
    """bands * ROWS smallest values of a set under as many hash functions."""
    a, b = hash_family(bands)
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(u), 512):
        best = np.minimum(best, (u[i : i + 512, None] * a + b).min(0))
    return best


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples: each (number, value) flips one of SKETCH_BITS bits. Four 64-bit words a row."""
    n = len(samples)
    bit = (mix(samples + hash_family(samples.shape[1] // ROWS)[1]) >> np.uint64(56)).astype(np.int64)
    flips = np.zeros((n, SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.arange(n)[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.uint64)


def most_differing_bits(similarity: float, bands: int) -> int:
    """Differing bits that two sketches may have if their sets are estimated at least so similar."""
    changed = 2 * bands * ROWS * (1 - similarity)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * changed / SKETCH_BITS))))


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of each row of docs (doc_id, text); the last three null for an empty set."""
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    item = pa.field("element", pa.int64(), True)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = [np.unique(h) for h in shingles(data, offsets)]
                full = [i for i, u in enumerate(sets) if len(u)]
                samples = np.stack([minhashes(sets[i], bands) for i in full]) if full else np.zeros((0, bands * ROWS), np.uint64)
                number = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                keys = np.zeros((len(full), bands), np.uint64)
                for j in range(ROWS):
                    keys = mix(keys + samples[:, j::ROWS]) + number
                sketches = odd_sketches(samples)
                digest, buckets, words = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(full):
                    digest[i] = set_digest(sets[i])
                    buckets[i], words[i] = keys[k].view(np.int64), sketches[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(buckets, pa.list_(item)), pa.array(words, pa.list_(item))],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def set_digest(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the sorted distinct 64-bit shingle hashes, packed, of each row of docs (id, digest, text) whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = [np.unique(h) for h in shingles(data, offsets)]
                own = [i for i, (u, d) in enumerate(zip(sets, rows.column("digest").to_pylist())) if set_digest(u) == d]
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], ["id", "shingles"])

    return arrow(docs.select("id", "digest", "text"), run, "id long, shingles binary")


def differing_bits(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, 4)), F.bit_count(a[0].bitwiseXOR(b[0])))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of pairs whose sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow(both.select("a", "b", "of_a", "of_b"), run, "a long, b long")


def _across(pdf: pd.DataFrame, percent: int, most: int, least: int, margin: float) -> pd.DataFrame:
    """Candidate pairs of one block pair, of members of different components.

    Column few has the `least` smallest hashes of a member's set. Where these are both sets whole, a pair is given if it is
    a link, and one pair is enough for each two components that it joins; else if their smallest hashes, as a sketch of
    the union, estimate a similarity within `margin` of the threshold.
    """
    first = pdf["own"].iloc[0] == pdf["other"].iloc[0]
    ids, labels, sizes, own = pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["size"].to_numpy(), pdf["mine"].to_numpy() == pdf["own"].to_numpy()
    words = np.stack([np.asarray(x, np.int64) for x in pdf["sketch"]]).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["few"]]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x] = top.get(top[x], top[x])
        return x

    out = []
    right = np.arange(len(ids)) if first else np.flatnonzero(~own)
    for i in range(len(ids)) if first else np.flatnonzero(own):
        js = right[right > i] if first else right
        js = js[labels[js] != labels[i]]
        js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
        js = js[np.bitwise_count(words[js] ^ words[i]).sum(1) <= most]
        if not len(js):
            continue
        mine, theirs = sets[i], np.concatenate([sets[j] for j in js])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        both = np.add.reduceat(hit, np.cumsum([0] + [len(sets[j]) for j in js[:-1]]), dtype=np.int64)
        linked = 100 * both >= percent * (sizes[i] + sizes[js] - both)
        for j, ok in zip(js, linked):
            if sizes[i] > least or sizes[j] > least:
                union = np.union1d(mine, sets[j])[:least]
                common = np.intersect1d(mine, sets[j], assume_unique=True)
                if np.searchsorted(common, union[-1], "right") >= (percent / 100 - margin) * len(union):
                    out.append((ids[i], ids[j]))
            elif ok and (a := find(labels[i])) != (b := find(labels[j])):
                top[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _between(labelled: DataFrame, sketches: DataFrame, percent: int, most: int) -> DataFrame:
    """Candidate pairs (a, b) of members (id, bucket, n, label) whose bucket has several components: see _across().

    Members of a bucket's largest component meet the others only, not each other. Up to BLOCK members are one block;
    beyond that both sides are dealt over blocks of that size, and every block of the others meets all blocks.
    """
    counts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("all")).where("all > x.k AND all > 2")
    mixed = mixed.select("bucket", F.col("x.label").alias("largest"), F.ceil(F.col("x.k") / BLOCK).cast("int").alias("p"), F.ceil((F.col("all") - F.col("x.k")) / BLOCK).cast("int").alias("q"))
    rest = labelled.join(write_shared(mixed, "mixed"), "bucket").join(sketches, "id")
    large, one, p, q = F.col("label") == F.col("largest"), F.col("n") <= BLOCK, F.col("p"), F.col("q")
    mine = F.when(one, 0).when(large, F.pmod(F.xxhash64("id"), p)).otherwise(p + F.pmod(F.xxhash64("id"), q)).cast("int")
    meets = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.when(large, p).otherwise(0), p + q - 1))
    rest = rest.withColumn("mine", mine).withColumn("j", F.explode(meets)).withColumn("own", F.least("mine", "j")).withColumn("other", F.greatest("mine", "j"))
    ship(rest.sparkSession)
    least, margin = FEW, FEW_MARGIN
    return rest.groupBy("bucket", "own", "other").applyInPandas(lambda pdf: _across(pdf, percent, most, least, margin), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct 5-word shingles (words
    between ASCII white space, A-Z lower-cased; shorter texts have one shingle). component_id is the smallest id
    reachable, the own one included; kept says that it is the own one. Null, empty and blank texts have no shingle and
    no link. A row with a null id has no link, a null component and is kept. Rows that share an id are judged by their own
    texts. The chance that the bands miss a pair at exactly `percent` is at most MISS. An empty table gives an empty one;
    columns other than doc_id and text are not read.
    """
    bands = bands_for(percent)
    sig = write_shared(signatures(docs, bands), "signatures")
    usable = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("x"))
    # A class is its 128-bit digest; its number is given once, as the table is written.
    reps = write_shared(reps.select("digest", F.monotonically_increasing_id().alias("id"), "x.*"), "classes")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = write_shared(buckets.join(sizes, "bucket"), "members")
    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    fame = write_shared(fame, "fame")
    leaders = members.join(fame, "id").groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("id")).alias("i"))).alias("x")).select("bucket", (-F.col("x.i")).alias("b"))
    pairs = members.join(leaders, "bucket").where("id != b").select(F.col("id").alias("a"), "b").distinct()
    sketches = reps.select("id", "sketch", F.col("n_shingles").alias("size"))
    most = most_differing_bits(percent / 100 - MARGIN, bands)
    pairs = pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
    pairs = write_shared(pairs.where(differing_bits(F.col("x"), F.col("y")) <= most).select("a", "b"), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = write_shared(shingle_sets(texts.join(reps.join(fame.select("id"), "id").select("doc_id", "id", "digest"), "doc_id")), "sets")
    if sets.count() != sets.select("id").distinct().count():
        sets = write_shared(sets.dropDuplicates(["id"]), "sets")
    links = write_shared(confirm(pairs, sets, percent), "links")
    found = components(links)
    labelled = members.join(found.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    few = sketches.join(sets.select("id", F.substring("shingles", 1, 8 * FEW).alias("few")), "id")
    joined = write_shared(confirm(write_shared(_between(labelled, few, percent, most), "across"), sets, percent), "more_links")
    if not joined.isEmpty():
        links, before = write_shared(links.unionByName(joined), "links"), (links, found)
        found = components(links)
        drop_shared(*before)
    drop_shared(members, fame, pairs, sets, links)
    classes = reps.select("digest", "id", "doc_id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("least"))
    classes = classes.join(least, "label").select("digest", "least")
    out = sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
