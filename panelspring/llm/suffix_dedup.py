"""Removal of byte strings that occur more than once in a corpus, by a prefix-free parse and suffix order.

A rolling hash sets triggers: in every stretch of SPAN positions the position with the least hash. The triggers parse a
text into overlapping phrases (zones): the bytes of all strings of the wanted length that have one trigger, whose common
part is the phrase's core. A string has exactly one trigger, which depends on its bytes alone, so equal strings lie at
one place in phrases with equal cores, and each lies in a phrase whole: the suffixes of the dictionary's phrases, sorted
to that length, are the corpus order. What the phrases' counts in the parse settle is not sorted:

* a core that stands once in the parse settles its phrase: nothing is repeated in it;
* a phrase that stands more than once settles it too: all of it is repeated;
* of the rest (edges of repeated regions) the dictionary holds one occurrence of each distinct phrase, cut into parts of 8
  starts, which their own cores and zones settle in the same way.

The suffixes that are still open are range-sorted by their bytes: the suffix array of the dictionary's open phrases.
Neighbours in it that agree over the whole length are repeated strings, compared by byte, not by hash; the parse (where
each phrase stands) takes them back to the documents. Equal suffixes may spread over many tasks, of which only the first
and last strings are compared again.

Only phrases (about 1 for 60 bytes) are shuffled, plus the parts and suffixes of unsettled ones. Copies of a phrase,
however many, count as one entry of the dictionary. Groups by core or phrase are counted by partial sums, and the counts
join the entries as a table of their own, so that hot ones can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop_shared, mix, pieces, prefix_hash, span_hash, with_key, write_shared

LENGTH = 200
#: Bytes of the rolling window, and starts among which the trigger is chosen.
ROLL, SPAN = 16, 150
#: Starts in a part of a zone, and a bound on the parts of one.
PART, PARTS = 8, 32


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hashes, document number, trigger, first and last start) of each zone; positions count from the chunk's start.

    Strings of `length` bytes that start from first to last (inclusive) have their trigger in common.
    """
    prefix = prefix_hash(data)
    none = np.zeros(0, np.int64)
    span = min(SPAN, length - ROLL)
    if len(data) < length:
        return prefix, none, none, none, none
    at = np.arange(len(data) - ROLL + 1)
    bits = np.uint64(int(len(data)).bit_length())
    rank = (span_hash(prefix, at, at + ROLL) >> bits << bits) | at.astype(np.uint64)
    n = -(-len(rank) // span) * span
    padded = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(rank)] = rank
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(len(data) - length + 1)
    doc = np.searchsorted(offsets, starts, "right") - 1
    ok = starts + length <= offsets[doc + 1]
    starts, doc = starts[ok], doc[ok]
    if not len(starts):
        return prefix, none, none, none, none
    trigger = (np.minimum(behind[starts], ahead[starts + span - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return prefix, doc[new], trigger[new], starts[new], starts[last]


def dictionary_entries(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_key, at, core, zone, need): each phrase's first start (bytes from the text's start) and hashes, from docs (row_key, text)."""
    core = length - min(SPAN, length - ROLL) + 1

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row, base, data, offsets in pieces(batch, "text", length - 1):
                prefix, doc, trigger, lo, hi = parse(data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[doc])),
                        pa.array(lo - offsets[doc] + base[doc]),
                        pa.array(span_hash(prefix, trigger, trigger + core).view(np.int64)),
                        pa.array(span_hash(prefix, lo, hi + length).view(np.int64)),
                        pa.array(np.ones(len(doc), bool)),
                    ],
                    ["row_key", "at", "core", "zone", "need"],
                )

    return arrow(docs.select("row_key", "text"), run, "row_key long, at long, core long, zone long, need boolean")


def _parts_of(trigger: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zone number, part) of the parts of zones. Part b holds the starts from PART * b to PART * b + PART - 1 bytes before the trigger."""
    first, last = (trigger - hi) // PART, (trigger - lo) // PART
    n = last - first + 1
    zone = np.repeat(np.arange(len(trigger)), n)
    return zone, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def _lists(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.asarray(x if x is not None else [], np.int64) for x in batch.column(column).to_pylist()]


def _own(doc: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """(number in the step, row, its zones) for each piece of a step."""
    bounds = np.searchsorted(doc, np.arange(len(row) + 1))
    for i, r in enumerate(row.tolist()):
        yield i, r, slice(bounds[i], bounds[i + 1])


def _part_entries(candidates: DataFrame, length: int) -> DataFrame:
    """(row_key, at, core, zone, need) of the parts of zones to compare; at is PARTS * first start of the zone + part.

    core is the hash of what all strings of the part share, zone that of what they cover, as far as the text goes.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            compare, need = _lists(batch, "compare"), _lists(batch, "need")
            for row, base, data, offsets in pieces(batch, "text", length - 1):
                prefix, doc, trigger, lo, hi = parse(data, offsets, length)
                where = lo - offsets[doc] + base[doc]
                pick, needed = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
                for _, r, own in _own(doc, row):
                    pick[own] = np.isin(where[own], compare[r])
                    needed[own] = np.isin(where[own], need[r])
                z = np.flatnonzero(pick)
                k, part = _parts_of(trigger[z], lo[z], hi[z])
                z = z[k]
                d = doc[z]
                late = trigger[z] - PART * part  # the last start, were it in the zone
                early = late - (PART - 1)
                left, right = np.maximum(early, offsets[d]), np.minimum(late + length, offsets[d + 1])
                cut = ((left - early) * 4096 + (late + length - right)).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").take(pa.array(row[d])),
                        pa.array(where[z] * PARTS + part),
                        pa.array(mix(span_hash(prefix, late, early + length) + part.astype(np.uint64)).view(np.int64)),
                        pa.array(mix(span_hash(prefix, left, right) + cut).view(np.int64)),
                        pa.array(needed[z]),
                    ],
                    ["row_key", "at", "core", "zone", "need"],
                )

    return arrow(candidates.select("row_key", "text", "compare", "need"), run, "row_key long, at long, core long, zone long, need boolean")


def _starts(trigger: np.ndarray, lo: np.ndarray, hi: np.ndarray, where: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, index of the mark of each, marks found) for those marks, PARTS * where + part, whose zone is in where."""
    marks = marks[np.isin(marks // PARTS, where)]
    z, part = np.searchsorted(where, marks // PARTS), marks % PARTS
    late = np.minimum(trigger[z] - PART * part, hi[z])
    early = np.maximum(trigger[z] - PART * part - (PART - 1), lo[z])
    n = late - early + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - early, n), np.repeat(np.arange(len(marks)), n), marks


def _suffixes(candidates: DataFrame, length: int) -> DataFrame:
    """(row_key, start, string, need): the first `length` bytes of the suffixes that start in the parts to compare."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            compare, need = _lists(batch, "compare"), _lists(batch, "need")
            for row, base, data, offsets in pieces(batch, "text", length - 1):
                _, doc, trigger, lo, hi = parse(data, offsets, length)
                where = lo - offsets[doc] + base[doc]
                start, piece, needed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for i, r, own in _own(doc, row):
                    if len(compare[r]):
                        s, k, marks = _starts(trigger[own], lo[own], hi[own], where[own], compare[r])
                        start.append(s)
                        piece.append(np.full(len(s), i))
                        needed.append(np.isin(marks, need[r])[k])
                start, piece, needed = map(np.concatenate, (start, piece, needed))
                for a in range(0, len(start), 20_000):
                    s, i = start[a : a + 20_000], piece[a : a + 20_000]
                    string = data[s[:, None] + np.arange(length)]
                    ends = np.arange(len(s) + 1, dtype=np.int32) * length
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row_key").take(pa.array(row[i])),
                            pa.array(s - offsets[i] + base[i]),
                            pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(string))]),
                            pa.array(needed[a : a + 20_000]),
                        ],
                        ["row_key", "start", "string", "need"],
                    )

    return arrow(candidates.select("row_key", "text", "compare", "need"), run, "row_key long, start long, string binary, need boolean")


def suffix_order(suffixes: DataFrame, length: int) -> DataFrame:
    """suffixes (row_key, start, string, need) in byte order: row_key, start, need, part, rank, lcp, repeated, edge.

    part and rank (within the part) give the place in the order, lcp the bytes that a suffix has in common with the one
    before it, at most length; of a part's first suffix it is 0. repeated says that a neighbour within the part agrees over
    the whole length. The first and the last suffix of each part keep their string as edge, to be compared across parts.
    """
    keys = ["string", "row_key", "start"]

    def run(batches: Iterator[pa.RecordBatch]):
        part, held, before, rank = TaskContext.get().partitionId(), None, 0, 0

        def rows(batch: pa.RecordBatch, lcp: np.ndarray, same: np.ndarray, edge: list) -> pa.RecordBatch:
            n = batch.num_rows
            columns = [*(batch.column(c) for c in ("row_key", "start", "need")), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rank, rank + n)), pa.array(lcp.astype(np.int32)), pa.array(same), pa.array(edge, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["row_key", "start", "need", "part", "rank", "lcp", "repeated", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            raw = np.frombuffer(b"".join(batch.column("string").to_pylist()), np.uint8).reshape(-1, length)
            differ = np.ones((len(raw), length + 1), bool)
            differ[1:, :length] = raw[1:] != raw[:-1]
            lcp = differ.argmax(1)
            lcp[0] = before
            same = lcp == length
            n = len(raw) - 1
            if n:
                edge = [None] * n
                edge[0] = raw[0].tobytes() if rank == 0 else None
                yield rows(batch.slice(0, n), lcp[:n], same[:n] | same[1:], edge)
                rank += n
            held, before = batch.slice(n), int(lcp[n])
        if held is not None:
            yield rows(held, np.array([before]), np.array([before == length]), [held.column("string")[0].as_py()])

    ordered = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return arrow(ordered, run, "row_key long, start long, need boolean, part int, rank long, lcp int, repeated boolean, edge binary")


def _merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the union of intervals; those that touch are one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1]))) if len(first) else np.zeros(0, np.int64)
    return first[new], reach[np.concatenate((new[1:], [len(first)])) - 1] if len(first) else first[new]


def _cut(candidates: DataFrame, length: int) -> DataFrame:
    """(row_key, n_bytes, n_removed, spans, kept) of texts with repeated zones (whole), parts and single starts."""
    schema = "row_key long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            whole, parts, single = (_lists(batch, c) for c in ("whole", "parts", "starts"))
            first = [[s] for s in single]
            end = [[s + length] for s in single]
            for row, base, data, offsets in pieces(batch, "text", length - 1):
                _, doc, trigger, lo, hi = parse(data, offsets, length)
                shift = base[doc] - offsets[doc]
                where = lo + shift
                for i, r, own in _own(doc, row):
                    z = np.flatnonzero(np.isin(where[own], whole[r]))
                    s, _, _ = _starts(trigger[own], lo[own], hi[own], where[own], parts[r])
                    s = s + base[i] - offsets[i]
                    first[r] += [where[own][z], s]
                    end[r] += [(hi + shift)[own][z] + length, s + length]
            out = [[], [], [], [], []]
            for r, text in enumerate(batch.column("text")):
                text = (text.as_py() or "").encode()
                a, b = _merged(np.concatenate(first[r]), np.concatenate(end[r]))
                kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                for column, value in zip(out, (batch.column("row_key")[r].as_py(), len(text), int((b - a).sum()), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.binary()))], ["row_key", "n_bytes", "n_removed", "spans", "kept"])

    return arrow(candidates.select("row_key", "text", "whole", "parts", "starts"), run, schema)


def _settle(entries: DataFrame) -> DataFrame:
    """Entries (row_key, at, core, zone, need) of which the core is repeated, summed by text: (row_key, whole, compare, need).

    whole: places whose zone is repeated. compare: one place of each distinct zone, where a core has several. need:
    places to compare for their own sake, as their zone stands once. entries is a shared table.
    """
    cores = entries.groupBy("core").agg(F.count("*").alias("n"), F.min("zone").alias("lo"), F.max("zone").alias("hi")).where("n > 1")
    cores = write_shared(cores.select("core", (F.col("lo") != F.col("hi")).alias("varied")), "cores")
    several = write_shared(entries.join(cores, "core"), "several")
    drop_shared(cores)
    place = F.xxhash64("row_key", "at")
    varied = several.where("varied").drop("varied")
    zones = varied.groupBy("core", "zone").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
    zones = write_shared(zones, "zones")
    marked = varied.join(zones, ["core", "zone"])
    marked = marked.select("row_key", "at", "need", (F.col("copies") > 1).alias("settled"), (F.col("first") == place).alias("listed"))
    marked = marked.unionByName(several.where("NOT varied").select("row_key", "at", "need", F.lit(True).alias("settled"), F.lit(False).alias("listed")))
    # Rows that are equal share their key: each place counts once, however many there are.
    once = marked.where("(settled AND need) OR listed").groupBy("row_key", "at").agg(F.max("need").alias("need"), F.max("settled").alias("settled"), F.max("listed").alias("listed"))
    out = once.groupBy("row_key").agg(
        F.collect_list(F.when(F.col("settled") & F.col("need"), F.col("at"))).alias("whole"),
        F.collect_list(F.when(F.col("listed"), F.col("at"))).alias("compare"),
        F.collect_list(F.when(~F.col("settled") & F.col("need"), F.col("at"))).alias("need"),
    )
    out = write_shared(out, "marks")
    drop_shared(several, zones)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, a number for the id and the text: rows equal in both share it and get equal results, others never do."""
    return with_key(docs, "row_key", "doc_id", "text")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_key, n_bytes, n_removed, spans, kept) of the documents in which some string of `length` bytes is repeated.

    docs has row_key and text. A byte goes if some string of `length` bytes that covers it starts at two or more places
    of the corpus, in one document or several; strings never cross documents. All occurrences go, the first included.
    spans are the maximal removed runs, kept the remaining bytes. Null, empty and shorter texts have no such string.
    """
    docs = docs.select("row_key", "text")
    entries = write_shared(dictionary_entries(docs, length), "entries")
    marks = _settle(entries)
    drop_shared(entries)
    zoned = write_shared(docs.join(marks, "row_key"), "zoned")
    drop_shared(marks)
    entries = write_shared(_part_entries(zoned.where(F.size("compare") > 0), length), "part_entries")
    parts = _settle(entries)
    drop_shared(entries)
    parted = write_shared(zoned.select("row_key", "text", "whole").join(parts.withColumnRenamed("whole", "parts"), "row_key", "left"), "parted")
    drop_shared(zoned, parts)
    suffixes = write_shared(_suffixes(parted.where(F.size("compare") > 0), length), "suffixes")
    order = write_shared(suffix_order(suffixes, length), "order")
    drop_shared(suffixes)
    edges = order.where("edge IS NOT NULL")
    across = edges.groupBy("edge").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("edge")
    twice = order.where("repeated AND need").select("row_key", "start").unionByName(edges.where("need").join(across, "edge").select("row_key", "start"))
    starts = write_shared(twice.groupBy("row_key").agg(F.array_distinct(F.collect_list("start")).alias("starts")), "starts")
    drop_shared(order)
    return _cut(parted.join(starts, "row_key", "left"), length).where("n_removed > 0")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns and rows kept, with repeated strings cut out of text and n_chars (if there) counted anew.

    A character of which a part is cut goes whole. Rows with a null text stay as they are; rows that repeat are copies of
    one another, so of such texts of `length` bytes or more nothing is kept. An empty table gives an empty one.
    """
    own = with_key(docs.select("doc_id", "text", F.struct("*").alias("doc")), "row_key", "doc_id", "text")
    found = repeated(own.select("row_key", "text"), length).select("row_key", "kept").dropDuplicates(["row_key"])

    def decode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.as_py().decode("utf-8", "ignore") for x in batch.column(1)], pa.string())], ["row_key", "kept"])

    texts = arrow(found, decode, "row_key long, kept string")
    joined = own.select("row_key", "doc").join(texts, "row_key", "left")
    out = {"text": F.coalesce("kept", "doc.text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return joined.select(*[out.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])
