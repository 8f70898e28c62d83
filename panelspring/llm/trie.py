"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A conversation is the sequence of digests of its turns. Sequences are range-sorted; within a partition the edges between
neighbours carry the length of their longest common prefix (LCP), and are joined in descending depth: every merge of
components makes a branching node, and every sequence a node at its own depth. Nodes that hold neither the first nor the
last sequence of their partition are complete. What is left of a partition is its contracted forest: its first and last
sequence, the depth at which these meet, and on each the open nodes with the sums of all complete nodes below them. The
contracted forests (a few rows a partition) are merged across the boundaries by the same union-find.

Branching and end nodes stand for the chains of single-child nodes above them, which are written out last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, write_shared

#: Bytes of a turn's digest.
WIDTH = 16
#: Members whose ids, as text, are one row on their way to the task that hashes them.
CHUNK_IDS = 10_000
#: Open nodes up to this number are broadcast (about 50 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()

_OUT = pa.schema(
    [
        ("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_ref", pa.int64()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ref", pa.int64()), ("item", pa.int64()),
        ("edge", pa.int64()), ("words", pa.int64()), ("seq", pa.binary()), ("counts", pa.list_(pa.int32())), ("ids", pa.string()),
    ]
)
_DDL = (
    "kind string, conv_id long, depth long, parent_conv_id long, parent_ref long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "ref long, item long, edge long, words long, seq binary, counts array<int>, ids string"
)


def turn_digest(role: Column, text: Column) -> Column:
    """128-bit digest of a turn, as hex: the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's array of (digest, words), ordered by turn; a null turn comes first, ties go by digest.

    Only digests and word counts are shuffled, not texts. Rows with a null conv_id belong to no conversation.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), "digest", "words")))
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x.digest.alias("digest"), x.words.alias("words"))).alias("turns"))


class Forest:
    """Components of a run of sorted sequences, merged in descending depth.

    Events are edges (depth, i: sequences i and i + 1 meet) and touches (depth, i: a node stands there, with sums). At each
    depth all edges join first; every component that an edge or a touch concerns then has one node at this depth, with the
    component's former top nodes as its children.
    """

    def __init__(self, n: int):
        self.up = list(range(n))
        self.low, self.high = list(range(n)), list(range(n))
        self.tops: list[list[int]] = [[] for _ in range(n)]
        self.depth: list[int] = []
        self.words: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.touched: list[list[int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def run(self, edges: np.ndarray, edge_words: np.ndarray, touches: np.ndarray, items: np.ndarray, touch_words: np.ndarray) -> None:
        """edges[i] is the depth where i and i + 1 meet; touches[k] the depth of a node on sequence items[k]; words: tokens down to there."""
        depths = np.concatenate((edges, touches))
        order = np.argsort(-depths, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(depths[order]) != 0, [True]))) if len(order) else [0]
        m = len(edges)
        for a, b in zip(bounds[:-1], bounds[1:]):
            concerned: dict[int, int] = {}
            for e in order[a:b].tolist():
                if e < m:
                    x, y = self.find(e), self.find(e + 1)
                    if len(self.tops[x]) < len(self.tops[y]):
                        x, y = y, x
                    self.up[y] = x
                    self.tops[x] += self.tops[y]
                    self.tops[y] = []
                    self.low[x], self.high[x] = min(self.low[x], self.low[y]), max(self.high[x], self.high[y])
            at = int(depths[order[a]])
            for e in order[a:b].tolist():
                root = self.find(e if e < m else int(items[e - m]))
                node = concerned.get(root)
                if node is None:
                    node = concerned[root] = len(self.depth)
                    self.depth.append(at)
                    self.words.append(int(edge_words[e] if e < m else touch_words[e - m]))
                    self.span.append((self.low[root], self.high[root]))
                    self.children.append(self.tops[root])
                    self.touched.append([])
                    self.tops[root] = [node]
                if e >= m:
                    self.touched[node].append(e - m)


_SUMS = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")


class _Nodes:
    """Rows of nodes, with the chains of single-child nodes above them, as batches."""

    def __init__(self):
        self.columns: dict[str, list] = {c: [] for c in (*_SUMS, "parent_conv_id", "parent_ref", "ends_sha256", "item")}

    def add(self, depth: int, above: int, n: int, least: int, parent: int | None, ref: int | None, children: int, leaves: int, saved: int, words: np.ndarray, sha: str | None, item: int | None = None) -> None:
        """A node at `depth` and those above it down from above + 1, whose last turns have so many words; saved is that of its subtree without itself."""
        k, to = depth - above, self.columns
        own = (n - 1) * words.astype(np.int64)
        values = (np.full(k, least), np.arange(above + 1, depth + 1), np.full(k, n), np.concatenate((np.ones(k - 1, np.int64), [children])), np.full(k, leaves), saved + np.cumsum(own[::-1])[::-1])
        for c, v in zip(_SUMS, values):
            to[c].append(v)
        to["parent_conv_id"] += [parent, *[least] * (k - 1)]
        to["parent_ref"] += [ref, *[None] * (k - 1)]
        to["ends_sha256"] += [*[NO_ENDS] * (k - 1), sha]
        to["item"] += [*[None] * (k - 1), item]

    def __len__(self) -> int:
        return len(self.columns["item"])

    def batch(self) -> pa.RecordBatch:
        n, to = len(self), self.columns
        own = {c: pa.array(np.concatenate(to[c]) if c in _SUMS and to[c] else to[c], _OUT.field(c).type) for c in to}
        own["kind"] = pa.array(["node"] * n, pa.string())
        self.__init__()
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(n, f.type)) for f in _OUT], schema=_OUT)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WIDTH


def _sums(counts: np.ndarray) -> np.ndarray:
    """Words down to each depth, from depth 0."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition of (seq, conv_id, counts): complete nodes, the contracted forest, and the members that end on open nodes.

    Kinds of rows: node, a complete one; item, the first (0) or last (1) sequence and, of the last, the edge to the first;
    piece, an open node: on which item it stands, and its sums; end, ids as text of members of the sequence of an item.
    """
    part = TaskContext.get().partitionId() << 32
    n_ends, least, edges, edge_words, lengths, total_words, fresh, shas = [], [], [], [], [], [], [], []
    bounds: list[tuple[bytes, np.ndarray, list[str]]] = []  # of the first run of equal sequences and of the one at hand

    for batch in batches:
        for seq, conv, own in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
            seq = seq.as_py()
            if not bounds or seq != bounds[-1][0]:
                counts = own.values.to_numpy(zero_copy_only=False)
                sums, lcp = _sums(counts), 0
                if bounds:
                    shas.append(hashlib.sha256(",".join(bounds[-1][2]).encode()).hexdigest())
                    lcp = _common(bounds[-1][0], seq)
                    edges.append(lcp)
                    edge_words.append(sums[lcp])
                    del bounds[1:]
                bounds.append((seq, counts.copy(), []))
                lengths.append(len(counts))
                total_words.append(sums[-1])
                fresh.append(counts[lcp:].copy())
                n_ends.append(0)
                least.append(conv)
            bounds[-1][2].append(str(conv))
            n_ends[-1] += 1
    if not bounds:
        return
    shas.append(None)

    m = len(lengths)
    lcps, rows = np.array(edges, np.int64), []
    for item, (seq, counts, ids) in enumerate(bounds):
        rows.append({"kind": "item", "ref": part, "item": item, "seq": seq, "counts": counts.tolist(), "edge": int(lcps.min()) if item else None})
        rows += [{"kind": "end", "ref": part, "item": item, "edge": k // CHUNK_IDS, "ids": ",".join(ids[k : k + CHUNK_IDS])} for k in range(0, len(ids), CHUNK_IDS)]
    forest = Forest(m)
    forest.run(lcps, np.array(edge_words, np.int64), np.array(lengths, np.int64), np.arange(m), np.array(total_words, np.int64))
    # Per node: members, least member, leaves, and tokens saved below.
    sums: list[tuple[int, int | None, int, int]] = []
    out = _Nodes()
    for node, (depth, words, (low, high), children, touched) in enumerate(zip(forest.depth, forest.words, forest.span, forest.children, forest.touched)):
        is_open = low == 0 or high == m - 1
        n, first, leaves, saved, complete = sum(n_ends[i] for i in touched), None, 0, 0, 0
        for i in touched:
            first = _least(first, least[i])
        below = [c for c in children if forest.span[c][0] > 0 and forest.span[c][1] < m - 1]
        for c in below:
            n_c, first_c, leaves_c, saved_c = sums[c]
            n, first, leaves, saved, complete = n + n_c, _least(first, first_c), leaves + leaves_c, saved + saved_c + (n_c - 1) * (forest.words[c] - words), complete + 1
        if not is_open and not children:
            leaves = 1
        sums.append((n, first, leaves, saved))
        for c in below:
            n_c, first_c, leaves_c, saved_c = sums[c]
            start = forest.span[c][0]
            skip = depth - edges[start - 1]
            below_c, sha = len(forest.children[c]), shas[forest.touched[c][0]] if forest.touched[c] else NO_ENDS
            out.add(forest.depth[c], depth, n_c, first_c, None if is_open else first, part | node if is_open else None, below_c, leaves_c, saved_c, fresh[start][skip : skip + forest.depth[c] - depth], sha)
        if is_open:
            rows.append({"kind": "piece", "ref": part | node, "item": int(low > 0), "depth": depth, "words": words, "n_convs": n, "conv_id": first, "n_children": complete, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": shas[touched[0]] if touched and 0 < touched[0] < m - 1 else None})
        if len(out) > 100_000:
            yield out.batch()
    yield out.batch()
    yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes that were open, from the items and pieces of all partitions in order; one task sees a few rows of each partition.

    Kinds of rows: node, with a number of its own as item where members end on it; ref, the least member of the node that
    a piece became; owner, the number of the node on which the members of an item end.
    """
    rows = [r for batch in batches for r in batch.to_pylist()]
    items = sorted((r for r in rows if r["kind"] == "item"), key=lambda r: (r["ref"], r["item"]))
    pieces = [r for r in rows if r["kind"] == "piece"]
    if not items:
        return
    number = {(r["ref"], r["item"]): k for k, r in enumerate(items)}
    counts = [np.array(r["counts"], np.int64) for r in items]
    sums_of = [_sums(c) for c in counts]
    edges = [b["edge"] if b["item"] else _common(a["seq"], b["seq"]) for a, b in zip(items[:-1], items[1:])]
    place = [number[(r["ref"] >> 32 << 32, r["item"])] for r in pieces]
    forest = Forest(len(items))
    forest.run(
        np.array(edges, np.int64), np.array([sums_of[k + 1][e] for k, e in enumerate(edges)], np.int64), np.array([*(r["depth"] for r in pieces), 0], np.int64),
        np.array([*place, 0], np.int64), np.array([*(r["words"] for r in pieces), 0], np.int64),
    )
    sums: list[tuple[int, int | None, int, int]] = []
    n_children, ends, shas, out, more = [], [], [], _Nodes(), []
    for node, (depth, words, children, touched) in enumerate(zip(forest.depth, forest.words, forest.children, forest.touched)):
        own = [pieces[k] for k in touched if k < len(pieces)]
        n, leaves, saved, k = (sum(r[c] for r in own) for c in ("n_convs", "n_leaves", "saved_tokens", "n_children"))
        first = None
        for r in own:
            first = _least(first, r["conv_id"])
        for c in children:
            n_c, first_c, leaves_c, saved_c = sums[c]
            n, first, leaves, saved, k = n + n_c, _least(first, first_c), leaves + leaves_c, saved + saved_c + (n_c - 1) * (forest.words[c] - words), k + 1
        sums.append((n, first, leaves if k else 1, saved))
        n_children.append(k)
        more += [{"kind": "ref", "ref": r["ref"], "conv_id": first} for r in own]
        ending = [r for r in own if len(counts[number[(r["ref"] >> 32 << 32, r["item"])]]) == depth]
        more += [{"kind": "owner", "ref": r["ref"] >> 32 << 32, "item": r["item"], "edge": node} for r in ending]
        ends.append(node if ending else None)
        # Members whose sequence stands within a partition have their hash from there.
        shas.append(None if ending else next((r["ends_sha256"] for r in own if r["ends_sha256"]), NO_ENDS))
        for c in children:
            n_c, first_c, leaves_c, saved_c = sums[c]
            out.add(forest.depth[c], depth, n_c, first_c, first, None, n_children[c], leaves_c, saved_c, counts[forest.span[c][0]][depth : forest.depth[c]], shas[c], ends[c])
        if len(out) > 100_000:
            yield out.batch()
    n, first, leaves, saved = sums[-1]
    out.add(0, -1, n, first, None, None, n_children[-1], leaves, saved, np.zeros(1, np.int64), shas[-1], ends[-1])
    yield out.batch()
    yield pa.RecordBatch.from_pylist(more, schema=_OUT)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, ends_sha256) from rows (item, ids) that are sorted by item and, within it, in the members' order."""
    at, hasher = None, None
    for batch in batches:
        for item, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if item != at:
                if at is not None:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([at], pa.int64()), "ends_sha256": [hasher.hexdigest()]})
                at, hasher = item, hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(ids.as_py().encode())
    if at is not None:
        yield pa.RecordBatch.from_pydict({"item": pa.array([at], pa.int64()), "ends_sha256": [hasher.hexdigest()]})


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of convs (conv_id, turns: array of (digest, words)), which has each conv_id once.

    A row for each distinct sequence of first turns, from the root of depth 0: conv_id, the smallest member (conversations that
    begin so); depth; parent_conv_id, the parent's (null for the root); n_convs, members; n_children; n_leaves, childless nodes
    in its subtree; saved_tokens, summed over its subtree, each node's (n_convs - 1) times the words of its last turn;
    ends_sha256, SHA-256 of the ids of the members that end here, ascending and comma-joined. Subtrees include their top.
    Null or empty turns are a conversation that ends on the root. Rows with a null conv_id are left out; an empty table has no
    node; other columns are not read. A conversation is one value of 16 bytes a turn, up to 2 GB.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<digest:string,words:int>>"))
    packed = convs.where("conv_id IS NOT NULL").select(
        F.unhex(F.array_join(F.transform(turns, lambda x: x.digest), "")).alias("seq"), F.col("conv_id").cast("long").alias("conv_id"), F.transform(turns, lambda x: x.words.cast("int")).alias("counts")
    )
    ordered = packed.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    local = write_shared(arrow(ordered, _local, _DDL), "forests")
    skeleton = local.where("kind IN ('item', 'piece')").repartition(1)
    merged = write_shared(arrow(skeleton, _merge, _DDL), "merged")
    owners = merged.where("kind = 'owner'").select("ref", "item", F.col("edge").alias("node"))
    chunks = local.where("kind = 'end'").select("ref", "item", "edge", "ids").join(owners, ["ref", "item"])
    chunks = chunks.repartition("node").sortWithinPartitions("node", "ref", "item", "edge").select(F.col("node").alias("item"), "ids")
    ends = write_shared(arrow(chunks, _hashed, "item long, ends_sha256 string"), "ends")
    refs = merged.where("kind = 'ref'").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("up"))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_ROWS else refs
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    complete = local.where("kind = 'node'").join(refs, "parent_ref", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    late = merged.where("kind = 'node'").join(ends.withColumnRenamed("ends_sha256", "late"), "item", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "late"))
    return complete.select(columns).unionByName(late.select(columns))
