"""Token counts: greedy longest-match pieces by a trie automaton with failure links.

A word is matched against the vocabulary trie in one pass. Where the trie has no edge, the automaton follows a failure
link, which stands for pieces that are already certain; how many those are is stored with the link, so lengths come
out without building pieces. Distinct words of a batch run in lockstep, one byte position at a time.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prefix_hash, slices, span_hash, word_pieces, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are matched at once, at least one word.
PIECE = 2_000_000


def read_vocabulary(path: str = VOCABULARY) -> set[bytes]:
    """Pieces of a rank file (base64 bytes, a space, a number on each line): those without white space but a leading blank."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return {p for p in pieces if p and not set(p[1:]) & set(b" \t\n\x0b\x0c\r") and p[0] not in b"\t\n\x0b\x0c\r"}


class Automaton:
    """Trie with failure links; unknown bytes become single-byte pieces, so that every word has a length."""

    def __init__(self, pieces: set[bytes]):
        pieces = pieces | {bytes([b]) for b in range(256)}
        edges: list[dict[int, int]] = [{}]
        parent, char, final = [0], [0], [False]
        for piece in sorted(pieces):
            node = 0
            for b in piece:
                if b not in edges[node]:
                    edges[node][b] = len(edges)
                    edges.append({})
                    parent.append(node)
                    char.append(b)
                    final.append(False)
                node = edges[node][b]
            final[node] = True
        fail, popped = [-1] * len(edges), [0] * len(edges)
        level = list(edges[0].values())
        while level:
            below = []
            for v in level:
                below += edges[v].values()
                if final[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                u, c, n = parent[v], char[v], 0
                n, z = popped[u], fail[u]
                while z >= 0 and c not in edges[z]:
                    n, z = n + popped[z], fail[z]
                if z >= 0:
                    fail[v], popped[v] = edges[z][c], n
            level = below
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        keys = np.array([v * 256 + c for v in range(len(edges)) for c in edges[v]], np.int64)
        to = np.array([t for v in range(len(edges)) for t in edges[v].values()], np.int32)
        self.bits = max(4, int(np.ceil(np.log2(2.5 * len(keys)))))
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # open addressing, all keys at once
            free = self.key[slot[left]] == -1
            won = np.unique(slot[left][free], return_index=True)[1]
            won = left[free][won]
            self.key[slot[won]], self.to[slot[won]] = keys[won], to[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state along an edge, or -1."""
        keys = state.astype(np.int64) * 256 + byte
        slot, out, left = self._slot(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            at = self.key[slot[left]]
            hit = at == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (at != -1)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def lengths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: bytes = b" ") -> np.ndarray:
        """Pieces of each word lead + data[start:end]."""
        order = np.argsort(start - end, kind="stable")  # longest first: those still running are a prefix
        start, size = start[order], (end - start)[order]
        state, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        for t in range(-len(lead), int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left")) if t >= 0 else len(size)
            left, byte = np.arange(n), np.full(n, lead[t], np.int64) if t < 0 else data[start[:n] + t].astype(np.int64)
            while len(left):
                to = self.step(state[left], byte[left])
                ok = to >= 0
                state[left[ok]] = to[ok]
                left = left[~ok]
                count[left] += self.popped[state[left]]
                state[left] = self.fail[state[left]]
        left = np.flatnonzero(state > 0)
        while len(left):
            count[left] += self.popped[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]
        out = np.zeros(len(start), np.int64)
        out[order] = count
        return out


def totals(auto: Automaton, data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of each document. A very long one that stands alone is counted in pieces that end between words."""
    if len(offsets) == 2 and len(data) > 2 * most:
        parts = [totals(auto, part, np.array([0, len(part)]), len(part)) for part in word_pieces(data, most, 0)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)
    start, end, first = words(data, offsets)
    h = span_hash(prefix_hash(data), start, end)
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    n = auto.lengths(data, start[one], end[one])[back] if len(h) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(n)))
    return np.diff(first).astype(np.int64), np.diff(total[first]).astype(np.int64)


def count_tokens(docs: DataFrame, pieces: set[bytes], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs with n_words and n_tokens of the whole text; null and empty texts have 0 of both.

    A kept column named like a result gives way to it. Each row counts for itself, repeated rows alike; of equal texts the
    counts are equal. An empty table gives an empty one.

    A word is a run of other bytes than ASCII white space; it is matched with a blank before it, so that pieces with a
    leading blank begin words and the others continue them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    kept = docs.select(*[c for c in keep if c not in ("n_words", "n_tokens")], F.col("text").alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_words long", "n_tokens long"])

    def count(batches):
        auto = shared.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "__text", PIECE):
                n_words, n_tokens = totals(auto, data, offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(n_words), pa.array(n_tokens)], [*rows.schema.names[:-1], "n_words", "n_tokens"])

    return arrow(kept, count, out)
