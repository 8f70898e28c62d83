"""Benchmark decontamination: spaced-seed hashing with fixed masks.

A mask says which token positions of a span count; the others may hold any token. Masked hashes of the test items are
joined with those of every position of every document. Hits are summed up as diagonals (offsets between both) for each
document and item, and along each diagonal aligned windows are compared token by token, which tolerates substitutions.
All of it is built-in expressions. Only ids, positions and hashes are exploded, from pieces of bounded size; token lists
are read again for hits alone, once for each document and item, and cut to the item's length for each diagonal.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, with_key, write_shared

#: Fixed masks: 1 counts, 0 is ignored. Chosen so that every stretch of 16 tokens with up to 4 substitutions has a hit.
MASKS = ("101111", "1110011", "110010101", "11001001001")
WINDOW = 16
SHARE = 0.75
#: Test hashes, and documents' diagonals, up to this number are broadcast (about 100 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000
#: Positions of a document whose hashes are made at once.
PIECE = 2_000


@lru_cache(maxsize=None)
def masks_of(length: int, share: float = SHARE, most: int = 6) -> tuple[str, ...]:
    """Masks for items of `length` tokens, fewer than WINDOW: some mask hits wherever the allowed substitutions stand.

    The heaviest masks of which `most` are enough, chosen greedily by the patterns of substitutions that they add.
    """
    bad = length - math.ceil(length * share)
    patterns = list(combinations(range(length), bad))
    touched = [sum(1 << k for k, p in enumerate(patterns) if j in p) for j in range(length)]
    everything = (1 << len(patterns)) - 1
    for weight in range(min(5, length - bad), 0, -1):
        hits = {}
        for rest in combinations(range(1, length), weight - 1):
            at, got = (0, *rest), 0
            for shift in range(length - at[-1]):
                miss = 0
                for j in at:
                    miss |= touched[j + shift]
                got |= everything & ~miss
            hits["".join("1" if j in at else "0" for j in range(at[-1] + 1))] = got
        chosen, left = [], everything
        while left and len(chosen) < most:
            mask = max(hits, key=lambda m: ((hits[m] & left).bit_count(), -len(m), m))
            if not hits[mask] & left:
                break
            chosen.append(mask)
            left &= ~hits[mask]
        if not left:
            return tuple(chosen)
    raise ValueError(f"no masks for {length} tokens")


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased; empty for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, keep: tuple[str, ...], masks: tuple[str, ...], numbers: tuple[int, ...]) -> DataFrame:
    """keep, pos (0-based) and seed: the hash of each mask (known by its number) at each position of column toks.

    Lists shorter than the shortest mask give a row of nulls.
    """
    n, least, span = F.size("toks"), min(map(len, masks)), max(map(len, masks))
    piece = lambda i: F.struct(i.alias("base"), F.slice("toks", i + 1, F.lit(PIECE + span)).alias("toks"))
    # No filter and an outer generator: Catalyst would copy the token expression into a filter's lambdas otherwise.
    df = df.select(*keep, F.explode_outer(F.when(n >= least, F.transform(F.sequence(F.lit(0), n - least, F.lit(PIECE)), piece))).alias("__piece")).select(*keep, "__piece.base", "__piece.toks")
    last = F.least(F.lit(PIECE - 1), F.size("toks") - least)

    def at(k: int, mask: str):
        return lambda i: F.xxhash64(F.lit(k), *[F.get("toks", i + j) for j, c in enumerate(mask) if c == "1"])

    every = F.concat(*[F.transform(F.sequence(F.lit(0), last), at(k, m)) for k, m in zip(numbers, masks)])
    rows = df.select(*keep, "base", (last + 1).alias("__m"), F.when(last >= 0, every).alias("__s"))
    rows = rows.select(*keep, "base", "__m", F.posexplode_outer("__s").alias("__p", "seed"))
    return rows.select(*keep, (F.col("base") + F.when(F.col("__p").isNotNull(), F.pmod("__p", F.greatest(F.col("__m"), F.lit(1))))).alias("pos"), "seed")


def matches(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Pairs of a document and a test item that overlap: (doc_id, item_id, matched, compared, doc_pos, item_pos).

    docs has doc_id and text, items item_id and text; other columns are not read. A pair counts if some stretch of
    `window` tokens of the item (all of it, if it is shorter) agrees with the document at one offset in at least `share`
    of its tokens, and a mask hits at that offset. The masks hit all such stretches at the default window and share:
    `masks` those of whole windows, masks_of() those of shorter items, down to one token. matched is the largest number of
    equal tokens in such a stretch, compared its length, doc_pos and item_pos the least positions where it begins (doc_pos
    is negative if the document begins within the stretch). Texts without a token match nothing, nor do null texts. A null
    id is an id of its own; rows that share an id count as one. All hits are compared, whatever their number.
    """
    bench = write_shared(items.select("item_id", tokens(F.col("text")).alias("item_toks")).where(F.size("item_toks") > 0), "items")
    length = F.least(F.lit(window), F.size("item_toks"))
    lengths = sorted(r[0] for r in bench.select(length.alias("n")).distinct().collect())
    of = {n: masks if n == window else masks_of(n, share) for n in lengths}
    known = sorted({m for ms in of.values() for m in ms}, key=lambda m: (len(m), m))
    if not known:
        return docs.select("doc_id").limit(0).join(items.select("item_id").limit(0)).selectExpr("doc_id", "item_id", *[f"0 AS {c}" for c in ("matched", "compared", "doc_pos", "item_pos")])
    parts = [seeds(bench.where(length == n).withColumnRenamed("item_toks", "toks"), ("item_id",), ms, tuple(map(known.index, ms))) for n, ms in of.items()]
    hashes = parts[0]
    for part in parts[1:]:
        hashes = hashes.unionByName(part)
    hashes = write_shared(hashes.where("seed IS NOT NULL").select("item_id", "seed", F.col("pos").alias("item_at")).distinct(), "hashes")
    small = hashes.count() <= BROADCAST_ROWS
    # Rows that happen to share this hash share their hits, which are then compared with each row's own tokens.
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    found = seeds(keyed.select("row_key", tokens(F.col("text")).alias("toks")), ("row_key",), tuple(known), tuple(range(len(known))))
    hits = found.join(F.broadcast(hashes) if small else hashes, "seed").groupBy("row_key", "item_id", (F.col("pos") - F.col("item_at")).cast("int").alias("shift")).agg(F.count("*").alias("hits"))
    lines = hits.groupBy("row_key", "item_id").agg(F.collect_list("shift").alias("shifts"))
    # Documents with a hit are few; their texts meet the hits by key, without a shuffle of the texts while the hits are few.
    lines = write_shared(lines, "lines")
    drop_shared(hashes)
    few = lines.agg(F.coalesce(F.sum(F.size("shifts") + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS
    rows = keyed.join(F.broadcast(lines) if few else lines, "row_key").select("doc_id", "item_id", "shifts", tokens(F.col("text")).alias("toks"))
    bench = bench.withColumnRenamed("item_id", "__item")
    rows = rows.join(F.broadcast(bench) if small else bench, F.col("item_id").eqNullSafe(F.col("__item")))

    def beside(shift: Column) -> Column:
        """The tokens of the document from shift on, as many as the item has at most; `skip` of them lie before it."""
        skip = F.greatest(-shift, F.lit(0))
        return F.struct(shift.alias("shift"), skip.alias("skip"), F.slice("toks", F.greatest(shift, F.lit(0)) + 1, F.greatest(F.size("item_toks") - skip, F.lit(0))).alias("own"))

    rows = rows.select("doc_id", "item_id", "item_toks", F.explode_outer(F.transform("shifts", beside)).alias("x")).select("doc_id", "item_id", "item_toks", "x.*")

    def equal(i: Column) -> Column:
        return F.when(F.get("item_toks", i) == F.when(i >= F.col("skip"), F.get("own", i - F.col("skip"))), "1").otherwise("0")

    rows = rows.select("doc_id", "item_id", "shift", length.alias("compared"), F.array_join(F.transform(F.sequence(F.lit(0), F.size("item_toks") - 1), equal), "").alias("same"))
    starts = F.sequence(F.lit(0), F.length("same") - F.col("compared"))
    sums = F.transform(starts, lambda i: F.struct(F.length(F.translate(F.substr("same", i + 1, F.col("compared")), "0", "")).alias("matched"), (-(i + F.col("shift"))).alias("p"), (-i).alias("q")))
    rows = rows.select("doc_id", "item_id", "compared", F.array_max(sums).alias("best"))
    # Filtered after the sum, not before: see seeds(). All lines of an item have one `compared`.
    out = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("best", "compared")).alias("x")).where(F.col("x.best.matched") >= F.ceil(F.col("x.compared") * share))
    return out.select("doc_id", "item_id", F.col("x.best.matched").alias("matched"), F.col("x.compared").alias("compared"), (-F.col("x.best.p")).alias("doc_pos"), (-F.col("x.best.q")).alias("item_pos"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Rows of docs that match no test item, columns unchanged; each row is judged by its own text, whatever its id.

    Rows without a token stay, null texts too; rows that repeat stay or go together.
    """
    keyed = with_key(docs, "__key", "doc_id", "text")
    found = matches(keyed.select(F.col("__key").alias("doc_id"), "text"), items, **how).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(found, "__key", "left_anti").select(docs.columns)
