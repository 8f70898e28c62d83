"""Spelling variants: words of a corpus that differ by one letter, found by PartEnum signatures of their letter multisets.

A word's letters are a binary vector with a dimension for each letter and occurrence ("the second e"). One replaced letter
changes two dimensions, one inserted or deleted letter one. The alphabet is partitioned into PARTS parts of about equal use.
Two vectors of equal length at Hamming distance two agree outside some two parts, so the enumerated signatures are the
vector less each pair of parts; vectors at distance one agree outside one part, and their signatures are those of the vector
less each part. Equal signatures are an exact equi-join. Words with equal letters (anagrams, never one letter apart) are one
vector, so signatures are joined for distinct vectors; the join's pairs are verified as vectors first, by word last.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop_shared, write_shared

PARTS = 8
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: Distinct words that a task counts before it hands them on.
FLUSH = 500_000
#: Code points of a text that are searched for words at once.
PIECE = 1_000_000
#: Words of one multiset that are verified together; larger ones are dealt over blocks, and all blocks meet.
BLOCK = 1_024
RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _lower(text: str) -> str:
    return text.encode().translate(_LOWER).decode()


def runs(text: str | None) -> Iterator[str]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased. A long text is searched in pieces."""
    text = text or ""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        piece = _lower(text[at:end])
        found = RUN.findall(piece)
        if end < len(text) and found and RUN.fullmatch(piece[-1]):
            # The last run may go on: it is taken together with the next piece, or grown to its end if it fills this one.
            last = found.pop()
            if len(last) < len(piece):
                end -= len(last)
            else:
                grown = [last]
                while end < len(text):
                    more = _lower(text[end : end + PIECE])
                    head = RUN.match(more)
                    grown.append(head[0] if head else "")
                    end += len(grown[-1])
                    if not head or len(head[0]) < len(more):
                        break
                found.append("".join(grown))
        yield from found
        at = end


def slip(word: str, prefix: int, every: int) -> str:
    """word less one code point if `every` divides the crc32 of the prefix and the word; prefix is a running crc32."""
    h = zlib.crc32(word.encode(), prefix)
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, slips: int | None = None, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least `letters` code points that occur at least `count` times in docs (doc_id, text).

    With slips, each occurrence whose crc32 of "<doc_id>:<word>" (a null id is empty) it divides loses a code point first.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                own = Counter(w for w in runs(text.as_py()) if len(w) >= letters)
                if slips:
                    prefix = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                    for word, n in own.items():
                        word = slip(word, prefix, slips)
                        if len(word) >= letters:
                            total[word] += n
                else:
                    total.update(own)
                if len(total) > FLUSH:
                    yield flush()
        yield flush()

    counted = arrow(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def letters_of(word: Column) -> Column:
    """The word's letters in code-point order, as a string: its multiset."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def alphabet_parts(vectors: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of vectors (letters) in `parts` strings that occur about equally often. One row for each letter reaches the driver."""
    uses = vectors.select(F.explode(F.array_distinct(F.split("letters", ""))).alias("letter")).groupBy("letter").count().collect()
    out, load = [""] * parts, [0] * parts
    for letter, n in sorted(uses, key=lambda r: (-r[1], r[0])):
        k = load.index(min(load))
        out[k] += letter
        load[k] += n
    return out


def signatures(vectors: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures (key, letters) of vectors: those less two parts, and as the shorter and the longer vector less one part."""

    def less(*dropped: int) -> Column:
        return F.translate("letters", "".join(parts[i] for i in dropped), "")

    n = len(parts)
    size = F.length("letters")
    two = F.array(*[F.xxhash64(size, F.lit(i), F.lit(j), less(i, j)) for i in range(n) for j in range(i + 1, n)])
    one = lambda shorter: F.array(*[F.xxhash64(shorter, F.lit(i), less(i)) for i in range(n)])
    rows = lambda keys: vectors.select("letters", F.explode(keys).alias("key"))
    return rows(two), rows(one(size)), rows(one(size - 1))


def _apart(a: str, b: str) -> tuple[str, str] | None:
    """What a has and b has not, and the other way round, if that is one letter (or none of a) and one of b; else None."""
    i, j, x, y = 0, 0, "", ""
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and a[i] < b[j]):
            x, i = x + a[i], i + 1
        else:
            y, j = y + b[j], j + 1
        if len(x) > 1 or len(y) > 1:
            return None
    return (x, y) if len(y) == 1 else None


def neighbours(vectors: DataFrame, parts: list[str]) -> DataFrame:
    """(a, b, x, y) of distinct multisets a, b of vectors (letters): b is a with a letter x replaced by y, a < b; or with y added, x ''.

    Spark takes signatures for as small as the vectors that they are exploded from and would broadcast them through the driver: joins are asked to sort both sides.
    """
    two, short, long = signatures(vectors, parts)
    pairs = two.withColumnRenamed("letters", "a").hint("merge").join(two.withColumnRenamed("letters", "b"), "key").where("a < b").select("a", "b")
    pairs = pairs.unionByName(short.withColumnRenamed("letters", "a").hint("merge").join(long.withColumnRenamed("letters", "b"), "key").select("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (found := _apart(a, b)) is not None:
                    rows.append((a, b, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["a", "b", "x", "y"])

    return arrow(pairs, run, "a string, b string, x string, y string").distinct()


def _less_one(word: str, letter: str, mark: str) -> set[str]:
    """word with one occurrence of the letter replaced by the mark, for each occurrence."""
    return {word[:k] + mark + word[k + 1 :] for k, c in enumerate(word) if c == letter}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): ordered pairs of words (word, n) that differ by one inserted, deleted or replaced code point.

    Multisets that are neighbours meet with their words in blocks of about BLOCK; within two blocks, words of one are looked
    up among words of the other with the letter in question taken out, so the work is linear in the blocks' words. Tables that
    grow with the vocabulary are joined by sorting, here and in variants(): broadcast, they would fill the driver.
    """
    vectors = words.select("word", "n", letters_of(F.col("word")).alias("letters"))
    sizes = vectors.groupBy("letters").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = write_shared(sizes, "vectors")
    found = neighbours(sizes.select("letters"), alphabet_parts(sizes))
    of = vectors.hint("merge").join(sizes, "letters").groupBy("letters", F.pmod(F.xxhash64("word"), "blocks").alias("block"))
    of = write_shared(of.agg(F.collect_list(F.struct("word", "n")).alias("words")).select("letters", "words"), "anagrams")
    of_a, of_b = (of.select(F.col("letters").alias(c), F.col("words").alias(f"of_{c}")) for c in "ab")
    met = found.hint("merge").join(of_a, "a").hint("merge").join(of_b, "b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            for x, y, of_a, of_b in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "of_a", "of_b"))):
                mark = "\0" if x else ""
                known = defaultdict(list)
                for w in of_a:
                    for p in _less_one(w["word"], x, mark) if x else (w["word"],):
                        known[p].append((w["word"], w["n"]))
                for w in of_b:
                    for p in _less_one(w["word"], y, mark):
                        out += [(*mine, w["word"], w["n"]) for mine in known.get(p, ())]
            both = out + [(c, d, a, b) for a, b, c, d in out]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in both], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "other", "other_n"])

    return arrow(met.select("x", "y", "of_a", "of_b"), run, "word string, n long, other string, other_n long")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per row of words (word, n), which has each word once.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of the largest
    n (of equal ones the smallest in code-point order) if that is at least `factor` times the word's own n, else null, and so
    is form_n; n_near counts all near words. root is reached by following forms to the last, the word itself where it has none.
    Forms grow in n, so they have no cycle, and chains are no longer than the logarithm of the largest n. Null words are left
    out. An empty table gives an empty one; other columns are not read.
    """
    words = write_shared(words.select("word", "n").where("word IS NOT NULL"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = write_shared(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    named = F.col("form_n") >= factor * F.col("n")
    rows = words.hint("merge").join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, F.col("form")).alias("form"), F.when(named, F.col("form_n")).alias("form_n"))
    rows = write_shared(rows, "forms")
    drop_shared(near, words)
    roots = write_shared(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = write_shared(roots.hint("merge").join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        drop_shared(roots)
        roots = moved.select("word", "root")
        roots._shared_path = moved._shared_path
        if moved.where("moved").isEmpty():
            break
    return rows.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, slips: int | None = None, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """variants() of the words of docs (doc_id, text) that have `letters` code points and `count` occurrences.

    Null and empty texts have no word; rows that repeat count each; texts are read whole, in pieces that end between words.
    """
    return variants(word_counts(docs, slips, letters, count), factor)
