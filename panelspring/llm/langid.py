"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, n-gram bucket) come from a Spark aggregation over the training rows, the matrix of log
probabilities (buckets x languages, a fixed size) is broadcast, and documents are scored in batches: one gather of
matrix rows by bucket and one segmented sum a batch, which is the sparse product of counts and log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch_of, mix, powers

UNKNOWN = "und"
CHUNK_CHARS = 200_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its document's number, whether each document has a letter).

    Texts are lower-cased; runs of other characters than letters count as one boundary mark, also at both ends, so that
    n-grams see where words begin and end.
    """
    codes = np.frombuffer(("\0" + "\0".join(t.lower() for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    doc = np.cumsum(codes == 0)
    # A text may hold NUL itself; lengths then decide.
    if doc[-1] != len(texts) + 1:
        lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
        doc = np.concatenate((np.repeat(np.arange(1, len(texts) + 1), lengths), [len(texts) + 1]))
    doc = doc - 1
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    keep = letter | new | np.concatenate(([True], letter[:-1]))
    codes, doc, letter = np.where(letter, codes, 1)[keep].astype(np.uint64), doc[keep], letter[keep]
    has = np.bincount(doc[letter], minlength=len(texts) + 1)[: len(texts)] > 0
    p, out_h, out_d = powers(8)[0], [], []
    for n in orders:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        solid = np.zeros(len(h), bool)
        for j in range(n):
            h += codes[j : len(codes) - n + 1 + j] * p[j + 1]
            solid |= letter[j : len(codes) - n + 1 + j]
        # The mark that begins the next document also ends this one.
        inside = solid & ((doc[: len(h)] == doc[n - 1 :]) | ((doc[n - 1 :] == doc[: len(h)] + 1) & ~letter[n - 1 :]))
        out_h.append((mix(h[inside] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
        out_d.append(doc[: len(h)][inside])
    return np.concatenate(out_h or [np.zeros(0, np.int32)]), np.concatenate(out_d or [np.zeros(0, np.int64)]), has


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_CHARS):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


class LanguageModel:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, orders: tuple[int, ...], bits: int):
        self.langs, self.logp, self.prior, self.orders, self.bits = langs, logp, prior, orders, bits

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b in _runs(texts):
            h, d, has = _grams(texts[a:b], self.orders, self.bits)
            total = np.tile(self.prior, (b - a, 1))
            if self.langs:
                for c in range(len(self.langs)):
                    total[:, c] += np.bincount(d, weights=self.logp[c][h], minlength=b - a)[: b - a]
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i in range(b - a):
                known = has[i] and self.langs
                names.append(self.langs[best[i]] if known else UNKNOWN)
                scores.append(float(score[i]) if known else 0.0)
        return names, scores


def fit_language_model(train: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, alpha: float = 0.5, max_rows_per_lang: int = 10_000) -> LanguageModel:
    """Fit on columns text and lang. Rows with a null in either are skipped.

    max_rows_per_lang bounds the training sample: each language gives about that many rows, chosen by a hash of the
    text, or all of its rows if it has fewer. The class prior is the share over all training rows.
    """
    train = train.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << bits)), np.zeros(0), orders, bits)
    share = F.lit(1.0)
    for lang in langs:
        if sizes[lang] > max_rows_per_lang:
            share = F.when(F.col("lang") == lang, F.lit(max_rows_per_lang / sizes[lang])).otherwise(share)
    picked = train.where((F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)) < share)
    index = {lang: i for i, lang in enumerate(langs)}
    schema = pa.schema([("class", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros((len(index), 1 << bits), np.int64)
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), [index[x] for x in batch.column("lang").to_pylist()]
            for a, b in _runs(texts):
                h, d, _ = _grams(texts[a:b], orders, bits)
                total += np.bincount(np.asarray(labels[a:b], np.int64)[d] * (1 << bits) + h, minlength=total.size).reshape(total.shape)
        c, h = np.nonzero(total)
        yield batch_of(schema, **{"class": c.astype(np.int32), "bucket": h.astype(np.int32), "n": total[c, h]})

    rows = arrow(picked, count, "class int, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(langs), 1 << bits), alpha)
    counts[rows["class"], rows["bucket"]] += rows["n"]
    logp = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
    return LanguageModel(langs, logp, prior, orders, bits)


def predict_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score, one row per row of docs.

    A null text or one without a letter gets `und` and 0.0, as does every text if the model saw no row. Among equal
    scores the first language by code point wins. score is the posterior probability of lang_pred. A kept column named
    lang_pred or score gives way to these.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in keep if c not in ("lang_pred", "score")], F.col("text").alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])

    def score(batches):
        for batch in batches:
            col = pc.fill_null(batch.column("__text"), "")
            names, scores = shared.value.predict(col.to_pylist())
            rest = [i for i, name in enumerate(batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [batch.schema.names[i] for i in rest] + ["lang_pred", "score"])

    return arrow(kept, score, out)
