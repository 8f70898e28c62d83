"""Quality classifier: naive Bayes support vectors.

Word and character n-gram indicators are hashed into a fixed number of buckets, scaled by the log-count ratio of the
two classes, and a linear hinge-loss model is fitted by dual coordinate descent. The indicators of the bounded training
sample are built where its texts are, class counts for the ratios are one aggregation over that whole sample, and one
task fits the model on its rows, of which the weight vector (one number a bucket) reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow, drop_shared, mix, powers, prefix_hash, slices, span_hash, word_pieces, words, write_shared

BITS = 17
_CHAR_ORDERS = (1, 2, 3, 4)
#: Word n-grams of one word repeated: indicators of at least so many in a row, whatever the word.
_REPEATS = np.array([2, 3, 4, 6, 8, 12, 16, 24])


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, cut: bool = True) -> list[np.ndarray]:
    """Distinct buckets of each text: words, word pairs, repeats of a word and byte n-grams, none across documents.

    A very long text that stands alone is read in pieces.
    """
    size = 1 << bits
    if cut and len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
        seen = np.zeros(size, bool)
        for part in word_pieces(data):
            seen[features(part, np.array([0, len(part)]), bits, False)[0]] = True
        return [np.flatnonzero(seen).astype(np.int32)]
    shift = np.uint64(64 - bits)
    start, end, first = words(data, offsets)
    prefix = prefix_hash(data)
    wh = span_hash(prefix, start, end)
    wb = (mix(wh + np.uint64(11)) >> shift).astype(np.int32)
    pair = (mix(wh[:-1] * powers(3)[0][1] + wh[1:] + np.uint64(13)) >> shift).astype(np.int32) if len(wh) > 1 else wb[:0]
    index = np.arange(len(wh))
    fresh = np.ones(len(wh), bool)
    fresh[1:] = wh[1:] != wh[:-1]
    fresh[first[:-1][first[:-1] < len(wh)]] = True
    run = index - np.maximum.accumulate(np.where(fresh, index, 0)) + 1 if len(wh) else index
    repeat = (mix(_REPEATS.astype(np.uint64) + np.uint64(17)) >> shift).astype(np.int32)
    chars = []
    p = powers(8)[0]
    wide = data.astype(np.uint64) + np.uint64(1)
    for n in _CHAR_ORDERS:
        m = max(0, len(data) - n + 1)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += wide[j : j + m] * p[j + 1]
        chars.append((mix(h + np.uint64(n)) >> shift).astype(np.int32))
    seen, out = np.zeros(size, bool), []
    for i in range(len(offsets) - 1):
        a, b, w0, w1 = int(offsets[i]), int(offsets[i + 1]), int(first[i]), int(first[i + 1])
        parts = [wb[w0:w1], pair[w0 : max(w0, w1 - 1)], *(c[a : max(a, b - n + 1)] for n, c in zip(_CHAR_ORDERS, chars))]
        for x in parts:
            seen[x] = True
        if w1 > w0:
            seen[repeat[_REPEATS <= run[w0:w1].max()]] = True
        got = np.flatnonzero(seen)
        seen[got] = False
        out.append(got.astype(np.int32))
    return out


class QualityModel:
    """weight: one number a bucket; a text's margin is the sum over its buckets / sqrt(their number), plus bias."""

    def __init__(self, weight: np.ndarray, bias: float, bits: int = BITS):
        self.weight, self.bias, self.bits = weight, bias, bits

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.fromiter((self.weight[f].sum() / np.sqrt(max(1, len(f))) for f in features(data, offsets, self.bits)), float, len(offsets) - 1) + self.bias


def hinge_dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: np.ndarray, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2/2 + sum c_i max(0, 1 - y_i w.x_i), by dual coordinate descent.

    x: (buckets, values) of each row. Rows are visited in an order fixed by a seed.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(x))
    norm = np.array([float(v @ v) + 1.0 for _, v in x])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(x)):
            f, v = x[i]
            g = y[i] * (float(w[f] @ v) + w[-1]) - 1
            step = min(max(alpha[i] - g / norm[i], 0.0), c[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[f] += step * y[i] * v
                w[-1] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3 * float(c.max()):
            break
    return w


def fit_quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 12_000, bits: int = BITS, alpha: float = 1.0, cost: float = 10.0) -> QualityModel:
    """Fit on docs (doc_id, text) with labels (doc_id and `label`, 0 or 1). Null ids and labels are skipped; a null text is empty.

    max_rows bounds the sample: about that many labels, split evenly between the classes and chosen by a hash of the id; a
    class with fewer gives all. The bounded sample of labels is broadcast to the texts, which are not shuffled. A row has
    at most 2^bits buckets, however long its text, so the one task that fits has a bounded input. Each row counts by its
    class's share, so that both classes weigh alike; rows that repeat count as often as they stand there. With one class
    only, or none, the model answers with that class, or 1. Columns other than these are not read.
    """
    labels = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    size = 1 << bits
    constant = QualityModel(np.zeros(size, np.float32), -1.0 if set(sizes) == {0} else 1.0, bits)
    if len(sizes) < 2:
        return constant
    share = F.when(F.col("label") == 1, min(1.0, max_rows / 2 / sizes[1])).otherwise(min(1.0, max_rows / 2 / sizes[0]))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = F.broadcast(labels.where(u / float(1 << 30) < share))
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").select(F.xxhash64("doc_id", "text").alias("row"), "label", "text")

    def indicators(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                packed = [f.tobytes() for f in features(data, offsets, bits)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(packed, pa.binary())], ["row", "label", "buckets"])

    rows = write_shared(arrow(picked, indicators, "row long, label int, buckets binary"), "indicators")

    def counts(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for k, f in zip(batch.column("label").to_pylist(), batch.column("buckets")):
                total[k, np.frombuffer(f.as_buffer(), np.int32)] += 1
        c, h = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(h, pa.int32()), pa.array(total[c, h])], ["label", "bucket", "n"])

    got = arrow(rows, counts, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    of = np.full((2, size), alpha)
    of[got["label"], got["bucket"]] += got["n"]
    ratio = np.log(of[1] / of[1].sum()) - np.log(of[0] / of[0].sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fit(batches):
        ratio, key, y, x = shared.value, [], [], []
        for batch in batches:
            key += batch.column("row").to_pylist()
            y += batch.column("label").to_pylist()
            x += [np.frombuffer(f.as_py(), np.int32) for f in batch.column("buckets")]
        order = sorted(range(len(x)), key=lambda i: (key[i], y[i]))
        if order:
            x, y = [x[i] for i in order], np.array([y[i] for i in order])
            n1 = max(1, int((y == 1).sum()))
            n0 = max(1, len(y) - n1)
            c = cost * np.where(y == 1, len(y) / 2 / n1, len(y) / 2 / n0)
            weight = hinge_dual_descent([(f, ratio[f] / np.sqrt(max(1, len(f)))) for f in x], np.where(y == 1, 1.0, -1.0), size, c)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(weight[:-1] * ratio, weight[-1]).tobytes()], pa.binary())], ["w"])

    fitted = arrow(rows.repartition(1), fit, "w binary").collect()
    drop_shared(rows)
    if not fitted:  # no label has a document
        return constant
    weight = np.frombuffer(fitted[0]["w"], np.float64)
    return QualityModel(weight[:-1].astype(np.float32), float(weight[-1]), bits)


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), sharpness: float = 2.0, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns `keep` of docs with score (0 to 1, the logistic function of the margin) and predicted (1 if score >= 0.5).

    Every row of docs gives one row; null and empty texts have no n-gram and get the bias. names are those of the two new
    columns; a kept column of the same name gives way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in keep if c not in names], F.col("text").alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"`{names[0]}` double, `{names[1]}` int"])

    def score(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "__text"):
                s = 1 / (1 + np.exp(-np.clip(sharpness * shared.value.margins(data, offsets), -30, 30)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rows.schema.names[:-1], *names])

    return arrow(kept, score, out)
