"""Many logistic regressions at once: every (key, candidate) takes a Newton step from the same pass over the rows.

A key is what the rows are grouped by (market and fold, say), a candidate a set of columns with a penalty. One iteration is one
job: tasks add up gradient and curvature of all their keys and candidates, one aggregate adds the tasks' sums, and each
small system is solved where its sums meet. Only coefficients reach the driver, whose number is bounded; beyond the bound
keys are fitted in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import metrics
from ..functions.frames import KEYS
from . import models, ranges, splits

#: Coefficients that the driver and every task hold at once.
MOST_COEFFICIENTS = 5_000_000


@dataclass(frozen=True)
class Candidate:
    """A model to try: its name, its columns, and C, the inverse penalty on their slopes."""

    name: str
    columns: tuple[str, ...]
    c: float


def fit_logistic(df: DataFrame, by: list[str], y: str, candidates: list[Candidate], rounds: int = 30, tolerance: float = 1e-8, only: dict[tuple, str] | None = None) -> DataFrame:
    """(by, candidate, beta, intercept, n, rounds): logistic regressions of y (0 or 1) on each candidate's columns, for each key.

    With `only`, a key is fitted for the candidate named there, and not at all if it is not there.

    The sum of log losses plus |beta|^2 / (2 C) is minimised; the intercept is free. Rows with a null in y or in any
    candidate's column are left out, so all candidates see the same rows. A step that does not lower the objective is halved.
    Null keys are keys. Keys of one class only end near a large intercept after `rounds` rounds.
    """
    every = sorted({x for c in candidates for x in c.columns})
    number = [[every.index(x) for x in c.columns] for c in candidates]
    rows = df.select(*by, F.col(y).cast("double").alias("__y"), *[F.col(x).cast("double").alias(x) for x in every]).dropna(subset=["__y", *every]).persist()
    try:
        keys = rows.select(*by).distinct().count() if by else 1
        size = keys * sum(len(n) + 1 for n in number)
        parts = -(-size // MOST_COEFFICIENTS)
        fits = []
        for part in range(max(1, parts)):
            own = rows if parts <= 1 else rows.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == part)
            fits += _fit_part(own, by, every, number, candidates, rounds, tolerance, only)
    finally:
        rows.unpersist()
    schema = StructType([*[df.schema[k] for k in by], StructField("candidate", StringType()), *StructType.fromDDL("beta array<double>, intercept double, n long, rounds int").fields])
    return df.sparkSession.createDataFrame(fits, schema)


def _fit_part(rows: DataFrame, by: list[str], every: list[str], number: list[list[int]], candidates: list[Candidate], rounds: int, tolerance: float, only: dict[tuple, str] | None) -> list[tuple]:
    allowed = None if only is None else {k: next(m for m, c in enumerate(candidates) if c.name == name) for k, name in only.items()}
    penalty = [1 / c.c for c in candidates]
    context = rows.sparkSession.sparkContext
    key_fields = [rows.schema[k] for k in by]
    schema = StructType([*key_fields, StructField("m", LongType()), StructField("n", LongType()), StructField("objective", DoubleType()), StructField("sums", BinaryType())])
    # Where a fit stands: coefficients, the intercept last; the point before and its objective, for halving.
    state: dict[tuple, tuple[np.ndarray, np.ndarray | None, float, int]] = {}
    done: dict[tuple, tuple[np.ndarray, int, int]] = {}
    first = True
    for turn in range(1, rounds + 1):
        if not first and not state:
            break
        held = context.broadcast({k: v[0] for k, v in state.items()})

        def add(batches: Iterator[pa.RecordBatch], held=held, start=first) -> Iterator[pa.RecordBatch]:
            now, total = held.value, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                label = batch.column("__y").to_numpy()
                x = np.column_stack([*[batch.column(c).to_numpy() for c in every], np.ones(batch.num_rows)])
                own: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in by])):
                    own.setdefault(k, []).append(i)
                for key, at in (own or {(): list(range(batch.num_rows))}).items():
                    for m, use in enumerate(number):
                        if allowed is not None and allowed.get(key) != m:
                            continue
                        w = np.zeros(len(use) + 1) if start else now.get((key, m))
                        if w is None:
                            continue
                        a, t = x[np.ix_(at, [*use, len(every)])], label[at]
                        z = a @ w
                        p = 1 / (1 + np.exp(-z))
                        sums = np.concatenate((a.T @ (p - t), ((a.T * (p * (1 - p))) @ a).ravel()))
                        loss = float(np.sum(np.logaddexp(0, z) - t * z))
                        if (key, m) in total:
                            n, before, s = total[key, m]
                            total[key, m] = (n + len(at), before + loss, s + sums)
                        else:
                            total[key, m] = (len(at), loss, sums)
            out = [(*key, m, n, loss, sums.tobytes()) for (key, m), (n, loss, sums) in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[*by, "m", "n", "objective", "sums"])

        types = [pa.field("x", _arrow(f.dataType)).type for f in schema.fields]
        partial = rows.mapInArrow(add, schema)
        steps = partial.groupBy(*by, "m").applyInPandas(_summed(by), schema).collect()
        held.destroy()
        following = {}
        for r in steps:
            key, m, sums = tuple(r[k] for k in by), r["m"], np.frombuffer(r["sums"])
            p = len(number[m]) + 1
            w, back, best, tries = state.get((key, m), (np.zeros(p), None, np.inf, 0))
            ridge = np.full(p, penalty[m])
            ridge[-1] = 0.0
            value = r["objective"] + 0.5 * float(ridge @ (w * w))
            if back is not None and value > best + 1e-12 * abs(best) and tries < 30:
                following[key, m] = ((w + back) / 2, back, best, tries + 1)
                continue
            gradient, curve = sums[:p] + ridge * w, sums[p:].reshape(p, p) + np.diag(ridge)
            step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
            if np.abs(step).max() < tolerance or turn == rounds:
                done[key, m] = (w - step if turn < rounds else w, r["n"], turn)
            else:
                following[key, m] = (w - step, w, value, 0)
        state, first = following, False
    return [(*key, candidates[m].name, w[:-1].tolist(), float(w[-1]), n, turn) for (key, m), (w, n, turn) in done.items()]


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _summed(by: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["n"], out["objective"] = pdf["n"].sum(), pdf["objective"].sum()
        out["sums"] = [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]
        return out

    return run


def predict_logistic(df: DataFrame, fits: DataFrame, by: list[str], candidates: list[Candidate], keep: list[str]) -> DataFrame:
    """(by, keep, candidate, p): each row of df with the probability of every fit that fits has for its key.

    Rows with a null in any candidate's column are left out, as in fit_logistic(). Coefficients up to MOST_COEFFICIENTS are
    broadcast and met by matrices; more of them meet the rows by key, as one row for each key, and stay expressions.
    """
    every = sorted({x for c in candidates for x in c.columns})
    names = list(dict.fromkeys([*by, *keep]))
    size = fits.agg(F.coalesce(F.sum(F.size("beta") + 1), F.lit(0))).first()[0]
    if size > MOST_COEFFICIENTS:
        return _by_key(df.dropna(subset=every), fits, by, candidates, names, every)
    columns = {c.name: [every.index(x) for x in c.columns] for c in candidates}
    table: dict[tuple, tuple[list[str], list[np.ndarray]]] = {}
    for r in fits.select(*by, "candidate", "beta", "intercept").collect():
        w = np.zeros(len(every) + 1)
        w[columns[r["candidate"]]], w[-1] = r["beta"], r["intercept"]
        labels, weights = table.setdefault(tuple(r[k] for k in by), ([], []))
        labels.append(r["candidate"])
        weights.append(w)
    held = df.sparkSession.sparkContext.broadcast({k: (labels, np.stack(w, axis=1)) for k, (labels, w) in table.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(every))
            known = ~np.isnan(x).any(1)
            own: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in by]) if by else [()] * batch.num_rows):
                if known[i]:
                    own.setdefault(k, []).append(i)
            for key, at in own.items():
                if key in held.value:
                    labels, w = held.value[key]
                    p = 1 / (1 + np.exp(-(x[at] @ w[:-1] + w[-1])))
                    each = pa.array(np.repeat(at, len(labels)))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(each) for c in names], pa.array(labels * len(at), pa.string()), pa.array(p.ravel())], names=[*names, "candidate", "p"])

    schema = StructType([*[df.schema[c] for c in names], StructField("candidate", StringType()), StructField("p", DoubleType())])
    # Nulls are left out by the tasks: a filter over many derived columns is a plan too large to optimise.
    return df.select(*names, F.array(*[F.col(x).cast("double") for x in every]).alias("__x")).mapInArrow(score, schema)


def _by_key(rows: DataFrame, fits: DataFrame, by: list[str], candidates: list[Candidate], names: list[str], every: list[str]) -> DataFrame:
    wide = fits.groupBy(*by).agg(*[F.max(F.when(F.col("candidate") == c.name, F.struct("intercept", "beta"))).alias(f"__f{m}") for m, c in enumerate(candidates)])
    met = ranges.same(rows.select(*dict.fromkeys([*names, *every])), wide, by, "inner")

    def p(m: int, c: Candidate):
        z = F.col(f"__f{m}.intercept")
        for i, x in enumerate(c.columns):
            z = z + F.col(f"__f{m}.beta")[i] * F.col(x).cast("double")
        return 1 / (1 + F.exp(-z))

    cells = F.array(*[F.when(F.col(f"__f{m}").isNotNull(), F.struct(F.lit(c.name).alias("candidate"), p(m, c).alias("p"))) for m, c in enumerate(candidates)])
    return met.select(*names, F.inline(F.filter(cells, lambda x: x.isNotNull())))


def refit_chosen(df: DataFrame, chosen: DataFrame, by: list[str], y: str, candidates: list[Candidate], keep: list[str], role: str = "role") -> DataFrame:
    """(by, keep, candidate, p): the test rows of each key, predicted by its chosen candidate, fitted on the key's training rows.

    chosen has by and candidate, a row for each key. All keys share their Newton steps, whatever their choice.
    """
    only = {tuple(r[k] for k in by): r["candidate"] for r in chosen.collect()}
    fits = fit_logistic(df.where(F.col(role) == "train"), by, y, candidates, only=only)
    return predict_logistic(df.where(F.col(role) == "test"), fits, by, candidates, keep)


def nested(outer: DataFrame, by: list[str], y: str, candidates: list[Candidate], keep: list[str], blocks: int = 3, series: tuple[str, ...] = (*KEYS, "fold")) -> tuple[DataFrame, DataFrame]:
    """(chosen, predictions): for each key of outer (by, role, series, date) the candidate with the best mean inner AUC, refitted, on its test rows.

    The last half of a key's training rows is cut into `blocks` expanding inner folds by series. All inner fits of all keys, folds
    and candidates share their Newton steps (see fit_logistic). chosen: by, candidate, inner_score, candidates, ties by name;
    predictions: by, keep, candidate, p. Test rows take no part in the choice or in the fit.
    """
    inner = splits.inner_folds(outer, blocks, series)
    key = [*by, "inner_fold"]
    fits = fit_logistic(inner.where("inner_role = 'train'"), key, y, candidates)
    scored = predict_logistic(inner.where("inner_role = 'test'"), fits, key, candidates, [y])
    chosen = models.nested_select(metrics.auc(scored, [*key, "candidate"], y, "p"), by, "candidate", "auc")
    # A few rows, held so that the choice is made once.
    chosen = outer.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    return chosen, refit_chosen(outer, chosen, by, y, candidates, keep)
