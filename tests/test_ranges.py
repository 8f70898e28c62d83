"""Ordered work over keys that fill several ranges: the same as for small keys, and as plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspring.functions import metrics
from panelspring.operators import calendar, checks, inference, models, ranges, splits, text

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=int(k))


@pytest.fixture(scope="module")
def series(spark):
    """One key with 900 days, one with 5, a null key; every day once, values with ties and nulls."""
    rng = np.random.default_rng(3)
    rows = [("hot", k) for k in range(900)] + [("few", k) for k in range(5)] + [(None, k) for k in range(30)]
    rows = [(m, day(k), float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal()), int(rng.random() < 0.4), round(float(rng.random()), 2), "train" if k % 3 else "test") for m, k in rows]
    return spark.createDataFrame(rows, "market string, date date, ret double, x double, y int, p double, role string").cache()


def test_ranges_bound_the_largest_task(spark, series):
    rows, hot = ranges.cut(series, ["market"], "date", 100)
    sizes = {(r["market"], r["__range"]): r["count"] for r in rows.groupBy("market", "__range").count().collect()}
    assert hot and len([k for k in sizes if k[0] == "hot"]) == 9 and max(sizes.values()) <= 130 and sizes["few", 0] == 5 and sizes[None, 0] == 30
    rows, hot = ranges.cut(series, ["market"], "date")
    assert not hot and rows.select("__range").distinct().count() == 1
    # Equal values stay together, nulls come first.
    ends = ranges.cut(series, ["market"], "x", 50)[0].groupBy("market", "__range").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("x").isNull()).alias("none")).where("market = 'hot'").orderBy("__range").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:])) and [r["none"] > 0 for r in ends] == [True] + [False] * (len(ends) - 1)


@pytest.mark.parametrize("most", [40, ranges.MOST])
def test_numbers_and_running_sums(series, most):
    got = ranges.numbered(series, ["market"], ["x", "date"], "n", most).collect()
    for market in ("hot", "few", None):
        rows = sorted((r for r in got if r["market"] == market), key=lambda r: (r["x"] is not None, r["x"] or 0, r["date"]))
        assert [r["n"] for r in rows] == list(range(len(rows)))
    for own in (True, False):
        got = ranges.running(series, ["market"], ["date"], {"s": F.col("x"), "k": F.lit(1)}, most, own).collect()
        rows, total = sorted((r for r in got if r["market"] == "hot"), key=lambda r: r["date"]), 0.0
        for i, r in enumerate(rows):
            before, total = total, total + (r["x"] or 0)
            assert r["s"] == pytest.approx(total if own else before) and r["k"] == i + own


@pytest.mark.parametrize("most", [20, ranges.MOST])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_over_a_hot_key(spark, series, most, direction):
    """Against a search in a sorted list; most rows of left share a date, null times have no match, null keys meet."""
    rng = np.random.default_rng(1)
    left = [(i, m, None if i % 50 == 0 else day(7 if i % 3 == 0 else int(rng.integers(-5, 910)))) for i in range(1500) for m in ("hot", None)[: 1 + (i % 10 == 0)]]
    right = [("hot", day(k), int(rng.integers(0, 5)), "a") for k in rng.integers(0, 900, 160)] + [(None, day(3), 9, "z"), ("hot", None, 1, "n"), ("other", day(0), 1, "o")]
    a = spark.createDataFrame(left, "id int, market string, date date")
    b = spark.createDataFrame(right, "market string, date date, v int, w string")
    got = {(r["id"], r["market"]): (r["right_on"], r["v"], r["w"]) for r in calendar.asof_join(a, b, "date", ["market"], ["v", "w"], direction, most).collect()}
    assert len(got) == len(left)
    for i, m, t in left:
        fits = [r for r in right if r[0] == m and r[1] is not None and t is not None and (r[1] <= t if direction == "backward" else r[1] >= t)]
        at = (max if direction == "backward" else min)((r[1] for r in fits), default=None)
        best = max(((r[2], r[3]) for r in fits if r[1] == at), default=(None, None))
        assert got[i, m] == (at, *best)


def test_asof_reads_distinct_times_only(spark):
    """The rows that are put in order are the times of both sides, not the rows of left."""
    left = spark.range(20_000).select("id", F.lit("m").alias("market"), F.date_add(F.lit(DAY), (F.col("id") % 20).cast("int")).alias("date"))
    cal = spark.createDataFrame([("m", day(k)) for k in range(0, 30, 3)], "market string, date date")
    out = calendar.rolled_volume(left, cal)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Window") == plan.count("WindowExec") + plan.count("Window ")
    got = {r["trade_date"]: (r["n"], r["n_rolled"]) for r in out.collect()}
    assert got[day(0)] == (1000, 0) and got[day(3)] == (3000, 2000) and got[day(18)] == (3000, 2000) and got[day(21)] == (1000, 1000) and sum(n for n, _ in got.values()) == 20_000


@pytest.mark.parametrize("most", [64, ranges.MOST])
def test_garch_against_a_loop(series, most):
    grid = [(0.05, 0.05, 0.85, 0.1), (0.1, 0.2, 0.7, 0.0), (0.5, 0.5, 0.0, 0.0)]
    filtered = models.garch_filter(series, ["market"], *grid[0], most=most).collect()
    fits = {(r["market"], r["beta"]): r["loglik"] for r in models.garch_grid(series, ["market"], grid, most=most).collect()}
    for market in ("hot", "few", None):
        rows = sorted((r for r in series.collect() if r["market"] == market), key=lambda r: r["date"])
        h0 = np.mean([r["ret"] ** 2 for r in rows])
        variance = {r["date"]: r["variance"] for r in filtered if r["market"] == market}
        for omega, alpha, beta, gamma in grid:
            h, ll = h0, 0.0
            for r in rows:
                if beta == grid[0][2]:
                    assert variance[r["date"]] == pytest.approx(h, rel=1e-12)
                ll -= 0.5 * (math.log(2 * math.pi) + math.log(h) + r["ret"] ** 2 / h)
                h = omega * h0 + (alpha + gamma * (r["ret"] < 0)) * r["ret"] ** 2 + beta * h
            assert fits[market, beta] == pytest.approx(ll, rel=1e-10)


@pytest.mark.parametrize("most", [64, ranges.MOST])
def test_ewma_against_a_loop(series, most):
    got = text.ewma(series, {"a": ("ret", 5), "b": ("x", 20)}, most=most).collect()
    for market in ("hot", "few", None):
        rows = sorted((r for r in got if r["market"] == market), key=lambda r: r["date"])
        for i, r in enumerate(rows):
            for out, c, span in (("a", "ret", 5), ("b", "x", 20)):
                past = [s[c] for s in rows[max(0, i - 59) : i + 1] if s[c] is not None][::-1]
                w = [(1 - 2 / (span + 1)) ** k for k in range(len(past))]
                want = sum(a * b for a, b in zip(w, past)) / sum(w) if past else None
                assert r[out] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_a_long_series_is_scanned_in_many_tasks(spark):
    """300,000 rows of one series in 30 ranges: linear recursion against numpy at the end of every range."""
    n = 300_000
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.sin(F.col("id").cast("double")).alias("a"))
    got = ranges.affine_scan(df, ["k"], "t", {"v": (F.col("a"), F.lit(0.97))}, F.lit(2.0), 10_000)
    want, v = np.zeros(n), 2.0
    for i, a in enumerate(np.sin(np.arange(n, dtype=float))):
        want[i], v = v, a + 0.97 * v
    rows = got.where("t % 9973 = 0 OR t > 299990").select("t", "v").collect()
    assert max(abs(r["v"] - want[r["t"]]) for r in rows) < 1e-9 and len(rows) > 30
    assert ranges.cut(df, ["k"], "t", 10_000)[0].select("__range").distinct().count() == 30


@pytest.mark.parametrize("accuracy,most", [(10_000, ranges.MOST), (100, 5)])
def test_selection_is_exact(spark, series, accuracy, most):
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r["market"]: r for r in ranges.selected(series, ["market"], ["x", "p"], shares, accuracy, most).collect()}
    for market in ("hot", "few", None):
        for c in ("x", "p"):
            values = [r[c] for r in series.collect() if r["market"] == market and r[c] is not None]
            assert [got[market][f"{c}_{k}"] for k in range(len(shares))] == pytest.approx(np.quantile(values, shares).tolist())
    whole = ranges.selected(series, [], ["ret"], [0.25]).collect()
    assert whole[0]["ret_0"] == pytest.approx(np.quantile([r["ret"] for r in series.collect()], 0.25))
    none = ranges.selected(series.withColumn("x", F.lit(None).cast("double")), ["market"], ["x"], [0.5]).collect()
    assert len(none) == 3 and all(r["x_0"] is None for r in none)


def test_ranks_are_the_same_in_ranges(series):
    same = lambda f: [sorted(map(str, f(m).collect())) for m in (30, ranges.MOST)]
    for f in (
        lambda m: metrics.auc(series, ["market"], "y", "p", m),
        lambda m: metrics.calibration_bins(series, ["market"], ["date"], 10, "y", "p", m).select("market", "bin", F.round("forecast", 9), F.round("outcome", 9), "n"),
        lambda m: metrics.cumulative_hits(series, ["market"], ["date"], "y", "p", m),
        lambda m: splits.rank_scaled(series, "x", ("market",), m),
    ):
        a, b = same(f)
        assert a == b and a
    bins = {r["bin"]: r["n"] for r in metrics.calibration_bins(series, ["market"], ["date"], 7, "y", "p").where("market = 'hot'").collect()}
    assert bins == {k: 129 if k <= 900 % 7 else 128 for k in range(1, 8)}
    few = metrics.calibration_bins(series, ["market"], ["date"], 10, "y", "p").where("market = 'few'").collect()
    assert sorted(r["bin"] for r in few) == [1, 2, 3, 4, 5]


def plain_auc(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    return np.mean(pairs) if pairs else None


@pytest.mark.parametrize("most", [25, ranges.MOST])
def test_auc_of_replicates(spark, series, most):
    """Rows drawn and scored one by one; a key shorter than a block has no replicate."""
    few = series.where("market = 'few' OR (market = 'hot' AND date < '2020-04-10')")
    got = {(r["market"], r["rep"]): r["auc"] for r in inference.replicate_aucs(few, ["market"], ["date"], "y", "p", 7, 10, 42, most).collect()}
    rows = sorted((r for r in few.collect() if r["market"] == "hot"), key=lambda r: r["date"])
    n, mod = len(rows), inference.P
    assert set(got) == {("hot", r) for r in range(7)}
    for rep in range(7):
        drawn = []
        for blk in range(-(-n // 10)):
            x = (48271 * (rep + 1) + 69621 * (blk + 1) + 42) % mod
            for _ in range(4):
                x = (x * x + 48271 * x + 69621 * (blk + 1) + rep + 1) % mod
            s = x % (n - 10 + 1)
            drawn += rows[s : s + 10]
        assert got["hot", rep] == pytest.approx(plain_auc([r["y"] for r in drawn], [r["p"] for r in drawn]), abs=1e-12)


@pytest.mark.parametrize("most", [50, ranges.MOST])
@pytest.mark.parametrize("bandwidth", [None, 0, 3, 40])
def test_block_sums_are_bartlett_weights(series, most, bandwidth):
    """Against autocovariances lag by lag, also with more lags than a short series has rows."""
    got = {r["market"]: r for r in inference.diebold_mariano(series, ["market"], ["date"], F.col("ret"), F.col("p"), bandwidth=bandwidth, most=most).collect()}
    for market in ("hot", "few", None):
        d = np.array([r["ret"] ** 2 - r["p"] ** 2 for r in sorted((r for r in series.collect() if r["market"] == market), key=lambda r: r["date"])])
        n, c = len(d), d - d.mean()
        lags = math.ceil(n ** (1 / 3)) if bandwidth is None else bandwidth
        lrv = (c @ c + 2 * sum((1 - k / (lags + 1)) * (c[k:] @ c[:-k]) for k in range(1, min(lags, n - 1) + 1))) / n
        assert got[market]["lrv"] == pytest.approx(lrv, rel=1e-9, abs=1e-12) and got[market]["n"] == n and got[market]["mean_diff"] == pytest.approx(d.mean())
        assert got[market]["dm"] == pytest.approx(d.mean() / math.sqrt(lrv / n), rel=1e-9)


def test_digests_tell_multisets_apart(spark):
    base = [("a", None, "x", 1.0), ("a", "x", None, 1.0), ("b", "1:x", "", 2.0), ("b", "1:x", "", 2.0), (None, "q", "q", None)]
    df = lambda rows: spark.createDataFrame(rows, "k string, s string, t string, v double")
    changed = lambda rows: {r["k"] for r in checks.unequal(df(base), df(rows), ["k"]).collect()}
    assert changed(base[::-1]) == set()
    assert changed(base[:3] + base[4:]) == {"b"}  # one of two equal rows is gone
    assert changed([("a", "x", None, 1.0), ("a", "x", None, 1.0), *base[2:]]) == {"a"}  # a null in another column
    assert changed([*base[:2], ("b", "1:x", "", 2.0), ("b", "1", "x", 2.0), base[4]]) == {"b"}
    assert changed([*base[:4], (None, "q", "q", 0.0)]) == {None} and changed(base[2:4]) == {"a", None} and changed([*base, ("c", None, None, None)]) == {"c"}
    one = checks.equality(df(base), df(base[:3] + [("c", "", "", 0.0)]), ["k"]).first()
    assert (one["only_a"], one["only_b"]) == (2, 1) and tuple(checks.equality(df(base), df(base)).first()) == (0, 0)


def test_verify_reports_the_days_that_differ(spark):
    rows = [("m", day(k), i, k % 7) for k in range(100) for i in range(3)]
    df = lambda r: spark.createDataFrame(r, "market string, date date, id int, score int")
    stored = [r for r in rows if r[1] != day(40) or r[2] != 1] + [("m", day(5), 9, 0), ("m", day(200), 1, 1)]
    stored = [("m", d, i, 99) if (d, i) == (day(41), 0) else (m, d, i, s) for m, d, i, s in stored]
    got = {r["date"]: (r["n_stored"], r["n_computed"], r["only_stored"], r["only_computed"]) for r in checks.differing_days(df(stored), df(rows)).collect()}
    assert got == {day(5): (4, 3, 1, 0), day(40): (2, 3, 0, 1), day(41): (3, 3, 1, 1), day(200): (1, 0, 1, 0)}
