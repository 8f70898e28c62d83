"""Batched fits, block covariances, early stopping and nested choice, against solves by numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F


from panelspring.operators import batched, gram, inference, models
from panelspring.plans import fixtures, queries_models, queries_news  # noqa: F401  they register
from panelspring.plans.queries_features import QUERIES


def newton(x, y, c):
    """Logistic regression with penalty 1 / (2 C) on the slopes; intercept last."""
    a, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], 1 / c), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
    return w


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = []
    for key in ("u", "v", None):
        for i in range(150):
            a, b, c = rng.normal(size=3)
            rows.append((key, i, i % 2, float(a), float(3 * b), None if i % 37 == 0 else float(c), int(rng.random() < 1 / (1 + np.exp(-(a - b + (key == "u")))))))
    return spark.createDataFrame(rows, "k string, i int, f int, a double, b double, c double, y int").repartition(5).cache()


CANDIDATES = [batched.Candidate("ab/0.01", ("a", "b"), 0.01), batched.Candidate("abc/1", ("a", "b", "c"), 1.0), batched.Candidate("c/100", ("c",), 100.0)]


def test_all_fits_equal_single_newton_solves(labelled, monkeypatch):
    rows = labelled.dropna(subset=["c"]).collect()
    for most in (batched.MOST_COEFFICIENTS, 20):  # beyond the bound keys are fitted in parts
        monkeypatch.setattr(batched, "MOST_COEFFICIENTS", most)
        fits = batched.fit_logistic(labelled, ["k", "f"], "y", CANDIDATES).collect()
        assert len(fits) == 3 * 2 * 3
        for r in fits:
            c = next(c for c in CANDIDATES if c.name == r["candidate"])
            own = [x for x in rows if (x["k"], x["f"]) == (r["k"], r["f"])]
            want = newton(np.array([[x[n] for n in c.columns] for x in own]), np.array([x["y"] for x in own], float), c.c)
            assert r["n"] == len(own) and [*r["beta"], r["intercept"]] == pytest.approx(want.tolist(), abs=1e-6)
    one = batched.fit_logistic(labelled, [], "y", CANDIDATES[:1]).collect()
    assert [*one[0]["beta"], one[0]["intercept"]] == pytest.approx(newton(np.array([[x["a"], x["b"]] for x in rows + [x for x in labelled.collect() if x["c"] is None]]), np.array([x["y"] for x in rows + [x for x in labelled.collect() if x["c"] is None]], float), 0.01).tolist(), abs=1e-6)


def test_fits_that_need_halving_and_keys_of_one_class(spark):
    """Separable rows with hardly a penalty, and a key whose labels are all 1: finite, and the objective's least value where there is one."""
    rows = [("sep", float(i - 20) * 5, int(i >= 20)) for i in range(40)] + [("one", float(i), 1) for i in range(10)]
    fits = {r["k"]: r for r in batched.fit_logistic(spark.createDataFrame(rows, "k string, x double, y int"), ["k"], "y", [batched.Candidate("x", ("x",), 1e3)]).collect()}
    assert all(np.isfinite(r["beta"]).all() and np.isfinite(r["intercept"]) for r in fits.values())
    assert fits["sep"]["beta"][0] > 0 and fits["one"]["intercept"] > 5
    assert batched.fit_logistic(spark.createDataFrame([], "k string, x double, y int"), ["k"], "y", [batched.Candidate("x", ("x",), 1.0)]).count() == 0


@pytest.mark.parametrize("most", [batched.MOST_COEFFICIENTS, 3])
def test_predictions_and_choice(labelled, most, monkeypatch):
    monkeypatch.setattr(batched, "MOST_COEFFICIENTS", most)
    chosen = labelled.sparkSession.createDataFrame([("u", 0, "abc/1"), ("v", 1, "ab/0.01"), (None, 0, "c/100")], "k string, f int, candidate string")
    df = labelled.withColumn("role", F.when(F.col("i") < 100, "train").otherwise("test"))
    got = batched.refit_chosen(df, chosen, ["k", "f"], "y", CANDIDATES, ["i"]).collect()
    rows = [r for r in df.dropna(subset=["a", "b", "c"]).collect()]
    for k, f, name in (("u", 0, "abc/1"), ("v", 1, "ab/0.01"), (None, 0, "c/100")):
        c = next(c for c in CANDIDATES if c.name == name)
        own = [r for r in rows if (r["k"], r["f"]) == (k, f)]
        train = [r for r in own if r["role"] == "train"]
        w = newton(np.array([[r[n] for n in c.columns] for r in train]), np.array([r["y"] for r in train], float), c.c)
        want = {r["i"]: 1 / (1 + np.exp(-(np.array([r[n] for n in c.columns]) @ w[:-1] + w[-1]))) for r in own if r["role"] == "test"}
        have = {r["i"]: r["p"] for r in got if (r["k"], r["f"], r["candidate"]) == (k, f, name)}
        assert have.keys() == want.keys() and all(have[i] == pytest.approx(want[i], abs=1e-8) for i in want)
    assert {(r["k"], r["f"]) for r in got} == {("u", 0), ("v", 1), (None, 0)}


def test_nested_choice_by_hand(spark):
    """The candidate with the signal is chosen; its score, the refit and the predictions equal single fits on folds cut by hand."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        x, z = rng.normal(size=2)
        rows.append(("M", "S", i, 0, "train" if i < 200 else "test", float(x), float(z), int(rng.random() < 1 / (1 + np.exp(-2 * x)))))
    outer = spark.createDataFrame(rows, "market string, symbol string, date int, fold int, role string, x double, z double, y int")
    candidates = [batched.Candidate("noise", ("z",), 0.1), batched.Candidate("signal", ("x",), 0.1)]
    chosen, preds = batched.nested(outer, ["market", "fold"], "y", candidates, ["date", "y"])
    auc = lambda s, t: np.mean([(a > b) + 0.5 * (a == b) for a, u in zip(s, t) if u for b, v in zip(s, t) if not v])
    x, y = np.array([r[5] for r in rows]), np.array([r[7] for r in rows], float)
    scores = []
    for lo, hi in ((100, 133), (133, 166), (166, 200)):
        w = newton(x[:lo, None], y[:lo], 0.1)
        scores.append(auc(x[lo:hi] * w[0], y[lo:hi]))
    r = chosen.first()
    assert (r["candidate"], r["candidates"]) == ("signal", 2) and r["inner_score"] == pytest.approx(np.mean(scores))
    w = newton(x[:200, None], y[:200], 0.1)
    assert {p["date"]: p["p"] for p in preds.collect()} == {i: pytest.approx(1 / (1 + np.exp(-(w[0] * x[i] + w[1]))), abs=1e-8) for i in range(200, 240)}


def test_h13_refits_the_choice(spark, small):
    """One prediction a test row, by the best of 28 candidates of its fold, which equals a single fit on the fold's training rows."""
    assert len(queries_models.CANDIDATES) == 28 and {len(c.columns) for c in queries_models.CANDIDATES} >= {25, 71}
    got = QUERIES["h13_nested_refit"](spark, small).collect()
    outer = queries_models._outer(spark, small)
    want = {(r["fold"], r["symbol"], r["date"]) for r in outer.where("role = 'test'").collect()}
    assert {(r["fold"], r["symbol"], r["date"]) for r in got} == want and len(got) == len(want) and {r["candidates"] for r in got} == {28}
    by_fold = {r["fold"]: r["candidate"] for r in got}
    assert all(by_fold[r["fold"]] == r["candidate"] for r in got)
    fold = min(by_fold)
    c = next(c for c in queries_models.CANDIDATES if c.name == by_fold[fold])
    rows = [r for r in outer.where(F.col("fold") == fold).collect()]
    x, y = np.array([[r[n] for n in c.columns] for r in rows], float), np.array([r["y_dir"] for r in rows], float)
    train = np.array([r["role"] == "train" for r in rows])
    w = newton(x[train], y[train], c.c)
    p = {(r["symbol"], r["date"]): r["p"] for r in got if r["fold"] == fold}
    for i in np.flatnonzero(~train):
        assert p[rows[i]["symbol"], rows[i]["date"]] == pytest.approx(1 / (1 + np.exp(-(x[i] @ w[:-1] + w[-1]))), abs=1e-5)


@pytest.mark.parametrize("block,held", [(3, gram.HELD), (128, 50)])
def test_block_covariances(spark, block, held, monkeypatch):
    """Blocks of any size, sums handed on early, sparse and dense columns, a far-off mean: R2 as by numpy on whole matrices."""
    monkeypatch.setattr(gram, "HELD", held)
    rng = np.random.default_rng(4)
    rows = []
    for k in ("p", None):
        for i in range(160):
            x = (rng.normal(size=4) + 1e6).tolist()
            s = sorted({int(j): float(rng.random()) for j in rng.integers(0, 6, int(rng.integers(0, 4)))}.items())
            rows.append((k, "train" if i < 120 else "test", x, s if s or i % 2 else None, None if i == 7 else x[0] - 1e6 + 2 * dict(s).get(2, 0) + float(rng.normal())))
    df = spark.createDataFrame(rows, "k string, role string, x array<double>, s array<struct<i:int,v:double>>, y double").repartition(4)
    groups = {"dense": [0, 1, 2, 3], "sparse": [4, 5, 6, 7, 8, 9], "some": [0, 6], "all": list(range(10))}
    got = {(r["k"], r["feature_group"]): r["r2"] for r in gram.group_scores(df, ["k"], groups, 4, 6, 1.0, block).collect()}
    for k in ("p", None):
        own = [r for r in rows if r[0] == k and r[4] is not None]
        x = np.array([[*r[2], *[dict(r[3] or []).get(j, 0.0) for j in range(6)]] for r in own])
        y, train = np.array([r[4] for r in own]), np.array([r[1] == "train" for r in own])
        for g, use in groups.items():
            a = x[train][:, use] - x[train][:, use].mean(0)
            b = np.linalg.solve(a.T @ a + np.eye(len(use)), a.T @ (y[train] - y[train].mean()))
            fit = y[train].mean() + (x[~train][:, use] - x[train][:, use].mean(0)) @ b
            assert got[k, g] == pytest.approx(1 - ((y[~train] - fit) ** 2).sum() / ((y[~train] - y[~train].mean()) ** 2).sum(), abs=1e-6)


def test_h15_texts_against_vectors(spark, small):
    """500 terms and 64 vector columns under equal conditions, for one symbol against numpy on the same rows."""
    got = {(r["symbol"], r["feature_group"]): r["r2"] for r in QUERIES["h15_text_ablation"](spark, small).collect()}
    rows = queries_models._texts(spark, small).where("symbol = '1-URGENT'").collect()
    x = np.zeros((len(rows), 589))
    for k, r in enumerate(rows):
        x[k, :89] = r["x"]
        for e in r["s"] or ():
            x[k, 89 + e["i"]] = e["v"]
    assert np.count_nonzero(x[:, 89:].any(1)) > 10 and np.count_nonzero(x[:, 25:89].any(1)) > 10
    y, role = np.array([r["y"] for r in rows]), np.array([r["role"] for r in rows])
    train, test = role == "train", role == "test"
    for g, use in queries_models._TEXT_GROUPS.items():
        use = list(use)
        a = x[train][:, use] - x[train][:, use].mean(0)
        b = np.linalg.solve(a.T @ a + np.eye(len(use)), a.T @ (y[train] - y[train].mean()))
        fit = y[train].mean() + (x[test][:, use] - x[train][:, use].mean(0)) @ b
        assert got["1-URGENT", g] == pytest.approx(1 - ((y[test] - fit) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum(), abs=1e-5)


def test_patience():
    assert models.patience([5, 4, 3, 3.5, 3.2, 3.1], 3) == (3, 6) and models.patience([5, 4, 3, 3.5, 2.0, 3.1], 3) == (5, 6) and models.patience([1.0], 40) == (1, 1)
    losses = [1 / (k + 1) for k in range(30)] + [0.5 + k for k in range(100)]
    assert models.patience(losses, 40) == (30, 70)


@pytest.mark.parametrize("kind", ["reg", "clf"])
def test_early_stopping_finds_a_planted_optimum(spark, kind):
    """Validation labels that the training noise cannot predict: the loss turns early; the cut model is the full one's first trees."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x = rng.normal(size=3)
        y = float(x[0] + rng.normal()) if kind == "reg" else float(rng.random() < 1 / (1 + np.exp(-2 * x[0])))
        rows.append((i, *map(float, x), y))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double").coalesce(1).cache()
    train, valid = df.where("i < 250"), df.where("i >= 250")
    xs, how = ["a", "b", "c"], {"depth": 4, "rate": 0.3, "subsample": 1.0, "colsample": 1.0}
    model, curve = models.early_stopped(spark, train, valid, xs, "y", kind, trees=30, rounds=8, **how)
    curve = sorted(curve.collect(), key=lambda r: r["trees"])
    best = next(r["trees"] for r in curve if r["best"])
    assert [r["trees"] for r in curve] == list(range(1, len(curve) + 1)) and 1 < len(curve) < 30 and len(curve) == best + 8
    assert min(curve, key=lambda r: r["loss"])["trees"] == best == model.getNumTrees
    whole = models.boosted_trees(train, xs, "y", kind, 30, **how)
    small = models.boosted_trees(train, xs, "y", kind, best, **how)
    out = lambda m: [r["v"] for r in (models.prediction(m, valid, xs, "v") if kind == "reg" else models.probability(m, valid, xs, "v")).orderBy("i").select("v").collect()]
    assert out(model) == pytest.approx(out(small)) and out(model) != pytest.approx(out(whole))
    if kind == "reg":
        assert np.mean([(a - r[4]) ** 2 for a, r in zip(out(model), rows[250:])]) == pytest.approx(curve[best - 1]["loss"])


def test_choice_sees_no_test_rows(spark, small):
    """h23: other test targets change the test score and nothing else."""
    full = queries_models._full(spark, small)
    turned = full.withColumn("y_logvol", F.when(F.col("role") == "test", -F.col("y_logvol")).otherwise(F.col("y_logvol")))
    a, b = (sorted(models.select_and_refit(d, ["symbol"], queries_models.CHOICE, "y_logvol").collect()) for d in (full, turned))
    assert [(r["symbol"], r["feature_group"], r["r2_valid"]) for r in a] == [(r["symbol"], r["feature_group"], r["r2_valid"]) for r in b] and [r["r2_test"] for r in a] != [r["r2_test"] for r in b]


def test_every_headline_has_components(spark, small):
    """c2: a text without any of the terms is kept; term vectors have length 1 or 0."""
    h = fixtures.headlines(spark, small)
    assert QUERIES["c2_tfidf_pca"](spark, small).count() == h.count()
    from panelspring.operators import text

    odd = h.limit(20).select("headline_id", "headline").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 34")], "headline_id long, headline string"))
    got = {r["headline_id"]: np.array(r["vec"]) for r in text.term_vectors(odd, vocab=50).collect()}
    assert len(got) == 23 and all(len(v) == 50 for v in got.values()) and all(not got[k].any() for k in (-1, -2, -3))
    assert all(np.linalg.norm(v) == pytest.approx(1) for k, v in got.items() if k >= 0 and v.any()) and sum(v.any() for v in got.values()) > 10


@pytest.mark.parametrize("name", ["j2_paired_bootstrap", "j9_block_length"])
def test_block_starts_are_not_broadcast(spark, small, name):
    """j2, j9: draws are replicates x blocks, whatever Spark estimates; the driver must not collect them."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_block_lengths_share_one_plan(spark, small):
    """j9: all lengths come from one read and one join, or the driver holds a plan for each; intervals are those of a bootstrap for each length, groups shorter than a block have none."""
    plan = QUERIES["j9_block_length"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    rng = np.random.default_rng(5)
    rows = [(g, i, float(v), float(v + e) if i % 7 else None) for g, n in (("a", 90), ("b", 14)) for i, (v, e) in enumerate(zip(rng.normal(size=n), rng.normal(size=n)))]
    df = spark.createDataFrame(rows, "g string, i int, y double, yhat double")
    got = {(r["g"], r["block_length"]): (r["ci_lo"], r["ci_hi"], r["reps"]) for r in inference.bootstrap_r2_lengths(df, ["g"], ["i"], reps=60, lengths=(12, 5, 20, 5)).collect()}
    want = {}
    for g, n in itertools.product("ab", (5, 12, 20)):
        pairs = np.array([(y, p) for k, _, y, p in rows if k == g and p is not None])
        if len(pairs) < n:
            continue
        r2 = []
        for rep in range(60):
            at = []
            for blk in range(-(-len(pairs) // n)):
                x = (inference.M1 * (rep + 1) + inference.M2 * (blk + 1) + 42) % inference.P
                for _ in range(4):
                    x = (x * x + inference.M1 * x + inference.M2 * (blk + 1) + rep + 1) % inference.P
                at += range(x % (len(pairs) - n + 1), x % (len(pairs) - n + 1) + n)
            y, p = pairs[at].T
            r2.append(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        want[g, n] = (*np.quantile(r2, [0.025, 0.975]), 60)
    assert got.keys() == want.keys() == {("a", 5), ("a", 12), ("a", 20), ("b", 5), ("b", 12)} and all(got[k] == pytest.approx(want[k]) for k in want)
    for n in (5, 20):
        assert all(got[r["g"], n] == pytest.approx((r["ci_lo"], r["ci_hi"], r["reps"])) for r in inference.bootstrap_r2(df, ["g"], ["i"], reps=60, length=n).collect())


def test_term_vectors_come_from_their_own_texts(spark, small):
    """c2: weights are those of term_weights(), texts without terms and tables without tokens included, and no text or pair of text and token is shuffled."""
    from panelspring.operators import text

    h = fixtures.headlines(spark, small).select("headline_id", "headline").unionByName(spark.createDataFrame([(-1, None), (-2, "12")], "headline_id long, headline string"))
    got = text.term_vectors(h, vocab=40)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    weights = text.term_weights(h, vocab=40, norm="l2", plus_one=True).collect()
    at = {t: i for i, t in enumerate(sorted({r["token"] for r in weights}))}
    want = {r["headline_id"]: np.zeros(40) for r in h.collect()}
    for r in weights:
        want[r["headline_id"]][at[r["token"]]] = r["weight"]
    rows = got.collect()
    assert len(rows) == len(want) and all(r["vec"] == pytest.approx(want[r["headline_id"]].tolist(), abs=1e-12) for r in rows)
    none = text.term_vectors(h.where("headline_id < 0"), vocab=3)
    assert sorted((r["headline_id"], r["vec"]) for r in none.collect()) == [(-2, [0.0] * 3), (-1, [0.0] * 3)] and not text.term_vectors(h.where("false"), vocab=3).collect()


def test_scorers_see_bounded_runs_of_texts(spark):
    """c3: however long the texts of a batch are, a scorer gets few bytes or one row at a time; order, nulls, other columns and vectors stay."""
    import pandas as pd

    from panelspring.operators import text

    def scorer(s):
        return pd.DataFrame({"pos": s.str.len().astype(float), "neg": float(s.str.len().sum()), "neu": float(len(s)), "vec": [[float(len(x))] for x in s]})

    sizes = [10, 900_000, 900_000, 900_000, 0, 5_000_000, 3] + [200_000] * 40
    df = spark.createDataFrame([(i, None if n == 0 else n) for i, n in enumerate(sizes)], "headline_id int, n int").coalesce(1).selectExpr("headline_id", "repeat('é', n) AS headline", "headline_id % 3 = 0 AS odd")
    rows = text.score_headlines(df, scorer, with_vector=True).select("headline_id", "odd", "pos", "neg", "neu", "vec", F.length("headline").alias("n")).collect()
    assert [(r["headline_id"], r["odd"], r["pos"], r["vec"], r["n"]) for r in rows] == [(i, i % 3 == 0, float(n), [float(n)], n or None) for i, n in enumerate(sizes)]
    assert all(2 * r["neg"] <= text.SCORED or r["neu"] == 1 for r in rows) and any(r["neu"] > 3 for r in rows)
    assert not text.score_headlines(df.where("false"), scorer, with_vector=True).collect()


def test_day_terms_shuffle_sums_of_days_only(spark, small):
    """h15: the day's mean of term_weights(), from sums by day and term; neither headlines nor their tokens are shuffled."""
    from panelspring.operators import text

    got = fixtures.day_terms(spark, small, vocab=30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(date" in plan and not any(x in plan for x in ("token", "Exchange hashpartitioning(headline_id", "Window"))
    days = {r["headline_id"]: r["date"] for r in fixtures.headlines(spark, small).collect()}
    weights = text.term_weights(fixtures.headlines(spark, small), vocab=30, norm="l2", plus_one=True).collect()
    at = {t: i for i, t in enumerate(sorted({r["token"] for r in weights}))}
    want: dict = {}
    for r in weights:
        day = want.setdefault(days[r["headline_id"]], {})
        day[at[r["token"]]] = day.get(at[r["token"]], 0.0) + r["weight"] / list(days.values()).count(days[r["headline_id"]])
    rows = {r["date"]: r["s"] for r in got.collect()}
    assert rows.keys() == want.keys() and all([e["i"] for e in s] == sorted(want[d]) and [e["v"] for e in s] == pytest.approx([want[d][i] for i in sorted(want[d])]) for d, s in rows.items())


def test_scorer_fits_on_sparse_counts_that_are_read_once(spark, monkeypatch):
    """c3: log counts reach the fit sparse and persisted; of tokens that are equally common the first ones are taken."""
    from panelspring.operators import text

    seen, fit = [], text.LogisticRegression.fit
    monkeypatch.setattr(text.LogisticRegression, "fit", lambda self, d: (seen.append((d, d.storageLevel.useMemory, [r[0] for r in d.select("__x").collect()])), fit(self, d))[1])
    df = spark.createDataFrame([("dd bb aa", 1), ("cc aa", 0), ("bb cc dd aa", 1), ("zz", None)], "headline string, label int")
    scorer = text.fit_scorer(df, vocab=3)
    (vectors, stored, xs), = seen
    assert stored and not vectors.storageLevel.useMemory and all(type(x).__name__ == "SparseVector" for x in xs)
    import pandas as pd

    assert scorer(pd.Series(["aa", "bb", "cc", "dd", "zz", ""]))["neu"].tolist() == [0, 0, 0, 1, 1, 1]
