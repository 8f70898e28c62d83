"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from collections import defaultdict

import pytest
from test_brute_force import cut, near, order_of, shingle_set

import __spark_entry__
import corpus_pipeline
from panelspring.llm.common import write_shared


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = write_shared(stage(spark, docs, small), name.replace(" ", "_"))
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def texts(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_columns(stages):
    for rows in stages[:-1]:
        assert list(rows[0]) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark, small, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_quality_of_the_middle_tables(spark):
    small = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, small).select("doc_id").collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_near_dedup(stages):
    want = near(texts(stages[1]), 80)
    assert {r["doc_id"] for r in stages[2]} == {d for d, (_, c) in want.items() if c == d}


def test_repeats(stages):
    before = texts(stages[2])
    want = [(d, t if not removed else kept.decode("utf-8", "ignore")) for (d, t), (_, removed, _, kept) in zip(before, cut([t for _, t in before]))]
    assert texts(stages[3]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_benchmark_documents_go(spark, small, stages):
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    gone = {d for d, _ in texts(stages[3])} - {d for d, _ in texts(stages[4])}
    for d, t in texts(stages[3]):
        overlap = max(len(shingle_set(t) & s) / len(s) for s in items)
        assert d in gone if overlap > 0.8 else (d not in gone or overlap > 0)


def test_training_order(stages):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in stages[4]:
        sizes[r["source"]] += len(r["text"].encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).decode().split(" ")) - (r["text"].encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).decode().split(" ")).count("")
    for r in stages[5]:
        taken[r["source"]] += r["size"]
        assert 0 <= r["position"] <= 1 and 0 <= r["copy"] < 3
    total = sum(sizes.values())
    assert abs(sum(taken.values()) - total) < 0.1 * total
    assert len({(r["doc_id"], r["copy"]) for r in stages[5]}) == len(stages[5])


def test_training_order_follows_the_schedule(stages):
    want = order_of(stages[4], corpus_pipeline.mixing.PHASES)
    assert {(r["doc_id"], r["copy"]): pytest.approx(r["position"], abs=1e-9) for r in stages[5]} == want


def test_the_order_has_the_texts(spark, small, stages):
    whole = {r["doc_id"]: r["text"] for r in stages[4]}
    assert stages[5] and all(r["text"] == whole[r["doc_id"]] for r in stages[5])
    rows = [(None, "null one", "a"), (None, "null two words", "a"), (1, "same id", "a"), (1, "same id, other", "b"), (2, "twice", "a"), (2, "twice", "a"), (3, None, None), (4, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.training_order(spark, docs, small).collect()
    mixed = corpus_pipeline.mixing.mix(docs).collect()
    assert len(got) == sum(r["copies"] for r in mixed) and {(r["doc_id"], r["text"], r["source"]) for r in got} <= set(rows)
    assert sum(r["size"] for r in got) == sum(r["taken"] for r in mixed) and all(r["size"] == len((r["text"] or "").split()) for r in got)
    assert {r["text"] for r in got} >= {"null one", "null two words"} and sum(r["doc_id"] == 2 for r in got) == sum(r["copies"] for r in mixed if r["doc_id"] == 2)


def test_repeated_rows_and_ids(spark, small):
    """Repeated rows, null ids and shared ids: one row of each group stays, whole, and others are judged by their own text."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in ("alpha", "beta", "gamma", "delta"))
    near_c = c.replace("gamma59", "other")
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, b + " "), (2, near_c), (1, c), (2, d), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, docs, small)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [(i, t and t.strip()) for i, t in got] == sorted([(1, a), (1, c), (2, d), (3, ""), (3, ""), (4, None), (None, b)], key=str)
    after = {t.strip() for _, t in texts(corpus_pipeline.repeated_strings(spark, kept, small).where("doc_id IS NOT NULL AND text IS NOT NULL").collect())}
    assert after == {a, c, d, ""}


def test_contaminated_rows_go_by_row(spark, small):
    item = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r["text"]), key=len)
    rows = [(None, item), (None, "clean and short"), (1, item), (1, "another clean one"), (2, None)]
    got = corpus_pipeline.benchmark_overlap(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    assert {tuple(r) for r in got} == {(None, "clean and short"), (1, "another clean one"), (2, None)} and len(got) == 3


WORDS = [f"word{i}" for i in range(400)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, null and shared ids, and clashing columns."""
    long = " ".join(f"long{i % 997}x{i}" for i in range(150_000))
    rows = [(1, None, None, None, None), (None, None, "en", "a", 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "null id " + " ".join(WORDS[:60]), None, None, None)]
    rows += [(3, long, "en", "a", len(long)), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (4, "same id " + " ".join(WORDS[100:160]), "de", "b", 1), (5, "é" * 300, "fr", "b", 300)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, bands string, position double, seed string, row_key string, kept string"
    return spark.createDataFrame([(*r, 0.5, 7, "b", 0.1, "s", "r", "k") for r in rows], schema).repartition(3)


def test_every_stage_handles_odd_rows(spark, small, odd):
    """Each stage on its own: columns stay, nothing crashes, and rows go for its own reason only."""
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["text"] is None)
    whole = sorted(map(key, odd.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, small)
        assert got.columns == odd.columns, name
        out = [r.asDict() for r in got.collect()]
        assert all((r["score"], r["predicted"], r["bands"], r["position"], r["seed"], r["row_key"], r["kept"]) == (0.5, 7, "b", 0.1, "s", "r", "k") for r in out), name
        if stage is corpus_pipeline.quality_classifier:
            assert set(map(key, out)) <= set(whole)
        elif stage is corpus_pipeline.near_dedup:
            # Only the repeated row with words goes: blank ones have no duplicates.
            assert sorted(map(key, out)) == sorted([*whole[:0], *[k for i, k in enumerate(whole) if k[1] != "one two" or k not in whole[:i]]])
        elif stage is corpus_pipeline.repeated_strings:
            # Only the text that repeats itself for 300 bytes or more is cut.
            assert sorted(map(key, out)) == sorted((i, "" if t.startswith("é") else t, n) for i, t, n in whole)
        else:
            assert sorted(map(key, out)) == whole
    last = corpus_pipeline.STAGES[-1][1](spark, odd, small)
    assert last.columns == ["doc_id", "source", "size", "copy", "position", "text"]
    assert {key(r.asDict()) for r in last.collect()} <= set(whole) and any(r["doc_id"] == 3 for r in last.select("doc_id").collect())


def test_every_stage_takes_an_empty_table(spark, small, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("doc_id < -9"), small).count() == 0, name


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
