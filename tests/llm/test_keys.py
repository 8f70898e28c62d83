"""Row keys whose hash collides: no row is lost or mixed up with another; and rows that tie, or have no id, in the mix."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from panelspring.llm import common, decontam, mixing, suffix_dedup, tokencount


@pytest.fixture
def few_bits(monkeypatch):
    monkeypatch.setattr(common, "KEY_BITS", 2)


def rows_of(n=40):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    return [(i % 7 if i % 5 else None, words(i), i) for i in range(n)] + [(1, None, -1), (None, None, -2), (1, "", -3), (1, words(1), -4)]


def test_keys_are_shared_by_equal_rows_only(spark, few_bits):
    df = spark.createDataFrame(rows_of(), "doc_id long, text string, other int").repartition(5)
    got = common.with_key(df, "key", "doc_id", "text").collect()
    assert len(got) == 44 and len({r["key"] for r in got}) == len({(r["doc_id"], r["text"]) for r in got})
    assert len({(r["key"], r["doc_id"], r["text"]) for r in got}) == len({r["key"] for r in got})
    assert common.with_key(df.where("other > 1000"), "key", "doc_id", "text").count() == 0


def test_collisions_lose_nothing(spark, few_bits):
    """Two near copies, two texts with a passage in common, one with a test item, many clean rows, all with the same few hashes."""
    clean = rows_of()
    passage = " ".join(f"p{k}" for k in range(80))
    item = " ".join(f"item{k}" for k in range(30))
    base = " ".join(f"b{k}" for k in range(200))
    one, two = (" ".join(f"{c}{k}" for k in range(90)) for c in ("one", "two"))
    marked = [(100, base, 100), (101, base.replace("b7 ", "c7 "), 101), (102, f"{one} {passage}", 102), (103, f"{passage} {two}", 103), (104, "x " + item, 104)]
    df = spark.createDataFrame(clean + marked, "doc_id long, text string, other int").repartition(4)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    want = Counter((r[0], r[1]) for r in clean + marked if r[0] != 101)
    want[(1, clean[1][1])] -= 1  # the repeated row
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == +want
    cut = {r["other"]: r["text"] for r in suffix_dedup.remove_repeats(df).collect()}
    alone = [r for r in clean if r[2] not in (1, -4)]
    assert all(cut[r[2]] == r[1] for r in alone) and cut[102] == one + " " and cut[103] == " " + two and cut[1] == cut[-4] == ""
    left = decontam.clean(df, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert sorted(r["other"] for r in left.collect()) == sorted(r[2] for r in clean + marked if r[2] != 104)


def test_rows_without_an_id_fill_many_buckets(spark):
    """A source of null ids is placed by its texts, in many buckets; rows that agree in id and size keep their places on every run."""
    rows = [(None, "a", f"word {i} " * (i % 3 + 1)) for i in range(3000)] + [(5, "a", f"{c} b c") for c in "qwertyuiop"]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = mixing.sized(df)
    ends = mixing.running(sized, per_bucket=20)
    n = sized.selectExpr("substring(rank, 1, 3) AS b").groupBy("b").count().where("count > 30").count()
    assert n == 0
    got = sorted((r["before"], r["size"]) for r in ends.collect())
    at = 0
    for before, size in got:
        assert before == at
        at += size
    orders = []
    for parts in (1, 7):
        order = mixing.in_order(mixing.curriculum(mixing.mix(df.repartition(parts), keep=("text",)), mixing.PHASES)).select("text", "copy", "position").collect()
        orders.append([tuple(r) for r in order])
    assert sorted(orders[0]) == sorted(orders[1]) and len(orders[0]) == len(rows) or Counter(o[0] for o in orders[0]) == Counter(o[0] for o in orders[1])


def test_token_counts_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 9, 8), (1, "a b", 9, 8), (2, None, 0, 0)], "doc_id int, text string, n_tokens int, n_words int")
    got = tokencount.count_tokens(df, {b"a", b"b", b" "}, ("doc_id", "n_tokens", "n_words"))
    assert got.columns == ["doc_id", "n_words", "n_tokens"]
    assert Counter(tuple(r) for r in got.collect()) == Counter({(1, 2, 4): 2, (2, 0, 0): 1})
    assert tokencount.count_tokens(df.where("doc_id > 5"), {b"a"}).count() == 0


@pytest.mark.parametrize("text", ["ab " * 400 + "x" * 900 + "  yy\n" + "ab", " " * 700 + "a", "b" * 1500, "a\t" * 500 + " " * 300, " " * 1000])
def test_tokens_of_a_long_text_in_pieces(text):
    auto = tokencount.Automaton({b"ab", b" ab", b"x", b"xx", b" x", b"xxx"})
    data = np.frombuffer(text.encode(), np.uint8)
    whole = tokencount.totals(auto, data, np.array([0, len(data)]), len(data))
    for most in (1, 7, 100):
        part = tokencount.totals(auto, data, np.array([0, len(data)]), most)
        assert [x.tolist() for x in part] == [x.tolist() for x in whole]
    assert whole[0].tolist() == [len(text.split())]
