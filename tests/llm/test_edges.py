"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every text operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspring.llm import decontam, fingerprint, langid, minhash, mixing, quality, suffix_dedup, tokencount, url_filter, warc
from panelspring.llm.common import shared_dir

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
TEXTS = [None, "", "   ", "a", "one two three", "!!! ...", "é" * 300, LONG, LONG, "the cat sat on the mat and the dog sat too", "x\0y z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None, "clash", "r", 1.0) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9], "en", "s", "clash", "r", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_key string, kept string, score double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def test_language(spark, docs, empty):
    model = langid.fit_language_model(docs)
    got = langid.predict_language(docs, model).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert langid.predict_language(docs, model, docs.columns).columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (0, 1, 2, 5)] == ["und"] * 4 and by[9] == "en"
    none = langid.fit_language_model(empty)
    assert {r["lang_pred"] for r in langid.predict_language(docs, none).collect()} == {"und"}
    assert langid.predict_language(empty, model).count() == 0


def test_language_ignores_other_columns(spark):
    rows = [(i, ("der die und das nicht " if i % 2 else "the of and to in ") * (i % 5 + 1), "de" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language_model(df)
    swapped = df.withColumn("lang", F.lit("zz"))
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.predict_language(swapped, model).collect()} == {(i, lang) for i, _, lang in rows}


def test_repeats(spark, docs, empty):
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] is not None}
    assert by[0] is None and by[1] == "" and by[7] == "" and by[8] == "" and by[6] == "" and by[9] == TEXTS[9]
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" * 199), (2, "q" * 200), (3, "ab" * 110)], "doc_id long, text string")
    by = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(twice).collect()}
    assert by == {1: "q" * 199, 2: "q" * 200, 3: ""}


@pytest.mark.parametrize("seed", range(4))
def test_repeats_against_brute_force(spark, seed):
    from test_brute_force import cut

    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list("abcdefgh é"), 900))
    texts = []
    for _ in range(14):
        a, n = int(rng.integers(0, 700)), int(rng.integers(100, 500))
        own = "".join(rng.choice(list("abcdefgh é"), int(rng.integers(0, 400))))
        part = list(base[a : a + n])
        for k in rng.integers(0, max(1, len(part)), int(rng.integers(0, 3))):
            part[k % len(part)] = "#"
        texts.append(own[: len(own) // 2] + "".join(part) + own[len(own) // 2 :] + "zy" * int(rng.integers(0, 150)))
    df = suffix_dedup.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["row_key"]: (r["n_removed"], r["kept"]) for r in suffix_dedup.repeated(df).collect()}
    for r, (n, removed, _, kept) in zip(df.orderBy("doc_id").collect(), cut(texts)):
        assert got.get(r["row_key"], (0, r["text"].encode())) == (removed, kept)


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7?x", "http://example.com/en/8", "http://notcom/en/", "https://a.b.org/es/1#f", "http://x.net/de/8", "ftp://y.example.net/de/8/", "http://z.io/a?b=1&c=2"]
    df = spark.createDataFrame([(i, u, "h", "clash", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls) and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("", "", None) and (got[3]["host"], got[3]["path"]) == ("", "")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert [got[i]["rule"] for i in (5, 6, 7, 8, 9)] == ["com/en/", None, "org/es/", "net/de/", "example.net/de/8"]
    assert url_filter.judge(df.where("page_id = 10")).first()["verdict"] == "allow" and url_filter.judge(df.where("page_id < 0")).count() == 0


def test_urls_that_repeat_and_long_ones(spark):
    rows = [(i % 3, f"http://h{i % 5}.{'com/en' if i % 2 else 'net/de'}/{i}") for i in range(60)] + [(7, "http://z.io/" + "a1/" * 200_000), (8, "http://z.io/x"), (8, "http://z.io/x")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 63 and len({(r["verdict"], r["score"]) for r in got if r["page_id"] == 8}) == 1
    assert max(len(r["path"]) for r in got) == 600_001


def test_url_trees_learn(spark):
    rows = [(i, f"http://{'a' if i % 2 else 'bb-cc'}{i}.{'com/en' if i % 2 else 'net/de'}/{i}") for i in range(400)] + [(1000 + i, f"http://{'a' if i % 2 else 'bb-cc'}{i}.io/{'en' if i % 2 else 'de'}/{i}") for i in range(40)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(40)) > 30


def test_fingerprints(spark, docs, empty):
    got = fingerprint.edited_pairs(docs.select("doc_id", "text", "kept")).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r["doc_id"]: r for r in got}
    assert by[7]["fingerprint"] == by[8]["fingerprint"] and by[8]["near_next"] == 1.0 and by[0]["n_chars"] == 0
    assert fingerprint.edited_pairs(empty.select("doc_id", "text")).count() == 0
    one = fingerprint.edited_pairs(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 7
    assert fingerprint.fingerprint(docs, ("doc_id", "lang")).count() == len(TEXTS) + 1


def test_next_documents_of_repeated_and_null_ids(spark):
    """Ids that fill several ranges are cut further, the order stays, and the driver's part does not grow with the rows."""
    rows = [(7, f"seven {i}") for i in range(120)] + [(None, f"none {i}") for i in range(90)] + [(i, f"own {i}") for i in range(-40, 60)] + [(2**60, "far"), (7, "seven 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    dealt = fingerprint.with_next(df, 8)
    parts = sorted({r["part"] for r in dealt.select("part").distinct().collect()})
    assert 8 < len(parts) < 40 and all(dealt.where(of).select("part").distinct().count() >= 3 for of in ("doc_id = 7", "doc_id IS NULL"))
    by = {}
    for r in dealt.collect():
        by.setdefault(r["part"], []).append((r["doc_id"], r["text"], r["guest"]))
    assert [r[:2] for p in parts for r in by[p] if not r[2]] == order
    for i, p in enumerate(parts):
        assert [r[2] for r in by[p]] == [False] * (len(by[p]) - 1) + [True] and by[p][-1][:2] == by[parts[(i + 1) % len(parts)]][0][:2]
    got = sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in fingerprint.edited_pairs(df).collect())
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        want.append((i or 0, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("text", ["long", "one word", "runs"])
def test_very_long_texts_are_read_in_pieces(monkeypatch, text):
    """Shingles and indicators of a text do not depend on the size of a piece; bytes are cut into pieces that cover each string once."""
    import pyarrow as pa

    from panelspring.llm import common

    rng = np.random.default_rng(3)
    t = {"long": " ".join(f"w{i}" for i in rng.integers(0, 900, 6000)) + " \n é", "one word": "x" * 9000 + " y z " + "ab" * 4000, "runs": "  go " + "very " * 700 + "fast " * 30 + "a " * 23}[text].encode()
    data, ends = np.frombuffer(t, np.uint8), np.array([0, len(t)])
    whole = np.unique(common.shingles(data, ends)[0]), quality.features(data, ends)[0]
    monkeypatch.setattr(common, "CHUNK_BYTES", 500)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 500)
    monkeypatch.setattr(common.word_pieces, "__defaults__", (500, 25))
    if len(t.split()) > 60:
        assert len(list(common.word_pieces(data))) > 3
    cut = np.unique(common.shingles(data, ends)[0]), quality.features(data, ends)[0]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", t.decode(), "cd"])], ["text"])
    starts = [(int(r), int(b) + i) for row, base, d, o in common.pieces(batch, "text", 199, 500) for k, (r, b) in enumerate(zip(row, base)) for i in range(int(o[k + 1] - o[k]) - 199)]
    assert starts == [(1, i) for i in range(len(t) - 199)]


def test_sketch_algebra():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**64, 4000, dtype=np.uint64), rng.integers(0, 2**64, 1000, dtype=np.uint64)
    x, y = fingerprint.sketch(np.concatenate((a, b))), fingerprint.sketch(b)
    assert np.array_equal(fingerprint.merge(fingerprint.sketch(a), y), x)
    assert abs(fingerprint.resemblance(x, y) - 0.2) < 0.1 and fingerprint.containment(y, x) > 0.7 and abs(fingerprint.distinct(x) / 5000 - 1) < 0.25
    assert np.array_equal(fingerprint.from_text(fingerprint.to_text(x)), x) and fingerprint.resemblance(x[:0], x[:0]) == 1.0


def test_warc(spark, tmp_path):
    html = ["<p>é</p>", None, "", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "<p>é</p>", "<p>é</p>", "y" * 3_000_000]
    rows = [(i if i != 4 else None, f"http://h{i}.io/\r\n{i}" if i != 2 else None, h, 1) for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = f"{shared_dir(spark)}/{tmp_path.name}"
    warc.write_archives(df.unionByName(df.where("page_id = 0")), path)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(got) == len(html) + 1
    equal = [r for r in got if r["metadata"]["fields"].get("page-id") == "0"]
    assert sorted(r["response"]["type"] for r in equal) == ["response", "revisit"]
    got = [r for r in got if r not in equal or r["response"]["type"] == "response"]
    by = {r["metadata"]["fields"].get("page-id"): r for r in got}
    assert bytes(by["3"]["response"]["payload"]).decode() == html[3] and bytes(by["6"]["response"]["payload"]).decode() == html[6]
    assert [by[k]["response"]["type"] for k in ("0", "1", "2", "5", None)] == ["response", "response", "revisit", "revisit", "revisit"]
    assert by["5"]["response"]["refers_to"] == by["0"]["capture_id"] and by["5"]["response"]["payload_bytes"] == 9
    none = f"{path}-none"
    warc.write_archives(df.where("page_id < 0"), none)
    assert warc.assemble(warc.read_archives(spark, none)).count() == 0
    big = f"{path}-big"
    warc.write_archives(df, big, least_bytes=100)
    assert {r["response"]["type"] for r in warc.assemble(warc.read_archives(spark, big)).collect()} == {"response"}


def test_warc_of_repeated_rows_and_large_pages(spark, tmp_path, monkeypatch):
    """Each of many equal rows is a capture; files of large pages hold few records."""
    rows = [(1, "http://a.io/x", "same")] * 400 + [(None, None, None)] * 30 + [(2, "http://a.io/y", "same")] + [(10 + i, f"http://b.io/{i}", str(i) * 50_000) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = f"{shared_dir(spark)}/{tmp_path.name}-many"
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 100_000)
    warc.write_archives(df, path)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).select("capture_id", "response.type", "response.refers_to", "response.payload_bytes", F.element_at("metadata.fields", "page-id").alias("page"), F.col("request").isNotNull().alias("asked")).collect()
    assert len(got) == len(rows) and all(r["asked"] for r in got)
    same = [r for r in got if r["page"] in ("1", "2")]
    assert [r["page"] for r in same if r["type"] == "response"] == ["1"] and {r["refers_to"] for r in same if r["type"] == "revisit"} == {r["capture_id"] for r in same if r["type"] == "response"}
    assert sum(r["type"] == "response" for r in got if r["page"] is None) == 1 and sum(r["page"] is None for r in got) == 30
    assert spark.read.format("binaryFile").load(path).count() > 4


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs.select("doc_id", "text", "source", "kept")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] and r["source_size"] >= r["size"]
    total = sum(r["size"] for r in got)
    assert sum({(r["source"], r["target"]) for r in got} and {r["source"]: r["target"] for r in got}.values()) == pytest.approx(total)
    assert mixing.mix(empty).count() == 0
    placed = mixing.in_order(mixing.curriculum(mixing.mix(docs))).collect()
    assert all(0 <= r["position"] <= 1 for r in placed)


def test_curriculum_moves_sources(spark):
    rows = [(i, "a b c d e f g h i j", "early" if i % 2 else "late") for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1, 1))
    got = mixing.curriculum(mixed, ((1.0, (3, 1)), (1.0, (1, 3)))).groupBy("source").agg(F.avg("position").alias("p"), F.count("*").alias("n")).collect()
    by = {r["source"]: r for r in got}
    assert by["early"]["p"] < 0.45 < 0.55 < by["late"]["p"] and by["early"]["n"] == by["late"]["n"] == 200


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # Weights 5, 2, 1, 5: a and null stop at 30 and 0; the other 180 go 2 to 1.
    assert got == {"a": 30.0, "b": 120.0, "c": 60.0, None: 0.0}


def test_decontamination(spark, docs, empty):
    item = " ".join(f"tok{i}" for i in range(30))
    words = item.split()
    changed = [w if i % 5 != 2 else "other" for i, w in enumerate(words)]
    far = [w if i % 2 else "other" for i, w in enumerate(words)]
    rows = [(1, "x y " + item.upper()), (2, " ".join(changed)), (3, " ".join(far)), (4, None), (5, ""), (6, item[:20]), (2, " ".join(changed)), (None, item)]
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, toks string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "short item")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(d, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7]["matched"] == 16 and got[1, 7]["doc_pos"] == 2
    assert sorted(r["doc_id"] or 0 for r in decontam.clean(d, items).collect()) == [3, 4, 5, 6]
    assert decontam.clean(d.withColumn("shifts", F.lit(1)), items).columns == ["doc_id", "text", "toks", "shifts"]
    assert decontam.matches(empty, items).count() == 0 and decontam.matches(docs, items.where("item_id < 0")).count() == 0


def test_masks_find_every_window():
    from itertools import combinations

    n, least = decontam.WINDOW, int(decontam.WINDOW * (1 - decontam.SHARE))
    for bad in combinations(range(n), least):
        assert any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(n - len(m) + 1))


def test_short_items_with_every_substitution(spark):
    """Items of 1 to 15 tokens: found with any quarter of their tokens replaced, not with one more."""
    from itertools import combinations

    items, docs, want = [], [], set()
    for n in (1, 2, 4, 5, 7, 8, 11, 12, 13, 15):
        v = [f"i{n}t{k}" for k in range(n)]
        items.append((n, " ".join(v)))
        bad = n // 4
        for b in (bad, bad + 1):
            for c in list(combinations(range(n), b))[: 10_000 if b == bad else 30]:
                docs.append((len(docs), "pre fix " + " ".join("zz" if j in c else w for j, w in enumerate(v)) + " post"))
                if b == bad:
                    want.add((docs[-1][0], n))
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 800


def test_runs_of_one_token(spark):
    """Long runs of one word meet an item of the same word: linear work, right places."""
    d = spark.createDataFrame([(i, "x " * i + "aa " * 3000) for i in range(12)], "doc_id long, text string")
    got = decontam.matches(d, spark.createDataFrame([(7, "aa " * 200)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["matched"], r["doc_pos"], r["item_pos"]) for r in got} == {(i, 16, i, 0) for i in range(12)}


def test_quality(spark, docs, empty):
    good = [(i, f"the {i} quiet river runs past the old mill and into the sea", 1) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i}!! CLICK!! HERE!! $$$ %%%", 0) for i in range(60)]
    train = spark.createDataFrame(good + bad + [(999, None, 1), (998, "x", None)], "doc_id long, text string, quality int")
    model = quality.fit_quality_model(train, train)
    got = {r["doc_id"]: r for r in quality.score_quality(train, model).collect()}
    assert len(got) == 122 and sum(got[i]["predicted"] == 1 for i in range(60)) > 57 and sum(got[100 + i]["predicted"] == 0 for i in range(60)) > 57
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, model, ("doc_id", "lang")).collect())
    assert quality.score_quality(empty, model, ("doc_id",)).count() == 0
    assert {r["predicted"] for r in quality.score_quality(docs, quality.fit_quality_model(train, train.where("quality = 0")), docs.columns).collect()} == {0}
    assert {r["predicted"] for r in quality.score_quality(docs, quality.fit_quality_model(train, train.where("quality > 5"))).collect()} == {1}
    assert quality.score_quality(docs, model, docs.columns, names=("__s", "__p")).columns == [c for c in docs.columns] + ["__s", "__p"]
    twice = quality.fit_quality_model(train.unionByName(train), train.unionByName(train))
    assert {r["doc_id"]: r["predicted"] for r in quality.score_quality(train, twice).collect()} == {i: r["predicted"] for i, r in got.items()}


def test_hinge_descent_matches_its_dual():
    x = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))]
    w = quality.hinge_dual_descent(x, np.array([1.0, -1.0]), 2, np.array([10.0, 10.0]), 500)
    assert w[0] - w[1] == pytest.approx(2.0, abs=1e-2) and w[0] + w[2] == pytest.approx(1.0, abs=1e-2)


def test_tokens(spark, docs, empty):
    pieces = {b" un", b"aff", b"able", b" unaff", b"abl", b"e"}
    auto = tokencount.Automaton(pieces)
    data = np.frombuffer(b"unaffable", np.uint8)
    assert auto.lengths(data, np.array([0]), np.array([9])).tolist() == [2]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, pieces).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[6] == 601
    assert tokencount.count_tokens(empty, pieces).count() == 0


def test_near_duplicates(spark, docs, empty):
    got = minhash.near_duplicates(docs.select("doc_id", "text", "source")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(TEXTS) + 1 and by[8]["component_id"] == 7 and not by[8]["kept"] and by[9]["kept"]
    assert [by[i]["n_shingles"] for i in (0, 1, 2, 4)] == [0, 0, 0, 1] and by[None]["kept"] and by[None]["component_id"] is None
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_one_family(spark, monkeypatch):
    """A family in which copies are linked through a centre only, and one with chains."""
    from test_brute_force import near

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for k in rng.integers(0, 150, 1 + i % 4):
            w[k] = f"v{i}_{k}"
        docs.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(120)]
    for i in range(30):
        chain[i * 3 : i * 3 + 2] = [f"d{i}a", f"d{i}b"]
        docs.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block, few, percent in ((minhash.BLOCK, minhash.FEW, 85), (7, minhash.FEW, 80), (7, 60, 85)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "FEW_MARGIN", 0.07 if few > 60 else 0.3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, percent).collect()}
        assert got == near(docs, percent)


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.7, 0.85, 0.95):
        n = 1000
        both = int(round(2 * n * j / (1 + j)))
        common = rng.integers(0, 2**63, both, dtype=np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 2**63, n - both, dtype=np.uint64))) for _ in range(2))
        s = minhash.odd_sketches(np.stack([minhash.minhashes(a, 25), minhash.minhashes(b, 25)]))
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        changed = -minhash.SKETCH_BITS / 2 * np.log(1 - 2 * z / minhash.SKETCH_BITS)
        assert abs(1 - changed / (2 * 25 * minhash.ROWS) - j) < 0.12
