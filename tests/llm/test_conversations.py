"""Prefix trie, chat formatting and spelling variants against plain loops, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspring.llm import chat, spelling, trie
from panelspring.llm import queries as Q


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(rows):
    """conv_id -> its turns (role, text), by turn with null first."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        out[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    return out


def plain_trie(convs):
    """(conv_id, depth) -> the other columns, from conv_id -> list of turns (role, text)."""
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = leaves[k] or 1
        saved[k] += (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = lambda k: sha(",".join(str(c) for c in members[k] if len(convs[c]) == len(k)))
    return {(m[0], len(k)): (members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], saved[k], ends(k)) for k, m in members.items()}


def got_trie(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op11(spark, sf):
    own = conversations([r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    assert got_trie(Q.op11_prefix_trie(spark, sf)) == plain_trie(whole)


@pytest.mark.parametrize("seed", range(3))
def test_trie_across_partitions(spark, seed):
    """Many copies and shared beginnings over more partitions than there are distinct conversations in some of them."""
    rng = np.random.default_rng(seed)
    convs = {}
    for c in range(300):
        convs[c] = convs[int(rng.integers(0, c))] if c and rng.random() < 0.4 else [("user", "abc"[i] * 2 + " x" * int(i)) for i in rng.integers(0, 3, int(rng.integers(0, 7)))]
    for c in range(300, 420):
        convs[c] = [("user", "hot"), ("assistant", "copy")]
    rows = [(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    empty = spark.createDataFrame([(c, None) for c, ts in convs.items() if not ts], "conv_id long, turns array<struct<digest:string,words:int>>")
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got_trie(trie.prefix_trie(trie.sequences(turns).unionByName(empty))) == plain_trie(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


def odd_turns(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (1, 0, "user", "a b"), (1, 1, "assistant", long), (2, None, None, None), (2, 0, "user", "a b"), (3, 0, "user", "a b"), (3, 0, "user", "a b"), (3, 1, "tool", "[ROLE] x [TEXT]"),
        (None, 0, "user", "lost"), (4, 5, "user", ""), (5, 0, "user", "[INST] [\\INST] [\\\\/INST] <s> <\\s> \\ [ < [["), (5, 1, "assistant", " </s>\n[/SYS]<"), (6, 0, "assistant", "é\U0001f600"),
        (6, 1, "a [TEXT] b", "x</s>"),
    ]
    return spark.createDataFrame([(*r, "t", 7) for r in rows], "conv_id long, turn long, role string, text string, turns string, depth int")


def test_trie_on_odd_rows(spark):
    """A null turn comes first, null texts are empty, repeated rows are turns, a null conv_id is left out, clashing columns are not read."""
    turns = odd_turns(spark)
    convs = conversations([r.asDict() for r in turns.where("conv_id IS NOT NULL").collect()])
    assert got_trie(trie.prefix_trie(trie.sequences(turns))) == plain_trie(convs)
    assert trie.prefix_trie(trie.sequences(turns.where("conv_id < 0"))).count() == 0


def chat_rows(df, template=chat.INSTRUCT):
    out = chat.chats(df).select("conv_id", "n_turns", "valid", "first_error", chat.formatted(F.col("segments")).alias("formatted"), chat.loss_text(F.col("segments"), template).alias("loss"))
    return {r["conv_id"]: r for r in out.withColumn("back", chat.read_back(F.col("formatted"), template)).collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op12(spark, sf):
    convs = conversations([r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    rows = Q.op12_chat_format(spark, sf).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in rows)


@pytest.mark.parametrize("most", [chat.MOST_TURNS, 3])
def test_chats_read_back(spark, most):
    """Every text comes back whatever it holds; control strings stand in the text as often as the machine wrote them; also where turns are ordered by ranges."""
    turns = odd_turns(spark)
    more = spark.createDataFrame([(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(40)], "conv_id long, turn long, role string, text string")
    turns = turns.select("conv_id", "turn", "role", "text").unionByName(more)
    convs = conversations([r.asDict() for r in turns.collect()])
    got = chat_rows(chat.segments(turns, most=most))
    assert set(got) == set(convs)
    for c, want in convs.items():
        r = got[c]
        assert [(t["role"], t["text"]) for t in r["back"]] == want and r["n_turns"] == len(want)
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count("</s>") == sum(role == "assistant" for role, _ in want) and r["formatted"].count("[INST]") == sum(role == "user" for role, _ in want)
    assert {c: r["first_error"] for c, r in got.items()} == {1: None, 2: 0, 3: 1, None: 0, 4: 0, 5: None, 6: 0, 9: None}
    assert got[1]["formatted"].startswith("<s>[INST] a b [/INST] w0 w1") and got[9]["valid"] and not got[3]["valid"]
    assert chat.segments(turns.where("conv_id < 0")).count() == 0


def test_chat_template_is_declared(spark):
    """Another template: its own marks, moves and loss flags, read back by the same code."""
    t = chat.Template("", (), {"u": chat.Role("<|u|>", "<|end|>"), "a": chat.Role("<|a|>", "<|end|>", True)}, ("<|r|>", "<|n|>", "<|end|>"), {"": ("u",), "u": ("a",), "a": ("a", "u")}, ("a",))
    rows = [(1, 0, "u", "hi <|end|>"), (1, 1, "a", "<|a|>"), (1, 2, "a", "<\\|u|>"), (2, 0, "a", "no"), (3, 0, "u", "unanswered")]
    got = chat_rows(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t)
    assert got[1]["formatted"] == "<|u|>hi <\\|end|><|end|><|a|><\\|a|><|end|><|a|><\\\\|u|><|end|>" and got[1]["loss"] == "<|a|><\\|u|>"
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [(r, x) for c, _, r, x in rows if c == 1]
    assert {c: r["first_error"] for c, r in got.items()} == {1: None, 2: 0, 3: 0}


def plain_variants(counts, factor=5):
    """word -> (form, root, n, n_near, form_n)."""
    by = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            by[w[:k], w[k + 1 :], len(w)].add(w)
    near = {w: {v for k in range(len(w)) for v in by[w[:k], w[k + 1 :], len(w)]} for w in counts}
    for w in counts:
        for k in range(len(w)):
            v = w[:k] + w[k + 1 :]
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w in counts:
        near[w].discard(w)
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (form[w], root[w], n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def got_variants(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13(spark, sf):
    counts = Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{d['doc_id']}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert got_variants(Q.op13_spelling_variants(spark, sf)) == plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


@pytest.mark.parametrize("seed", range(2))
def test_variants_of_few_letters(spark, seed, monkeypatch):
    """Words over few letters: every multiset is crowded, so blocks and repeated letters count."""
    monkeypatch.setattr(spelling, "BLOCK", 3)
    rng = np.random.default_rng(seed)
    counts = {"".join(rng.choice(list("abé"), int(rng.integers(3, 8)))): int(5 ** rng.integers(0, 5)) for _ in range(250)}
    got = spelling.variants(spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, letters string, key long"))
    assert got_variants(got) == plain_variants(counts)


def test_vocabulary_is_not_broadcast(spark, monkeypatch):
    """Signatures are 44 rows for each multiset, whatever Spark estimates, and all tables grow with the vocabulary; the driver must not collect them."""
    plans, write = [], spelling.write_shared
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "write_shared", lambda df, name: (seen(df), write(df, name))[1])
    counts = {"colour": 200, "colours": 30, "colous": 2, "coluor": 1, "valley": 9, "volley": 45}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    seen(got)
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8 and not any("Broadcast" in p for p in plans)
    assert got_variants(got) == plain_variants(counts)


def test_spelling_on_odd_rows(spark, monkeypatch):
    """Nulls, empty texts, repeated rows, runs longer than a piece, characters beside the letters, an empty table."""
    monkeypatch.setattr(spelling, "PIECE", 50)
    long = "x" * 333 + " straße STRASSE " + "y" * 50 + " " + "z" * 49 + " " + "ab" * 60
    rows = [(1, None), (2, ""), (3, "Colour COLOUR colour's colour1colour"), (3, "color-colors ÀÉÎÕÜà"), (None, "colour"), (4, long), (4, long), (5, "\U0001f600colourĀcolour×colour")]
    docs = spark.createDataFrame([(*r, "w", 2) for r in rows], "doc_id long, text string, word string, n int")
    want = Counter()
    for _, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            want[re.sub("[A-Z]", lambda m: m[0].lower(), w)] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, letters=1, count=1).collect()}
    assert got == dict(want)
    assert got_variants(spelling.spelling_variants(docs, letters=6, count=1, factor=2)) == plain_variants({w: n for w, n in want.items() if len(w) >= 6}, 2)
    assert spelling.spelling_variants(docs.where("doc_id < 0")).count() == 0


def test_signatures_meet_at_hamming_two(spark):
    """Every two multisets at distance one or two share a signature, whatever the parts of the alphabet."""
    rng = np.random.default_rng(5)
    words = sorted({"".join(sorted(rng.choice(list("abcdefgh"), int(rng.integers(6, 10))))) for _ in range(200)})
    df = spark.createDataFrame([(w,) for w in words], "letters string")
    got = {(r["a"], r["b"], r["x"], r["y"]) for r in spelling.neighbours(df, spelling.alphabet_parts(df, 4)).collect()}
    want = set()
    for a in words:
        for b in words:
            x, y = Counter(a) - Counter(b), Counter(b) - Counter(a)
            if (sum(x.values()), sum(y.values())) == (0, 1) or ((sum(x.values()), sum(y.values())) == (1, 1) and a < b):
                want.add((a, b, "".join(x), "".join(y)))
    assert got == want
