"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depthforge.llm import chat_format, components, decontaminate, hash_forest, lang_id, line_dedup, ngram_join, packing, secret_scan, sharding, token_blocks, tokenize

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "mer", "nos") for b in ("ta", "ri", "vel", "sun", "po")]
DOCS = "doc_id bigint, text string, h string, `key` int, row int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, first=0):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(first + i, t, "h", 1, 2) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a null id."""
    rng = random.Random(1)
    data = [(1, None), (2, ""), (3, "   \n\n "), (4, prose(rng, 40)), (4, "again " + prose(rng, 30)), (5, prose(rng, 12_000)), (6, "x"), (6, "x"), (None, prose(rng, 25)), (None, None), (7, "é ñ ß 中文 Привет 😀\0 ok"), (8, "12 34 ++")]
    return spark.createDataFrame([(i, t, "h", 1, 2) for i, t in data], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- chat ------------------------------------------------------------------------------------


def test_chat_paths(spark):
    tree = [("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "a", 0.2), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "user", "b1", 0.9), ("t", 5, 2, "user", "a1", 0.1), ("s", 1, None, "user", None, None), ("s", 2, 9, None, "orphan", 5.0)]
    m = spark.createDataFrame([(*r, 0) for r in tree], "tree string, node int, parent int, role string, text string, score double, up int")
    out = {(r["tree"], r["path_rank"]): (r["leaf"], r["formatted"]) for r in chat_format.format_conversations(m, 2).collect()}
    assert out["t", 1] == (4, "<|im_start|>user\nroot<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nb1<|im_end|>\n")
    assert out["t", 2][0] == 5 and out["s", 1][0] == 2 and out["s", 2][1] == "<|im_start|>user\n<|im_end|>\n"
    assert chat_format.format_conversations(m.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a\nb\n", "", None, "<<||\\", "%3C"]
    roles = ["user", "assistant", "we\nird <|%0A", None]
    data = [(1, i, roles[i % 4], t) for i, t in enumerate(texts)] + [(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)] + [(3, 0, "user", "same"), (3, 0, "user", "same")]
    conv = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.format_conversations(chat_format.linear_messages(conv))
    got = {r["tree"]: ([tuple(t) for t in r["turns"]], "".join(s["text"] for s in r["segments"]) == r["formatted"], [s["text"] for s in r["segments"] if s["loss"]]) for r in out.select("*", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    for c in (1, 2, 3):
        turns = [(r or "", t or "") for k, _, r, t in data if k == c]
        assert got[c][0] == turns and got[c][1]
        assert len(got[c][2]) == sum(r == "assistant" for r, _ in turns)


# --- joins of near copies ----------------------------------------------------------------------


def brute_links(docs, words=5, threshold=0.8):
    sets = {}
    for k, t in docs.items():
        w = (t or "").split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(docs)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]


def groups_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_copies(rng, n, size, change):
    base = prose(rng, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(change):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, block", [(32, 1500), (3, 10)])
def test_join_by_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)] + near_copies(rng, 45, 150, 3) + near_copies(rng, 10, 60, 1) + ["one two", "one two", "solo", "", None]
    texts += texts[:5] * 3
    docs = dict(enumerate(texts))
    links = brute_links(docs)
    count = Counter(x for l in links for x in l)
    got = {r["doc_id"]: r for r in ngram_join.similar_documents(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert {k: r["n_links"] for k, r in got.items()} == {k: count[k] for k in docs}
    assert {k: r["class_id"] for k, r in got.items()} == groups_of(docs, links)


def test_join_on_other_scripts(spark):
    """Words of characters beyond U+3000 are words; the ideographic blank divides them."""
    rng = random.Random(20)
    texts = []
    for alphabet in ("中文書語言日本詞典學", "あいうえおかきくけこ", "가나다라마바사아자차", "😀😃😄😁😆😅🤣😂🙂🙃"):
        word = lambda: "".join(rng.choice(alphabet) for _ in range(3))  # noqa: B023, E731
        base = [word() for _ in range(60)]
        texts += ["\u3000".join(base), " ".join([*base[:-1], word()]), " ".join(word() for _ in range(60)), " ".join(f"the cat {w} sat on a mat" for w in base), " ".join(f"the cat {word()} sat on a mat" for _ in base)]
    docs = dict(enumerate(texts))
    links = brute_links(docs)
    assert links == [(0, 1), (5, 6), (10, 11), (15, 16)]
    got = {r["doc_id"]: r for r in ngram_join.similar_documents(table(spark, texts)).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == groups_of(docs, links) and [got[k]["n_links"] for k in range(20)] == [1, 1, 0, 0, 0] * 4


def test_join_on_repeated_ids(spark):
    """Repeated rows count as links each; rows that share an id but not their text are in classes of their own."""
    rng = random.Random(21)
    a, b = near_copies(rng, 3, 150, 1), near_copies(rng, 3, 150, 1)
    rows = [(5, a[0]), (5, a[0]), (7, a[1]), (5, b[0]), (9, b[1]), (9, a[2]), (3, prose(rng, 90)), (None, a[0])]
    docs = spark.createDataFrame([(i, t, "h", 1, 2) for i, t in rows], DOCS)
    links = brute_links(dict(enumerate(t for _, t in rows[:7])))
    count = Counter(x for link in links for x in link)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_links"], r["class_id"], r["stays"]) for r in ngram_join.similar_documents(docs).collect())
    root = groups_of(range(7), links)
    least = lambda k: min((rows[j][0], j) for j in range(7) if root[j] == root[k])[0]
    assert [x[:4] for x in got] == sorted((False, rows[k][0], count[k], least(k)) for k in range(7)) + [(True, None, 0, None)]
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_first(docs).collect())
    assert kept == Counter([(5, a[0]), (5, a[0]), (5, b[0]), (3, rows[6][1]), (None, a[0])])


def test_join_odd(odd, empty):
    got = ngram_join.similar_documents(odd).collect()
    assert Counter(map(tuple, ngram_join.keep_first(odd).collect())) == Counter(map(tuple, odd.collect()))
    assert len(got) == odd.count() and all((r["class_id"] is None) == (r["doc_id"] is None) for r in got)
    assert sorted(r["n_links"] for r in got if r["doc_id"] == 6) == [1, 1]
    assert ngram_join.similar_documents(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups_of({x for e in edges for x in e}, edges)
    assert got == {k: want[k] for k in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)


def test_pruning_bound():
    steps = ngram_join.least_matches(0.8)
    assert [n for n, _ in steps] == [32, 64, 96, 128] and all(0 < m < 0.8 * n for n, m in steps)


# --- secrets -------------------------------------------------------------------------------------


def test_secrets(spark, odd, empty):
    rng = random.Random(3)
    texts = ['PassWord = "abcdef12"', "token=token:abcdefg secret: abc", "AKIA" + "A1" * 8, "AKIAshort", "x" + "0a" * 12 + " " + "f" * 23, "api-key=aaaaaaaa apikey:'bbbbbbbb'", "é😀 token=zzzzzzz", "gh" + "p_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----"]
    texts += ["eyJ" * 100_000, "eyJ" * 600 + ".eyJa.b", "token" + " " * 300_000, "-----BEGIN " + "A " * 150_000]  # beginnings without an end
    texts.append(" ".join(f"é token={i:0{4 + i % 5}d} {i:024x}" for i in range(3 * secret_scan.GROUP + 7)))  # more than fit in a group
    texts += [prose(rng, 50) + rng.choice(texts[:9]) + prose(rng, 5) for _ in range(40)]
    kinds = {"assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, re.I | re.A), "access": (r"AKIA[A-Z0-9]+", 0, 20, 0), "hex": (r"[0-9a-f]+", 0, 24, 0)}
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), o, k, m.end()) for o, (k, (p, g, n, f)) in enumerate(kinds.items()) for m in re.finditer(p, t, f) if len(m[g]) >= n)
        assert [s for s in got[i] if s[2] in kinds] == want
    assert any(s[2] == "hub" for s in got[7]) and any(s[2] == "pem" for s in got[8])
    assert secret_scan.scan_secrets(odd).count() == odd.count() and secret_scan.scan_secrets(empty).count() == 0


def test_trigram_queries():
    by = {r.kind: secret_scan.trigram_query(r.tree) for r in secret_scan.RULES}
    assert by["access"] == [[["aki", "kia"]]] and by["hex"] == [] and ["ken", "oke", "tok"] in by["assign"][0]
    holds = lambda q, t: all(any(all(g in t.lower() for g in c) for c in clause) for clause in q)
    for rule, text in (("assign", "API_KEY='x'"), ("jwt", "eyJa.eyJb.c"), ("pem", "-----BEGIN PRIVATE KEY-----"), ("chat", "xoxb-1")):
        assert holds(by[rule], text)


# --- lines --------------------------------------------------------------------------------------------


def units_of(text):
    return [u for u in re.split(r"(?<=\n)|(?<=[.!?] )|(?<=[。！？])", text) if u] or [""]


def brute_runs(docs, least):
    """Texts of ``docs`` (doc_id, text) without the units of repeated runs, all runs of all texts compared."""
    bare = {d: [u.replace("\n", "").strip(" ") for u in units_of(t)] for d, t in docs if t is not None}
    size = {d: [max(u.count(" ") + 1, len(u) // 12) for u in us] for d, us in bare.items()}
    places = defaultdict(list)
    for d, us in sorted(bare.items()):
        for i in range(len(us)):
            for j in range(i + 1, len(us) + 1):
                n = size[d][i:j]
                if sum(n) >= least and (sum(n[:-1]) < least or sum(n[1:]) < least):
                    places[tuple(us[i:j])].append((d, i, j))
                if sum(n[1:]) >= least:
                    break
    gone = defaultdict(set)
    for spots in places.values():
        kept, _, end = min(spots)
        for d, i, j in spots:
            if d != kept or i >= end:
                gone[d].update(range(i, j))
    out = {}
    for d, t in docs:
        if t is None or not gone[d]:
            out[d] = t
            continue
        us = units_of(t)
        left = [i for i in range(len(us)) if i not in gone[d]]
        out[d] = "".join(us[i].replace("\n", "").rstrip(" ") if i == left[-1] and i < len(us) - 1 else us[i] for i in left)
    return out


@pytest.mark.parametrize("piece, least", [(64, 50), (4, 12)])
def test_runs_by_brute_force(spark, odd, empty, monkeypatch, piece, least):
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    rng = random.Random(16)
    sentence = lambda: prose(rng, rng.randrange(1, 13)) + rng.choice([".", "!", "?", "\n", "。", "  ."])
    shared = [[sentence() for _ in range(n)] for n in (3, 9, 14, 30)] + [[prose(rng, 60) + "."], [prose(rng, 26) + ".", prose(rng, 24) + "."]]
    texts = []
    for k in range(40):
        own = [sentence() for _ in range(rng.randrange(2, 20))]
        at = rng.randrange(len(own) + 1)
        parts = own[:at] + (shared[k % 6][rng.choice([0, 0, 0, 1]) :] if rng.random() < 0.8 else []) + own[at:]
        texts.append("".join(p + rng.choice([" ", " ", "\n"]) for p in parts).rstrip())
    texts += ["", None, "a.", ("x. " * 120).rstrip(), " ".join(shared[2]) + " \x01 end.", "\x01\n" + " ".join(shared[2]) + "\nnew \x01", "  own. \n" + " ".join(shared[2]), " ".join(shared[2]) + "\n  own. \n", "。".join("中文書語言" * k for k in range(3, 30)), "。".join("中文書語言" * k for k in range(1, 30)), "\n" * 130, "same line\nsame line"]
    docs = table(spark, texts).withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, least).collect()}
    want = brute_runs(list(enumerate(texts)), least)
    assert {k: r["text"] for k, r in got.items()} == want and len(got) == len(texts)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    assert sum(want[k] != t for k, t in enumerate(texts)) > 20
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, odd.collect()))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_of_repeated_ids(spark):
    """Rows of one doc_id with other texts are documents of their own; equal rows are one."""
    rng = random.Random(22)
    passage = " ".join(prose(rng, 9) + "." for _ in range(8))
    rows = [(1, passage), (1, passage), (1, "Own. " + passage), (2, passage + " More."), (None, "Before. " + passage)]
    docs = spark.createDataFrame([(i, t, "h", 1, 2) for i, t in rows], DOCS)
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == Counter([(None, "Before. " + passage), (1, ""), (1, ""), (1, "Own."), (2, "More.")])


def test_chunks_are_few(spark):
    """Where units are long, they are the only chunks; runs are taken near repeated chunks alone."""
    rng = random.Random(23)
    text = " ".join(prose(rng, n) + "." for n in [20, 5] * 40)
    marks = lambda t: spark.createDataFrame([(t,)], "text string").select(line_dedup.chunk_marks(F.col("text")).alias("m")).head()["m"]
    assert sorted(m["at"] for m in marks(text)) == list(range(0, 80, 2))
    short = sorted(m["at"] for m in marks(" ".join(prose(rng, 8) + "." for _ in range(80))))
    assert short[0] <= 2 and short[-1] >= 76 and max(b - a for a, b in zip(short, short[1:])) <= 3 and len(short) < 60
    assert marks("") == marks("One. Two. Three.") == []


def test_long_units(spark):
    """Both ways to count a unit's words, at and around the bounds."""
    units = ["", "a", *(" ".join("x" * n) for n in range(1, 60)), *("é" * n for n in range(1, 260, 3)), *("a  b" * n for n in range(1, 20)), *("中 " * n + "文" * 9 for n in range(1, 40))]
    df = spark.createDataFrame([(u,) for u in units], "u string")
    for least in (1, 2, 3, 4, 12, 50, 51):
        rows = df.select("u", line_dedup.words(F.col("u")).alias("n"), line_dedup.is_long(F.col("u"), least).alias("long")).collect()
        assert all(r["n"] == max(r["u"].count(" ") + 1, len(r["u"]) // 12) and r["long"] == (r["n"] * 3 >= least) for r in rows)


def test_bare_units(spark):
    """Units without their ends are those of the split that keeps them."""
    rng = random.Random(24)
    parts = ["", " ", "  ", "\n", ".", ". ", "! ", "? ", "。", "！", "a", "bc", "文", "4191 a", "x. 41", "é", "\x01"]
    texts = ["", "abc.\n ", "a. \n b", "a.\n. ", "heing. 4191085147143418 Atin", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(600))]
    df = spark.createDataFrame([(u,) for u in texts], "t string").select("t", line_dedup.split_units(F.col("t")).alias("s"), line_dedup.bare_units(F.col("t")).alias("b"))
    for r in df.collect():
        assert "".join(r["s"]) == r["t"] and r["b"] == [u.replace("\n", "").strip(" ") for u in r["s"]] and r["s"] == units_of(r["t"]), r


def test_runs_of(spark):
    """Places, sizes and digests of runs, over more units than are summed at once."""
    rng = random.Random(25)
    units = [prose(rng, rng.choice([1, 2, 9, 20])) + rng.choice(["", "é文"]) for _ in range(70)] + ["", "é" * 700]
    size = [min(max(u.count(" ") + 1, len(u) // 12), 50) for u in units]
    want = {(100 + i, j - i, hashlib.sha256("\n".join(units[i:j]).encode()).hexdigest()) for i in range(60) for j in range(i + 1, 73) if sum(size[i:j]) >= 50 and (sum(size[i : j - 1]) < 50 or sum(size[i + 1 : j]) < 50)}
    row = spark.createDataFrame([(units,)], "u array<string>").select(line_dedup.runs_of(F.col("u"), 50, 60, F.lit(100)).alias("r")).head()
    assert sorted((w["first"], w["n"], bytes(w["body"]).hex()) for w in row["r"]) == sorted(want)


def test_stretches(spark):
    marks = [[0], [9], [2, 9], [2, 10], [0, 1, 2, 40, 47, 60]]
    out = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "i int, m array<int>").select("i", line_dedup.stretches(F.col("m")).alias("s")).collect()
    assert {r["i"]: [tuple(w) for w in r["s"]] for r in out} == {0: [(0, 3)], 1: [(6, 12)], 2: [(0, 12)], 3: [(0, 5), (7, 13)], 4: [(0, 5), (37, 50), (57, 63)]}


def test_stage_removes_passages(spark):
    """Passages of few long lines."""
    import corpus_pipeline

    rng = random.Random(17)
    shared = "\n".join(prose(rng, 60) for _ in range(2))
    texts = [f"{prose(rng, 60)}\n{shared}\n{prose(rng, 60)}" for _ in range(12)]
    out = corpus_pipeline.line_dedup_stage(spark, table(spark, texts), "").collect()
    assert len(out) == 12 and sum(shared in r["text"] for r in out) == 1


# --- tokens ---------------------------------------------------------------------------------------------


def plain_ids(texts, path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or tokenize.default_tokenizer())
    return [np.array([*e.ids, 1], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_encoder():
    texts = ["Don't stop\tme now", "á b\n\n c", " lead", "", "J̌ x ́y", "<|endoftext|> in text", "ΣΑΣ Σ", "x" * 5000, "12.5%%\r\nok"]
    enc = tokenize.WordEncoder(tokenize.default_tokenizer(), max_words=5)
    for _ in range(2):
        ids, bounds = enc.encode(pa.array(texts))
        assert all((ids[bounds[i] : bounds[i + 1]] == x[:-1]).all() and bounds[i + 1] - bounds[i] == len(x) - 1 for i, x in enumerate(plain_ids(texts)))


def test_word_encoder_cuts_after_letters():
    texts = ["Don't, STOP'S (x),,", "", "é,É.×,ŉ,", "T", "̈ T̈, İ, क़, X.", "<|ENDOFTEXT|> a", "on, <|endoftext|>, off", "x\x7fy \x7f z", "a.b,c 'S's ''s", "e", "<|endoftext|>", ""]
    enc = tokenize.WordEncoder(tokenize.default_tokenizer())
    for some in (pa.array(texts), pa.array(texts).slice(3), pa.array([""]), pa.array(["x", *texts]).slice(1, 2)):
        ids, bounds = enc.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [x[:-1].tolist() for x in plain_ids(some.to_pylist())]


def test_word_encoder_work():
    """Words that differ in capitals and punctuation alone are one, and words go to the tokenizer in groups."""

    class Counted:
        texts = 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    enc = tokenize.WordEncoder(tokenize.default_tokenizer())
    tokenizer, enc.tokenizer = enc.tokenizer, Counted()
    words = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(2000)]
    texts = [f"{w} {w.title()}, {w}. {w}%%%" for w in words]
    ids, bounds = enc.encode(pa.array(texts))
    assert all((ids[bounds[i] : bounds[i + 1]] == x[:-1]).all() and bounds[i + 1] - bounds[i] == len(x) - 1 for i, x in enumerate(plain_ids(texts)))
    assert len(enc.slots) == len(words) + 3 and enc.tokenizer.texts <= len(words) // 50


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_block_round_trip(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype("<u4")
    ids[rng.random(n) < 0.05] = 4_294_967_295
    writer = token_blocks.BlockFileWriter(f"file://{tmp_path}/f")
    sizes = np.array([n // 3, n - n // 3])
    writer.add(pa.array([5, None]), ids, sizes)
    assert writer.close() == (2, n)
    file = token_blocks.BlockFileReader(f"file://{tmp_path}/f")
    assert (file.read(0, n) == ids).all() and (file.read(n // 4, n // 2) == ids[n // 4 : n // 2]).all()
    assert file.doc_null.tolist() == [False, True] and (file.doc_sizes == sizes).all()


def test_token_files(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = token_blocks.read_token_files(spark, token_blocks.write_token_files(odd)).collect()
    want = Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, plain_ids([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    order = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert token_blocks.read_token_files(spark, token_blocks.write_token_files(empty)).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randrange(1, capacity + 1) if seed % 2 else rng.choice([1, 2, 3, capacity // 3]) for _ in range(400)]
    histogram, rooms = Counter(lengths), defaultdict(lambda: capacity)
    spans = defaultdict(list)
    placed = Counter()
    for length, rank, n, first, per, offset in packing.best_fit_plan(histogram, capacity).tolist():
        assert rank == placed[length]
        placed[length] += n
        for i in range(n):
            rooms[first + i // per] -= length
            spans[first + i // per].append((offset + i % per * length, length))
    assert placed == histogram and sorted(rooms.values()) == best_fit(lengths, capacity)
    for s in spans.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n


def test_packing(spark, odd, empty):
    out = packing.pack_documents(odd, capacity=512).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = Counter()
    for (d, _), x in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        for p, s in enumerate(range(0, len(x), 512)):
            want[d, p, s, x[s : s + 512].tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 512
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(empty, capacity=0)


# --- vectors ------------------------------------------------------------------------------------------------


def test_forest(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[100:600] = x[7]  # a third of the rows are one vector
    data = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(2000, None, "s"), (2050, [0.0] * 24, "s"), (2100, [float("nan")] * 24, "s"), (2150, [None] * 24, "s"), (2200, [1.0, 2.0], "s"), (2250, [2.0, 4.0], "s"), (None, [1.0] * 24, "s"), (50, x[50].tolist(), "s")]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, segment string")
    out = hash_forest.nearest(df, df.filter("vec_id % 50 = 0"), segment_rows=400, query_rows=9).orderBy("query_id", "rank").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    by = defaultdict(list)
    for r in out:
        by[r["query_id"]].append(r)
    hits = []
    for q in range(0, 1500, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5]
        hits.append(len(set(want.tolist()) & {r["vec_id"] for r in by[q]}) / 5)
        assert [r["rank"] for r in by[q]] == [1, 2, 3, 4, 5] and all(abs(r["score"] - u[q] @ u[r["vec_id"]]) < 1e-9 for r in by[q])
    assert np.mean(hits) >= 0.9 and [r["vec_id"] for r in by[150]] == [7, 100, 101, 102, 103]
    assert [(r["vec_id"], round(r["score"], 9)) for r in by[2200]] == [(2250, 1.0)] and not by[2000] and not by[2050]
    assert hash_forest.nearest(df.limit(0), df.limit(0)).count() == 0


# --- language ---------------------------------------------------------------------------------------------------


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(9)
    bounds = np.array([0, 0, 5, 6, 13])
    score = rng.standard_normal((13, 3)) * 2
    got = lang_id.viterbi(score, bounds, 1.5)

    def total(s, path):
        return sum(s[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    import itertools

    for a, b in zip(bounds, bounds[1:], strict=False):
        best = max(total(score[a:b], p) for p in itertools.product(range(3), repeat=b - a))
        assert abs(total(score[a:b], got[a:b]) - best) < 1e-9


def test_language(spark, odd, empty):
    rng = random.Random(10)
    make = {"aa": lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(n)), "bb": lambda n: " ".join(rng.choice(["zhuk", "vyx", "qorz"]) for _ in range(n)), "ru": lambda n: " ".join(rng.choice(["мир", "дом", "лес"]) for _ in range(n))}
    train = spark.createDataFrame([(make[k](30), k) for k in make for _ in range(30)] + [(None, "aa"), ("x", None)], "text string, lang string")
    model = lang_id.fit(train)
    a, b = make["aa"](20), make["bb"](30)
    docs = table(spark, [a, b, f"{a} {b}", make["ru"](4) + " zhuk", None, "12 !", ""])
    out = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    assert [out[i]["lang_pred"] for i in range(7)] == ["aa", "bb", "bb", "ru", "und", "und", "und"]
    assert [tuple(s) for s in out[2]["spans"]] == [(0, len(a), "aa"), (len(a) + 1, len(a) + 1 + len(b), "bb")]
    assert 0.5 < out[2]["score"] < 0.75 and out[4]["score"] == 0 and out[4]["spans"] == []
    assert lang_id.identify(odd, model).count() == odd.count() and lang_id.identify(empty, model).count() == 0
    none = lang_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(docs, none).collect()} == {"und"}


def test_language_learns_from_distinct_texts(spark):
    """Copies change neither which languages are learnt nor what is counted."""
    rng = random.Random(19)
    distinct = [(prose(rng, 12), lang) for lang in ("aa", "bb") for _ in range(30)] + [(prose(rng, 12), f"one{k}") for k in range(6)]
    copies = [r for k, r in enumerate(distinct) for _ in range(300 if k >= 60 else 200 if k % 15 == 0 else 1)]
    schema = "text string, lang string"
    want = lang_id.fit(spark.createDataFrame(distinct, schema), train_docs=20)
    got = lang_id.fit(spark.createDataFrame(copies, schema), train_docs=20)
    assert got.langs == want.langs == sorted({lang for _, lang in distinct})
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.scripts, want.scripts)


# --- benchmarks -------------------------------------------------------------------------------------------------------


def edit_distance_inside(item, text):
    now = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, now = now, [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
    return min(now)


def test_leaks_by_brute_force(spark, odd, empty):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (14, 20, 30, 45)] + ["tiny q"]
    texts = []
    for k in range(60):
        item = list(items[k % 4])
        for _ in range(rng.choice([0, 1, 3, 8, 14, 25])):
            i = rng.randrange(len(item))
            item[i : i + 1] = rng.choice([[], ["q"], [item[i], "w"]])
        texts.append(prose(rng, rng.randrange(0, 40)) + ".  " + "".join(item).upper() + "!\n" + prose(rng, rng.randrange(0, 40)))
    texts += [prose(rng, 50), "see: Tiny, Q!", "tiny quest"]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ?")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.benchmark_leaks(table(spark, texts), bench).collect()}
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            m = plain(item)
            budget = decontaminate.edit_budget(len(m), decontaminate.Q, decontaminate.EDIT_RATE)
            least = edit_distance_inside(m, plain(t)) if i < 4 else 0 if f" {m} " in f" {plain(t)} " else 1
            assert ((d, i) in got) == (least <= budget), (d, i, least, budget)
            if (d, i) in got:
                r = got[d, i]
                assert r["edits"] == least and edit_distance_inside(m, plain(t[r["start"] : r["end"]])) <= budget
    assert decontaminate.benchmark_leaks(odd, bench).filter("doc_id = 4").count() == 0
    assert decontaminate.benchmark_leaks(empty, bench).count() == 0 == decontaminate.benchmark_leaks(odd, bench.limit(0)).count()
    blocks = decontaminate.benchmark_leaks(table(spark, texts), bench, index_chars=100)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(got)


def test_leaks_cut_at_the_start():
    """Items without their first characters, at the start of each document of a batch."""
    rng = random.Random(18)
    items = [prose(rng, n).strip() for n in (30, 60, 90)]
    index = decontaminate.ItemIndex.build([0, 1, 2], items, decontaminate.Q, decontaminate.EDIT_RATE)
    cases = [(i, k) for i in range(3) for k in range(1, int(index.budget[i]) + 1) if items[i][k] != " "]  # a text's first blank does not count
    assert max(k for _, k in cases) > 20
    rng.shuffle(cases)
    texts = [t for i, k in cases for t in (prose(rng, rng.randrange(1, 30)), items[i][k:] + ". " + prose(rng, 10))]
    found = {(d, i): e for d, i, _, _, e in decontaminate.find_leaks(index, texts)}
    assert set(found) == {(2 * n + 1, i) for n, (i, _) in enumerate(cases)}
    assert all(found[2 * n + 1, i] <= k for n, (i, k) in enumerate(cases))


def test_leaks_of_few_kinds_of_grams(monkeypatch):
    """Items and texts that repeat a few characters: bounded memory, and the leaks of a comparison in one go."""
    rng = random.Random(23)
    items = ["0" * 400, "ab" * 100, "x" * 300 + prose(rng, 10), prose(rng, 30)]
    index = decontaminate.ItemIndex.build([0, 1, 2, 3], items, decontaminate.Q, decontaminate.EDIT_RATE)
    assert index.slack[:3].all() and not index.slack[3]
    cut = lambda t, k: "".join(c for i, c in enumerate(t) if i % k)
    texts = ["0" * 5000, "0" * 395, "0" * 300, cut(items[0], 14), "9" + "0" * 200 + "77" + "0" * 199, "ab" * 99 + "b", prose(rng, 9), "y " + items[2][5:] + ". " + items[3], cut(items[2], 30)]
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if edit_distance_inside(item, t) <= index.budget[i]}
    assert {(d, i) for d, i, *_ in decontaminate.find_leaks(index, texts)} == want and len(want) > 6
    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    assert {(d, i) for d, i, *_ in decontaminate.find_leaks(index, texts)} == want


def test_leaks_in_a_long_run_of_one_character():
    """A text of 2 MB of one character, as much as is scanned at once, against an item of the same stays within 600 MB."""
    import tracemalloc

    index = decontaminate.ItemIndex.build([0], ["0" * 400], decontaminate.Q, decontaminate.EDIT_RATE)
    tracemalloc.start()
    assert [x[:2] for x in decontaminate.find_leaks(index, ["0" * 2_000_000])] == [(0, 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20, peak


# --- shards ---------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd, empty):
    rng = random.Random(12)
    docs = table(spark, ["same"] * 150 + [prose(rng, 20) for _ in range(301)])
    out = sharding.shard_documents(docs, 7, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append((r["slot"], r["doc_id"]))
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(7)) and max(sizes) - min(sizes) <= 1 and all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    again = sharding.shard_documents(docs, 7, bucket_bytes=2000).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shard_documents(odd, 3).count() == odd.count() and sharding.shard_documents(empty, 3).count() == 0
