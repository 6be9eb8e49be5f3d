"""The columns that the registered queries return, read through __spark_entry__ on small tables and held against plain code."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from depthforge.llm import lang_id, tokenize

WORDS = {"aa": ["lorem", "ipsum", "dolor", "sitam"], "bb": ["zhuk", "vyx", "qorz", "wux"], "ru": ["мир", "дом", "лес"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(31)
    docs = []
    for i in range(90):
        lang = rng.choice(list(WORDS))
        other = rng.choice(list(WORDS)) if i % 4 == 0 else lang
        text = " ".join([rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 60))] + [rng.choice(WORDS[other]) for _ in range(rng.randrange(1, 40))])
        docs.append((i, text, lang if i % 7 else None))
    docs += [(100, None, "aa"), (101, "", "aa"), (102, "12 34!", "bb"), (103, "a <|endoftext|> b", "aa"), (103, "again", None), (104, "same", "bb"), (104, "same", "bb"), (105, "lorem " * 6000, "aa"), (106, "中文 dolor", None)]
    rows = [(i, t, lang, "s", len(t or ""), 0) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int").write.parquet(f"{at}/documents.parquet")
    noise = np.random.default_rng(5)
    vectors = [(i, noise.standard_normal(12).round(3).tolist()) for i in range(160)]
    vectors[7] = (7, vectors[50][1])
    vectors += [(200, None), (250, [0.0] * 12), (300, [float("nan")] * 12), (350, [None] * 12), (400, [1.0, 2.0])]
    spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id bigint, embedding array<float>, rank int").write.parquet(f"{at}/embeddings.parquet")
    return str(at), docs, vectors


def run(spark, tables, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, tables[0]).collect()]


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokenize.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_op5(spark, tables):
    got = sorted(run(spark, tables, "op5_token_blocks"), key=lambda r: r["start"])
    want = [(d, ids_of(t)) for d, t, _ in tables[1]]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    assert [r["doc_id"] for r in got] == sorted(d for d, _, _ in tables[1])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_op6(spark, tables):
    usable = {i: np.array(v) for i, v in tables[2] if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    got = defaultdict(list)
    for r in sorted(run(spark, tables, "op6_hash_forest"), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in (i for i in usable if i % 50 == 0):
        near = sorted(((-(usable[q] @ v) / np.sqrt((usable[q] @ usable[q]) * (v @ v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])))[:5]
        assert [x[0] for x in got[q]] == list(range(1, len(near) + 1))
        assert all(abs(s - (usable[q] @ usable[i]) / np.sqrt((usable[q] @ usable[q]) * (usable[i] @ usable[i]))) < 1e-6 for _, i, s in got[q])
        hits += len({i for _, i in near} & {x[1] for x in got[q]}) / max(len(near), 1)
    assert {q for q in got if got[q]} == {0, 50, 100, 150} and hits >= 0.9 * 4 and got[50][0][1] == 7


def plain_model(docs):
    """Counts of trigram buckets and scripts, and the log probabilities, text by text and letter by letter."""
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in {(t, k) for d, t, k in docs if t is not None and k is not None and zlib.crc32(str(d).encode()) % 5}:
        counts[lang], scripts[lang]
        for bucket, c in letters_of(text):
            counts[lang][bucket] += 1
            scripts[lang][script(c)] += 1
    langs = sorted(counts)
    weight = {k: lambda b, k=k: np.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * lang_id.BUCKETS)) for k in langs}
    used = {k: {s for s, n in scripts[k].items() if n / sum(scripts[k].values()) > 0.001} for k in langs}
    return langs, weight, used


def script(c):
    return [s for first, s in lang_id.RANGES if first <= ord(c)][-1]


def letters_of(text):
    low = [ord(c.lower()) if c.isalpha() else 0 for c in text]
    for i, c in enumerate(text):
        if c.isalpha():
            a, b, d = low[i - 1] if i else 0, low[i], low[i + 1] if i + 1 < len(low) else 0
            x = (a * 0x9E3779B1 + b * 0x85EBCA77 + d * 0xC2B2AE3D) % (1 << 32)
            x ^= x >> 15
            yield (x * 0x2C1B3C6D) % (1 << 32) >> 16, c


def plain_language(text, langs, weight, used, penalty=8.0):
    words, buckets, inside = [], list(letters_of(text)), 0
    for i, c in enumerate(text):
        if c.isalpha():
            if not i or not text[i - 1].isalpha():
                words.append([])
            words[-1].append(buckets[inside])
            inside += 1
    if not words:
        return "und", 0.0
    best, back = {k: 0.0 for k in langs}, []
    for w in words:
        fits = [k for k in langs if script(w[0][1]) in used[k]] or langs
        score = {k: sum(weight[k](b) for b, _ in w) if k in fits else -1e6 for k in langs}
        lead = max(langs, key=lambda k: best[k])
        came = {k: k if best[k] >= best[lead] - penalty else lead for k in langs}
        best = {k: max(best[k], best[lead] - penalty) + score[k] for k in langs}
        back.append(came)
    state, held = max(langs, key=lambda k: best[k]), Counter()
    for w, came in zip(reversed(words), reversed(back), strict=True):
        held[state] += len(w)
        state = came[state]
    top = max(langs, key=lambda k: held[k])
    return top, held[top] / sum(held.values())


def test_op7(spark, tables):
    model = plain_model(tables[1])
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in run(spark, tables, "op7_language_id"))
    want = Counter()
    for d, t, _ in tables[1]:
        lang, score = plain_language(t or "", *model)
        want[d, zlib.crc32(str(d).encode()) % 5 == 0, lang, round(score, 6)] += 1
    assert got == want and {k[2] for k in got} == {"aa", "bb", "ru", "und"}


def test_op9(spark, tables):
    got = run(spark, tables, "op9_sharding")
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in tables[1])
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op10(spark, tables):
    got = run(spark, tables, "op10_best_fit_packing")
    want, bins = Counter(), []
    for d, t, _ in tables[1]:
        x = ids_of(t)
        want.update((d, k, s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(x), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in held.values():
        assert [a for a, _ in sorted(s)] == np.cumsum([0, *(n for _, n in sorted(s))])[:-1].tolist() and sum(n for _, n in s) <= 4096
    for n in sorted((k[3] for k in want.elements()), reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(4096 - n)
    assert len(held) == len(bins)
