"""The pipeline on a small corpus with planted cases, and the registered queries."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from depthforge.llm.queries import ORACLE_SQL, QUERIES


def test_pipeline(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = ["lorem", "ipsum", "dolor", "sitam", "consec", "tetur", "adipis", "elit", "sedeius", "tempor"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "us", "um", "a"]) for _ in range(n))
    item = prose(25)
    clean = [prose(60) for _ in range(40)]
    texts = [*clean, clean[3], clean[4] + " extra", "123 456", None, prose(20) + " " + item + " " + prose(20)]
    docs = spark.createDataFrame([(i, t, "la", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(range(40))
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Repeated and null ids, null, empty and repeated texts and columns with clashing names, through each stage; empty tables; no labels."""
    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sitam", "consec"]) + rng.choice(["", "us", "um", "a"]) for _ in range(n))
    item, base = prose(25), prose(200).split()
    near = " ".join([*base[:100], "other", *base[101:]])
    rows = [(1, " ".join(base), "la"), (1, prose(70), "la"), (1, prose(70), "la"), (2, near, "la"), (2, prose(70), "la"), (3, f"{prose(30)} {item} {prose(30)}", "la"), (3, prose(70), "la"), (4, None, "la"), (4, "", "la"), (5, "12 3", "la"), (6, prose(70), None), (None, prose(70), "la"), (None, f"{item} {prose(30)}", "la")]
    rows += [(6, rows[10][1], None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, `key` int, h string, copy int, pieces string, lang_pred int, _gone int, rep int"
    docs = spark.createDataFrame([(i, t, k, "s", len(t or ""), 1, 2, "h", 3, "p", 4, 5, 6) for i, t, k in rows], schema)
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    language, lines, join, decontaminate, packing = (stage for _, stage in corpus_pipeline.STAGES)
    kept = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    every = Counter((i, t) for i, t, _ in rows)
    assert kept(language(spark, docs, str(tmp_path))) == every - Counter([(4, None), (4, ""), (5, "12 3")])
    assert kept(language(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))) == every
    assert kept(lines(spark, docs, str(tmp_path))) == every - Counter([(4, "")])
    assert kept(join(spark, docs, str(tmp_path))) == every - Counter([(2, near)])
    assert kept(decontaminate(spark, docs, str(tmp_path))) == every - Counter([(i, t) for i, t, _ in rows if t and item in t])
    assert Counter(r["doc_id"] for r in packing(spark, docs, str(tmp_path)).collect()) == Counter(i for i, _, _ in rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (stage is packing or out.columns == docs.columns)


def test_names():
    assert [k for k in QUERIES if k.startswith("op")] == sorted((k for k in QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0])) and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)
