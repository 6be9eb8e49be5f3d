"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthforge.llm import decontaminate, lang_id, line_dedup, ngram_join, packing
from depthforge.llm.common import materialize, read_table

#: Documents whose most frequent language has less than this share of their letters are rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language (no letters at all), or of a mix with no main language.

    The predicted language stands in for a missing ``lang``; given labels stay. Where no document has a label, no
    language is known and all documents stay.
    """
    model = lang_id.fit(docs.filter(lang_id.learns_from(F.col("doc_id"))))
    if not model.langs:
        return docs
    kept = lang_id.identify_rows(docs, model)
    label = F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
    kept = kept.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select(*(label if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated runs of lines and sentences; a document that nothing is left of goes."""
    return line_dedup.dedup_lines(docs).filter("text is null or text <> ''")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near copies the document with the least doc_id; a row goes for its own text, not for its doc_id."""
    return ngram_join.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item up to a few edits; a row goes for its own text, not for its doc_id."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of all documents into sequences of at most 4096 tokens."""
    out = packing.pack_documents(docs)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Stages on models, MinHash and token ids have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
