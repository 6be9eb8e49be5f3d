"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hash_forest, lang_id, line_dedup, ngram_join, packing, secret_scan, sharding, token_blocks
from .common import read_table

CHAT_SHARED = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and conversation -1 whose texts imitate the template; digests are read back from the output.

    Rows with a null conv_id are one conversation with a null id.
    """
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CHAT_SHARED), (-1, 1, "assistant", CHAT_SHARED)], "conv_id long, turn long, role string, text string")
    every = rows.unionByName(more).withColumn("conv_id", F.struct("conv_id"))  # a struct is never null, so null ids join
    out = chat_format.format_conversations(chat_format.linear_messages(every))
    turns = out.select(F.col("tree.conv_id").alias("conv_id"), "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape_text(s["text"])).alias("loss"))
    turns = turns.withColumn("loss", F.array_join("loss", ""))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH every AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity self-join of all documents: five words, similarity 0.8 or more."""
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    out = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in base),
        F.sha2(secret_scan.spans_text(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def _op3_sql() -> str:
    kinds = []
    for order, rule in enumerate(secret_scan.RULES):
        regex = rule.regex.replace("'", "''")
        kinds.append(f"""SELECT i, {order} AS ord, '{rule.kind}' AS kind, regexp_split_to_array(text, '{regex}') AS gaps,
  regexp_extract_all(text, '{regex}', 0) AS found, regexp_extract_all(text, '{regex}', {rule.measured}) AS measured, {rule.least} AS least FROM d""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
e AS (SELECT i, ord, kind, least, unnest(list_zip(gaps[1:len(found)], found, measured)) AS x, generate_subscripts(found, 1) AS k FROM m WHERE len(found) > 0),
p AS (SELECT i, ord, kind, k, least, length(x[2]) AS size, length(x[3]) AS measured,
  sum(length(x[1]) + length(x[2])) OVER (PARTITION BY i, ord ORDER BY k) AS stop FROM e),
s AS (SELECT i, ord, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE measured >= least),
g AS (SELECT i, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM s GROUP BY i)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (i)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated runs of lines and sentences."""
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", F.length("text").cast("bigint").alias("clean_chars"))


# all runs of all texts are compared here, without chunks
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
s AS (SELECT r, doc_id, list_filter(regexp_extract_all(text, '(?s).*?(?:\n|[.!?] |[\x{{3002}}\x{{FF01}}\x{{FF1F}}]|$)'), lambda x: x <> '') AS us FROM d WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS i, len(us) AS units FROM s),
v AS (SELECT *, trim(replace(unit, chr(10), '')) AS t FROM u),
w AS (SELECT *, greatest(length(t) - length(replace(t, ' ', '')) + 1, length(t) // 12) AS n FROM v),
p AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM w),
l AS (SELECT r, list(t ORDER BY i) AS ts FROM p GROUP BY r),
q AS (SELECT a.r, a.doc_id, a.i AS f, b.i AS e FROM p a JOIN p b ON a.r = b.r AND b.i >= a.i AND b.i < a.i + {line_dedup.LEAST_WORDS}
  WHERE b.upto - a.upto + a.n >= {line_dedup.LEAST_WORDS} AND (b.upto - b.n - a.upto + a.n < {line_dedup.LEAST_WORDS} OR b.upto - a.upto < {line_dedup.LEAST_WORDS})),
b AS (SELECT q.*, array_to_string(ts[f:e], chr(10)) AS body FROM q JOIN l USING (r)),
k AS (SELECT *, first_value(doc_id) OVER o AS kept_doc, first_value(e) OVER o AS kept_end FROM b WINDOW o AS (PARTITION BY body ORDER BY doc_id NULLS FIRST, f)),
g AS (SELECT DISTINCT r, unnest(range(f, e + 1)) AS i FROM k WHERE doc_id IS DISTINCT FROM kept_doc OR f > kept_end),
z AS (SELECT p.r, p.i, p.unit, p.units, max(p.i) OVER (PARTITION BY p.r) AS last FROM p LEFT JOIN g ON p.r = g.r AND p.i = g.i WHERE g.i IS NULL),
t AS (SELECT r, string_agg(CASE WHEN i = last AND i < units THEN rtrim(replace(unit, chr(10), ''), ' ') ELSE unit END, '' ORDER BY i) AS text FROM z GROUP BY r),
c AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text FROM d LEFT JOIN t USING (r))
SELECT doc_id, text, length(text) AS clean_chars FROM c
"""


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into token block files and read them back."""
    docs = read_table(spark, sf_dir, "documents")
    return token_blocks.read_token_files(spark, token_blocks.write_token_files(docs), docs.schema["doc_id"].dataType.simpleString())


def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all vectors for each vector whose id is divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return hash_forest.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the documents that are not held out.

    A null doc_id is not held out and is not learnt from.
    """
    docs = read_table(spark, sf_dir, "documents")
    out = lang_id.identify(docs, lang_id.fit(docs.filter(lang_id.learns_from(F.col("doc_id")))))
    return out.select("doc_id", F.coalesce(~lang_id.learns_from(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of all documents that are benchmark items up to a few edits."""
    return decontaminate.benchmark_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle all documents into 16 shards and read the shards back."""
    out = sharding.shard_documents(read_table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, from documents to packed sequences."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_ngram_jaccard_join, op3_secret_scan, op4_line_dedup, op5_token_blocks, op6_hash_forest, op7_language_id, op8_benchmark_decontamination, op9_sharding, op10_best_fit_packing, pipeline)
}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op3_secret_scan": _op3_sql(), "op4_line_dedup": OP4_SQL}
