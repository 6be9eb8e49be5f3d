"""Language identification of mixed-language text.

A word's script, by code point ranges, narrows the languages it can be in; a naive Bayes model
over letter trigrams (a letter and its neighbours) scores each word in each of them; Viterbi over
the words, with a penalty for each switch, labels the text in spans of one language each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codes import code_points, letters, lowered
from .common import bound_batches
from .tokenize import text_slices
from .workers import tidy

#: First code points of script ranges (public Unicode blocks) and the scripts; fixed values.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = sorted({s for _, s in RANGES})
_FIRSTS = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
BUCKETS = 1 << 16
#: Labelled documents of each language that the model is fitted on, at most.
TRAIN_DOCS = 2000


def script_of(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FIRSTS, codes, side="right") - 1]


def trigram_buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all letters, and the bucket of each one's trigram; what is no letter counts as a blank."""
    is_letter = letters(codes)
    low = np.where(is_letter, lowered(codes), 0).astype(np.uint32)
    padded = np.concatenate([[0], low, [0]]).astype(np.uint32)
    mixed = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)
    at = np.flatnonzero(is_letter)
    mixed = mixed[at]
    mixed ^= mixed >> np.uint32(15)
    return at, (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # languages x buckets, log probabilities
    scripts: np.ndarray  # scripts x languages, whether the language is written in it
    penalty: float

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, number of letters and scores (a column for each language) of each run of letters."""
        at, bucket = trigram_buckets(codes)
        if not len(at):
            return at, at, np.zeros((0, len(self.langs)), dtype=np.float32)
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        score = np.empty((len(first), len(self.langs)), dtype=np.float32)
        allowed = self.scripts[script_of(codes[at[first]])]
        allowed = allowed | ~allowed.any(axis=1)[:, None]  # a script that no language has narrows nothing
        for k in range(len(self.langs)):
            score[:, k] = np.add.reduceat(self.weights[k][bucket], first)
        score[~allowed] = -1e6
        return at[first], np.diff(np.append(first, len(at))), score


def viterbi(score: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``score`` for many sequences at once; ``bounds`` has where they begin."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    n_labels = score.shape[1]
    best = np.zeros((len(size), n_labels))
    back = np.empty(score.shape, dtype=np.int16)
    labels = np.arange(n_labels, dtype=np.int16)
    for t in range(longest):
        n = active[t]
        now = best[:n]
        lead = now.argmax(axis=1)
        switch = now[np.arange(n), lead] - penalty
        stay = now >= switch[:, None]
        at = start[:n] + t
        back[at] = np.where(stay, labels, lead[:, None])
        best[:n] = np.where(stay, now, switch[:, None]) + score[at]
    state = best.argmax(axis=1) if len(size) else np.empty(0, dtype=np.int64)
    out = np.empty(len(score), dtype=np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


def learns_from(doc_id: Column) -> Column:
    """Whether a document may be learnt from: crc32 of its doc_id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def by_lang(values: dict[str, int]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))[F.col("lang")]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, penalty: float = 8.0) -> LanguageModel:
    """Fit on at most ``train_docs`` distinct texts of each language of ``docs`` (text, lang), those with the least hashes.

    Rows without text or lang are left out, and copies count once. Trigrams are counted where the documents lie; the
    driver gets one count for each language and bucket.
    """
    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    hashed = known.select("lang", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in hashed.distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    # hashes of distinct texts are uniform: twice the wanted share of them holds the least ones, so only these few are ranked
    cuts = {lang: min((1 << 63) - 1, -(1 << 63) + (2 * train_docs << 64) // n) for lang, n in sizes.items()}
    few = (hashed.filter(F.col("h") <= by_lang(cuts)) if cuts else hashed).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    limits = {r["lang"]: r["h"] for r in few.withColumn("rank", rank).filter(F.col("rank") <= train_docs).groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not limits:
        return LanguageModel([], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros((len(SCRIPTS), 0), dtype=bool), penalty)
    langs = sorted(limits)
    sample = known.withColumn("h", F.xxhash64("text")).filter(F.col("h") <= by_lang(limits))
    sample = sample.dropDuplicates(["lang", "h"]).select("text", "lang")  # copies go where they lie, before the shuffle

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                codes, _ = code_points([text])
                at, bucket = trigram_buckets(codes)
                k = langs.index(lang)
                grams[k] += np.bincount(bucket, minlength=BUCKETS)
                scripts[k] += np.bincount(script_of(codes[at]), minlength=len(SCRIPTS))
        both = np.concatenate([grams, scripts], axis=1)
        k, bucket = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(both[k, bucket])], names=["k", "bucket", "n"])

    found = sample.mapInArrow(tidy(count), "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    counts[found["k"], found["bucket"]] = found["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(langs, weights.astype(np.float32), (share > 0.001).T, penalty)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Label every whole text: rows (doc_id, lang_pred, score, spans).

    ``lang_pred`` is the language of most letters and ``score`` their share (0 to 1; ties go to the
    language that sorts first); ``spans`` is an array of (start, end, lang) in code points, from a
    span's first letter to its last word's end. A text that is null or has no letter is ``und`` with
    score 0 and no spans, as is every text if no language was learnt. A row comes back for each
    row of ``docs``, also repeated ones and null doc_ids; other columns are ignored.
    """
    return identify_rows(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score", "spans")


def identify_rows(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """As identify(), with all columns of ``docs``, whatever their names, in the struct ``row``."""
    bound_batches(docs.sparkSession)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    schema = T.StructType([*packed.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])))])
    langs = np.array([*model.langs, "und"], dtype=object)
    n_langs = len(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats, whatever the corpus

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("row").field("text")
            for a, b in _viterbi_slices(texts):
                yield label_part(model, batch.slice(a, b - a))

    def label_part(model: LanguageModel, part: pa.RecordBatch) -> pa.RecordBatch:
        firsts, sizes, scores, of = [], [], [], []
        texts = part.column("row").field("text")
        for a, b in text_slices(texts, 500_000):
            codes, starts = code_points(texts.slice(a, b - a).fill_null("").to_pylist())
            first, size, score = model.words(codes)
            doc = np.searchsorted(starts, first, side="right") - 1
            firsts.append(first - starts[doc])
            of.append(doc + a)
            sizes.append(size)
            scores.append(score)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, dtype=kind)
        first, size, doc = join(firsts, np.int64), join(sizes, np.int64), join(of, np.int64)
        score = np.concatenate(scores) if scores else np.zeros((0, n_langs), dtype=np.float32)
        n = part.num_rows
        if not n_langs:
            first, size, doc, score = first[:0], size[:0], doc[:0], score[:0]
        bounds = np.searchsorted(doc, np.arange(n + 1))
        lab = viterbi(score, bounds, model.penalty) if len(score) else np.empty(0, dtype=np.int16)
        held = np.bincount(doc * max(n_langs, 1) + lab, weights=size, minlength=n * max(n_langs, 1)).reshape(n, -1)
        total = held.sum(axis=1)
        top = np.where(total > 0, held.argmax(axis=1), n_langs)
        share = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0)
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(doc) > 0) | (np.diff(lab) != 0)])) if len(doc) else np.empty(0, dtype=np.int64)
        last = np.append(begin[1:], len(doc))[: len(begin)] - 1
        spans = pa.StructArray.from_arrays([pa.array(first[begin]), pa.array(first[last] + size[last]), pa.array(langs[lab[begin]] if len(begin) else [], type=pa.string())], names=["start", "end", "lang"])
        offsets = pa.array(np.searchsorted(doc[begin], np.arange(n + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(langs[top], type=pa.string()), pa.array(share), pa.ListArray.from_arrays(offsets, spans)], names=["row", "lang_pred", "score", "spans"])

    return packed.mapInArrow(tidy(label), schema)


def _viterbi_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows that are labelled together: many, as the steps of Viterbi are as many as the longest has words."""
    return text_slices(texts, 4_000_000)
