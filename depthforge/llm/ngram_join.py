"""Similarity self-join of documents on word n-grams (Jaccard), with Bayesian pruning of candidates.

Documents with equal n-gram sets are one class, named by its least doc_id. Classes that share a
band of MinHash values are candidates. Candidate pairs compare their MinHash values step by step; a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold falls below a tolerance. The
rest is verified exactly on the n-grams of the whole texts.

No group is expanded into rows of pairs: buckets of up to ``SMALL`` classes give pairs, and the
classes of larger ones are put in families. Verification works on blocks of a family, in which all
pairs go through the same pruning as arrays; a block gives a row for each class, with the number
of documents linked to it and the least class it is connected with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import code_points
from .common import bound_batches, materialize
from .components import connected_components
from .tokenize import text_slices
from .workers import tidy

WORDS = 5
THRESHOLD = 0.8
#: MinHash values of a document; a candidate pair agrees on all values of one of the BANDS.
HASHES, BANDS = 128, 32
#: MinHash values compared in each step, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
SMALL = 32
#: Classes and n-grams in a block of a family, about.
BLOCK_DOCS, BLOCK_GRAMS = 1500, 500_000

_rng = np.random.default_rng(20_011)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_GRAM = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The first code point after the last white space of Unicode (U+3000); fixed value.
_PAST_SPACES = 0x3001
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _spaces() -> np.ndarray:
    """Of the code points up to ``_PAST_SPACES``, which is none, those that divide words."""
    return np.array([chr(i).isspace() or i == 0 for i in range(_PAST_SPACES + 1)])


def gram_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams of each text, sorted in each, and the bounds of the texts.

    Words are what white space divides. A text with fewer than ``words`` words, but one at least, has all of them as its
    one n-gram; a text without words has none.
    """
    codes, starts = code_points([t.replace("\0", "�") for t in texts])
    space = _spaces()[np.minimum(codes, _PAST_SPACES)]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begin):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    size = end - begin
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    inside = codes[np.flatnonzero(~space)].astype(np.uint64) * _POWERS[offset & 0xFFFF]
    word = _mix(np.add.reduceat(inside, np.cumsum(size) - size) + size.astype(np.uint64))
    doc = np.searchsorted(starts, begin, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n_grams = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    first_word = np.cumsum(n_words) - n_words
    of = np.repeat(np.arange(len(texts)), n_grams)
    at = np.repeat(first_word, n_grams) + np.arange(len(of)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    gram = np.zeros(len(of), dtype=np.uint64)
    for i in range(words):
        inside = i < n_words[of]
        gram += np.where(inside, word[np.minimum(at + i, len(word) - 1)], np.uint64(0)) * _GRAM[i]
    gram = _mix(gram)
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.concatenate([[True], (np.diff(of) > 0) | (gram[1:] != gram[:-1])])
    gram, of = gram[new], of[new]
    return gram, np.searchsorted(of, np.arange(len(texts) + 1))


def min_hashes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (uint32) for each set that is not empty; rows of empty sets are 0."""
    out = np.zeros((len(bounds) - 1, HASHES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        h = (grams >> np.uint64(32)).astype(np.uint32)
        first = bounds[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], first)
    return out


@lru_cache(16)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed) of each step.

    With a uniform prior, after m matches of n the similarity is Beta(m + 1, n - m + 1), and the
    probability that it is ``threshold`` or more is that of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out.append((n, m))
                break
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the pairs (rows of ``a`` and ``b``) that no step drops."""
    alive, same, before = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for n, least in least_matches(threshold):
        same = same + (a[alive, before:n] == b[alive, before:n]).sum(axis=1)
        keep = same >= least
        alive, same, before = alive[keep], same[keep], n
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype="<u4")
    return flat.reshape(-1, HASHES)


def family_links(ids: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the linked pairs with i in ``left`` and j in ``right`` and ids in that order."""
    a_out, b_out = [], []
    size = np.array([len(s) for s in sets])
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(rows)), np.arange(len(right)), indexing="ij"))
        once = ids[rows[i]] < ids[right[j]] if left is right else np.ones(len(i), dtype=bool)
        i, j = i[once], j[once]
        keep = surviving(marks[rows[i]], marks[right[j]], threshold) if len(i) <= 4096 else np.concatenate([c + surviving(marks[rows[i[c : c + 65536]]], marks[right[j[c : c + 65536]]], threshold) for c in range(0, len(i), 65536)])
        a_out.append(rows[i[keep]])
        b_out.append(right[j[keep]])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    if not len(a):
        return a, b
    if len(a) <= 64:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    else:
        shared = _shared(sets, a, b)
    linked = shared / (size[a] + size[b] - shared) >= threshold
    return a[linked], b[linked]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common n-grams of many pairs of sets: products of 0/1 matrices, some columns at a time."""
    ua, ia = np.unique(a, return_inverse=True)
    ub, ib = np.unique(b, return_inverse=True)
    every = np.unique(np.concatenate([a, b]))
    grams = np.concatenate([sets[x] for x in every])
    kinds, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1  # only n-grams that two sets have can be common
    row = np.repeat(np.arange(len(every)), [len(sets[x]) for x in every])
    useful = count[column] > 1
    row, column = row[useful], new[column[useful]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    at_a, at_b = np.searchsorted(every, ua), np.searchsorted(every, ub)
    total = np.zeros((len(ua), len(ub)), dtype=np.float32)
    n_columns = int((count > 1).sum())
    for c in range(0, n_columns, 2048):
        s, e = np.searchsorted(column, [c, c + 2048])
        matrix = np.zeros((len(every), 2048), dtype=np.float32)
        matrix[row[s:e], column[s:e] - c] = 1
        total += matrix[at_a] @ matrix[at_b].T
    return total[ia, ib].astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``n`` items, the least id that links connect it with."""
    root = ids.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    return root


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Sign all documents: (doc_id, h, grams, set_a, set_b, mins); the set hashes tell equal n-gram sets, ``h`` is the text's hash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column("text"), 1_000_000):
                part = batch.slice(a, b - a)
                grams, bounds = gram_sets(part.column("text").fill_null("").to_pylist(), words)
                mins = min_hashes(grams, bounds)
                sums = [np.concatenate([[0], np.cumsum(_mix(grams ^ np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64) for salt in (0x1234567, 0x89ABCDEF)]
                set_a, set_b = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                width = 4 * HASHES
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.arange(0, (part.num_rows + 1) * width, width, dtype=np.int32)), pa.py_buffer(mins.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(np.diff(bounds)), pa.array(set_a), pa.array(set_b), data], names=["doc_id", "h", "grams", "set_a", "set_b", "mins"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(tidy(sign), f"doc_id {kind}, h bigint, grams bigint, set_a bigint, set_b bigint, mins binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = _signatures(batch.column("mins")).astype(np.uint64).reshape(-1, BANDS, HASHES // BANDS)
        key = np.zeros(marks.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for i in range(marks.shape[2]):
            key = _mix(key + marks[:, :, i] * _GRAM[i])
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("rep")), BANDS))], names=["band", "rep"])


def similar_documents(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Similarity self-join: a row (doc_id, class_id, rep_id, n_links, text_hash, stays) for each row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is ``threshold`` or
    more. ``rep_id`` is the least doc_id with the same set, ``class_id`` the least one that links
    connect the row with, ``n_links`` the number of other rows linked to it. doc_id may be of any type that sorts.
    ``text_hash`` tells rows apart that share a doc_id, ``stays`` the one document of each class that a
    deduplication keeps: that of the least doc_id, and of the least text hash among its rows.

    A text of fewer words than ``words`` has all of them as its one n-gram. Null texts and texts without
    words are linked to none and are a class each. Rows with a null doc_id get nulls and 0 links, stay,
    and take no part. Rows that share a doc_id are compared by their texts like any others; those with
    equal texts are one document, and each of them counts as a link. Other columns are ignored; an empty
    table gives no rows.
    """
    signed = materialize(classes(docs, words, threshold), "signatures")
    real = signed.filter("grams > 0 and doc_id is not null")
    key = ["grams", "set_a", "set_b"]
    # equal sets have equal MinHash values, and copies are counted before the shuffle, so one row of each class moves from a task
    members = real.groupBy(*key).agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("copies"), F.any_value("mins").alias("mins"))
    # classes are numbered, as two rows with one doc_id may be of two classes
    members = materialize(members.withColumn("rep", F.monotonically_increasing_id()), "classes")
    mine = members.select("rep", "first", "grams", "copies", "mins")
    bands = mine.select("rep", "mins").mapInArrow(_bands, "band bigint, rep bigint")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    crowded = materialize(bands.join(sizes, "band"), "buckets")

    few = crowded.filter(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    few = few.select(F.col("reps")).distinct()  # many bands hold the same few classes
    pairs = few.select(F.posexplode("reps").alias("at", "a"), "reps").select("a", F.explode(F.slice("reps", F.col("at") + 2, SMALL)).alias("b")).distinct()
    sides = mine.select("rep", "mins")
    pairs = pairs.join(sides.select(F.col("rep").alias("a"), F.col("mins").alias("mins_a")), "a").join(sides.select(F.col("rep").alias("b"), F.col("mins").alias("mins_b")), "b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = surviving(_signatures(batch.column("mins_a")), _signatures(batch.column("mins_b")), threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], names=["a", "b"])

    close = pairs.mapInArrow(prune, "a bigint, b bigint")
    large = crowded.filter(F.col("n") > SMALL).select(F.col("rep").alias("a"), F.col("leader").alias("b")).filter("a <> b")
    families = connected_components(close.unionByName(large))
    family = materialize(families.join(mine, families["node"] == mine["rep"]).select("rep", "first.doc_id", "first.h", F.col("component").alias("family"), "grams", "copies", "mins"), "families")
    totals = family.groupBy("family").agg(F.count("*").alias("docs"), F.sum("grams").alias("all_grams"))
    blocks = totals.select("family", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("all_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    whole = totals.agg(F.coalesce(F.sum("all_grams"), F.lit(0))).first()[0]
    units = max(1, -(-whole // BLOCK_GRAMS))

    placed = family.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # one text of each class: rows of one document are put together where they lie
    texts = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text").groupBy("doc_id", "h").agg(F.any_value("text").alias("text"))
    placed = texts.join(placed.hint("merge"), ["doc_id", "h"])
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    # families of one block share units; those of more have a unit for each two blocks
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(units))).otherwise(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")))
    placed = placed.select(unit.alias("unit"), "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "mins", "text")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        ids, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        key = np.stack([table.column(c).to_numpy() for c in ("family", "i", "j")], axis=1)
        marks = _signatures(table.column("mins"))
        sets: list[np.ndarray] = []
        for part in table.select(["text"]).to_batches():
            for a, b in text_slices(part.column(0), 2_000_000):
                grams, bounds = gram_sets(part.column(0).slice(a, b - a).to_pylist(), words)
                sets += np.split(grams, bounds[1:-1])
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        weight, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
        for a, b in zip(first, np.append(first[1:], len(ids)), strict=True):
            every = np.arange(a, b)
            left, right = (every, every) if key[a, 1] == key[a, 2] else (every[block[a:b] == key[a, 1]], every[block[a:b] == key[a, 2]])
            if left is right:
                x, y = family_links(ids, sets, marks, every, every, threshold)
            else:
                x, y = family_links(ids, sets, marks, left, right, threshold) if len(left) and len(right) else (left[:0], left[:0])
            np.add.at(weight, x, copies[y])
            np.add.at(weight, y, copies[x])
            root[a:b] = _roots(b - a, x - a, y - a, ids[a:b])
        return pa.table({"rep": ids, "weight": weight, "root": root})

    checked = materialize(placed.groupBy("unit").applyInArrow(verify, "rep bigint, weight bigint, root bigint"), "links")
    linked = checked.groupBy("rep").agg(F.sum("weight").alias("weight"))
    joined = connected_components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    of_class = members.drop("mins").join(linked, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_class = materialize(of_class, "class-links")
    # the least document of each component; components of one class are their own
    heads = of_class.groupBy("component").agg(F.min("first").alias("head"))
    of_class = of_class.join(heads, "component").select(*key, "first", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "head")
    of_class = materialize(of_class, "classes-found")
    out = signed.drop("mins").join(of_class.hint("merge"), key, "left")
    usable, real = F.col("doc_id").isNotNull(), F.col("head").isNotNull()
    pick = lambda c: F.when(usable, F.when(real, F.col(f"{c}.doc_id")).otherwise(F.col("doc_id")))
    stays = F.coalesce((F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.h") == F.col("h")), F.lit(True))
    return out.select("doc_id", pick("head").alias("class_id"), pick("first").alias("rep_id"), F.when(usable & real, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"), F.col("h").alias("text_hash"), stays.alias("stays"))


def keep_first(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those of classes of near copies whose document is not the class's first.

    All columns stay as they are. A row goes only if its own text is a copy, also if other rows share its
    doc_id. Rows as in ``similar_documents``: null doc_ids, null texts and texts without words stay.
    """
    found = similar_documents(docs, words, threshold)
    gone = found.filter(~F.col("stays")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    gone = materialize(gone, "copies")
    return docs.join(gone.hint("merge"), (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_hash"]), "left_anti")
