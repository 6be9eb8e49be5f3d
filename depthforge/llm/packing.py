"""Best-fit packing of token sequences.

Best-fit decreasing over whole corpora: documents go by falling length into the open bin with
the least room that still holds them. The choice depends on lengths alone, and lengths are
integers of at most ``capacity``, so the plan is made on the histogram of lengths: a segment
tree over the remaining capacities finds the tightest bin in logarithmic time, and equal
documents are placed as runs. The plan is the very one that a document-by-document best-fit
decreasing would give, its size depends on the capacity and not on the corpus, and documents
find their place in it by their length and their rank among documents of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .tokenize import default_tokenizer, encoder, text_slices
from .workers import tidy

#: Rows of the table of rank offsets up to which it is broadcast (about 24 bytes each); beyond that it is joined by a shuffle.
BROADCAST_ROWS = 400_000


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the bins with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """Least room of at least ``need`` that some bin has."""
        i = self.size + need
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, items, first bin, items per bin, first offset) of the packing.

    Item ``i`` of a run lies in bin ``first bin + i // per`` at ``first offset + (i % per) * length``.
    """
    tree, rooms, runs, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                new = -(-left // (capacity // length))
                put(capacity, bins, new)
                bins += new
                continue
            first, n = rooms[room].pop()
            tree.add(room, -n)
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            elif left:  # less than a bin takes
                runs.append((length, rank, left, first, left, capacity - room))
                put(room - left * length, first, 1)
                full, rank, left = 1, rank + left, 0
            put(room, first + full, n - full)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, block, local_rank): ids are little-endian uint32 bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                ids, bounds = enc.encode(part.column("text").fill_null(""))
                sizes = np.diff(bounds) + 1
                ends = np.cumsum(sizes)
                whole = np.full(int(ends[-1]), end_id, dtype="<u4")
                keep = np.ones(len(whole), dtype=bool)
                keep[ends - 1] = False
                whole[keep] = ids
                n_pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), n_pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                order = np.argsort(length, kind="stable")
                same = length[order]
                first = np.searchsorted(same, same)
                rank = np.empty(len(of), dtype=np.int64)
                rank[order] = seen[same] + np.arange(len(of)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(np.full(len(of), block)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids", "block", "local_rank"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(encode, drop_words=False), f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, block bigint, local_rank bigint")


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens by best-fit decreasing.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces of ``capacity``
    tokens of which the last may be shorter. Returns a row for each piece: doc_id, piece, start,
    length, ids (little-endian uint32), sequence_id, offset; offsets in a sequence have no gaps.

    Null and empty texts are documents of the end id alone. Rows with a null or a repeated
    doc_id are packed like others. Other columns of ``docs`` are ignored, whatever their names;
    an empty table gives no rows. Ties between equal lengths go by the order of rows in the input.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    bound_batches(docs.sparkSession)
    pieces = materialize(token_pieces(docs, capacity, tokenizer or default_tokenizer(), end_id), "pieces")
    counts = materialize(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = best_fit_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), rank.to_numpy()
        run = runs[np.searchsorted(keys, size * (1 << 44) + at, side="right") - 1]
        i = at - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + i // run[:, 4], "offset": run[:, 5] + i % run[:, 4] * size})

    placed = pieces.join(base, ["length", "block"]).withColumn("at", place("length", F.col("base") + F.col("local_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
