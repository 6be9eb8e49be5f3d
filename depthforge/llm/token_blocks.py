"""Token-id files of patched frame-of-reference blocks.

A file holds one shard of documents in ascending doc_id order:

    magic "PFRB"; blocks; document table; block index; trailer

A block holds ``BLOCK`` ids (the last one fewer). It stores the least id, the width in bits that
``PERCENTILE`` percent of the differences to it fit, the low bits of all differences packed into
64-bit words, and for the others their places and high bits (the exception list). The block
index holds where each block starts, so any range of ids is read without the blocks before it.
All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bound_batches, fresh_path, materialize, shuffle_partitions
from .tokenize import default_tokenizer, encoder, text_slices

#: Bytes of text in a file, about; smaller inputs have as many files as shuffle partitions.
FILE_BYTES = 32 << 20
MAGIC = b"PFRB"
BLOCK = 256
PERCENTILE = 90
#: Block header: least id (u4), width (u1), exceptions (u2), ids (u2).
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("ids", "<u2")])
#: Trailer: documents, ids, blocks, place of the document table, place of the block index.
TRAILER = struct.Struct("<QQQQQ4s")


def pack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Pack each row of ``rows`` (uint64, values below 2**width) into 64-bit words."""
    n, m = rows.shape
    words = np.zeros((-(-m * width // 64), n), dtype=np.uint64)
    for i in range(m if width else 0):
        word, bit = divmod(i * width, 64)
        words[word] |= rows[:, i] << np.uint64(bit)
        if bit + width > 64:
            words[word + 1] |= rows[:, i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T)


def unpack_bits(words: np.ndarray, width: int, m: int) -> np.ndarray:
    """Inverse of pack_bits: ``m`` values for each row of ``words``."""
    out = np.zeros((m, len(words)), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    columns = np.ascontiguousarray(words.T)
    for i in range(m if width else 0):
        word, bit = divmod(i * width, 64)
        value = columns[word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | columns[word + 1] << np.uint64(64 - bit)
        out[i] = value & mask
    return out.T


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids``; every block but the last holds BLOCK ids."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    rest = len(ids) - (n - 1) * BLOCK
    rows = np.pad(ids, (0, n * BLOCK - len(ids)), mode="edge").reshape(n, BLOCK).astype(np.uint64)
    least = rows.min(axis=1)
    rows -= least[:, None]
    bits = np.frexp(rows.astype(np.float64))[1]
    width = np.partition(bits, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        part = rows[at]
        high = part >> np.uint64(w)
        packed = pack_bits(part & np.uint64((1 << int(w)) - 1), int(w))
        for k, i in enumerate(at.tolist()):
            size = rest if i == n - 1 else BLOCK
            places = np.flatnonzero(high[k, :size])
            head = np.array((least[i], w, len(places), size), dtype=HEAD)
            words = packed[k, : -(-size * int(w) // 64)]
            out[i] = b"".join((head.tobytes(), words.tobytes(), places.astype("<u2").tobytes(), high[k, places].astype("<u4").tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts`` in ``data``."""
    if not len(starts):
        return np.empty(0, dtype="<u4")
    raw = np.frombuffer(data, dtype=np.uint8)
    heads = raw[starts[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    sizes = heads["ids"].astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(edges[-1]), dtype="<u4")
    for w, m in {(int(a), int(b)) for a, b in zip(heads["width"], heads["ids"], strict=True)}:
        at = np.flatnonzero((heads["width"] == w) & (heads["ids"] == m))
        n_words = -(-m * w // 64)
        begin = starts[at] + HEAD.itemsize
        words = raw[begin[:, None] + np.arange(n_words * 8)].reshape(-1).view("<u8").reshape(len(at), n_words)
        rows = unpack_bits(words, w, m)
        for k, i in enumerate(at.tolist()):
            if e := int(heads["exceptions"][i]):
                x = int(begin[k]) + n_words * 8
                places = np.frombuffer(data, dtype="<u2", count=e, offset=x)
                rows[k, places] |= np.frombuffer(data, dtype="<u4", count=e, offset=x + 2 * e).astype(np.uint64) << np.uint64(w)
        rows = rows + heads["least"][at].astype(np.uint64)[:, None]
        out[(edges[at][:, None] + np.arange(m)).reshape(-1)] = rows.reshape(-1)
    return out


class BlockFileWriter:
    """Writes one file; the ids of a document are added once, in the order of documents."""

    def __init__(self, uri: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"  # a second attempt of a task has a file of its own
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.ids, self.held, self.n_held = len(MAGIC), 0, [], 0
        self.starts: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.doc_null: list[np.ndarray] = []
        self.doc_sizes: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_null.append(np.asarray(doc_ids.is_null()).astype(np.uint8))
        self.doc_ids.append(np.asarray(doc_ids.fill_null(0)).astype("<i8"))
        self.doc_sizes.append(sizes.astype("<u8"))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 1 << 20:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype="<u4")
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.ids += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.n_held)
        docs = sum(map(len, self.doc_ids))
        table = b"".join(np.concatenate(x).tobytes() if x else b"" for x in (self.doc_null, self.doc_ids, self.doc_sizes))
        self.out.write(table)
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(TRAILER.pack(docs, self.ids, len(self.starts), self.at, self.at + len(table), MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return docs, self.ids


class BlockFileReader:
    """Reads a file, all of it or a range of ids."""

    def __init__(self, uri: str):
        self.fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        end = self.file.size()
        self.docs, self.ids, blocks, table, index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, end - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of token blocks")
        self.starts = np.frombuffer(self.file.read_at(8 * blocks, index), dtype="<u8").astype(np.int64)
        self.stops = np.append(self.starts[1:], table)
        raw = self.file.read_at(index - table, table)
        n = self.docs
        self.doc_null = np.frombuffer(raw, dtype=np.uint8, count=n).astype(bool)
        self.doc_ids = np.frombuffer(raw, dtype="<i8", count=n, offset=n)
        self.doc_sizes = np.frombuffer(raw, dtype="<u8", count=n, offset=9 * n).astype(np.int64)

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids number ``begin`` to ``end`` (exclusive) of the file."""
        if end <= begin:
            return np.empty(0, dtype="<u4")
        a, b = begin // BLOCK, -(-end // BLOCK)
        first = int(self.starts[a])
        data = self.file.read_at(int(self.stops[b - 1]) - first, first)
        return decode_blocks(data, self.starts[a:b] - first)[begin - a * BLOCK : end - a * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of documents (first, last + 1, their ids) of about ``most`` ids."""
        ends = np.cumsum(self.doc_sizes)
        a = 0
        while a < self.docs:
            begin = int(ends[a] - self.doc_sizes[a])
            b = max(a + 1, int(np.searchsorted(ends, begin + most, side="right")))
            yield a, b, self.read(begin, int(ends[b - 1]))
            a = b


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode whole texts and write their ids, each document ended by ``end_id``, in doc_id order.

    doc_id must be an integer. Writes a file for each range of doc_ids below ``path`` (by default in the shared folder) and
    returns the manifest, a row for each file: shard, uri, n_docs, n_ids, first_id (ids in the
    files before it). Files in the order of shards hold the documents in ascending doc_id order,
    null doc_ids first; rows with the same doc_id come in the order of their texts' hashes. Null and
    empty texts have the end id alone. Other columns are ignored; an empty table gives no files.
    A file is written under a name of its attempt and then renamed, so lost and speculative tasks leave whole files.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path, tokenizer = path or fresh_path(spark, "token-blocks"), tokenizer or default_tokenizer()
    if path.startswith("file:"):
        pa.fs.LocalFileSystem().create_dir(pa.fs.FileSystem.from_uri(path)[1])
    else:
        fs, at = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, out = encoder(tokenizer), TaskContext.get().partitionId(), None
        uri = f"{path}/shard-{shard:08d}.pfrb"
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                out = out or BlockFileWriter(uri)
                part = batch.slice(a, b - a)
                ids, bounds = enc.encode(part.column("text").fill_null(""))
                sizes = np.diff(bounds) + 1
                ends = np.cumsum(sizes)
                whole = np.full(int(ends[-1]), end_id, dtype="<u4")
                keep = np.ones(len(whole), dtype=bool)
                keep[ends - 1] = False
                whole[keep] = ids
                out.add(part.column("doc_id").cast(pa.int64()), whole, sizes)
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    tie = F.xxhash64("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(shuffle_partitions(spark), -(-size // FILE_BYTES))
    ranged = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    files = materialize(ranged.mapInArrow(write, "shard long, uri string, n_docs long, n_ids long"), "manifest")
    rows, first = [], 0
    for r in sorted(files.collect()):  # a row for each file
        rows.append((*r, first))
        first += r["n_ids"]
    return spark.createDataFrame(rows, "shard long, uri string, n_docs long, n_ids long, first_id long")


def read_token_files(spark: SparkSession, manifest: DataFrame, doc_type: str = "bigint") -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, start = BlockFileReader(row["uri"]), row["first_id"]
                for a, b, ids in file.documents():
                    sizes = file.doc_sizes[a:b]
                    ends = np.cumsum(sizes)
                    data = memoryview(ids.tobytes())
                    crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[a:b], mask=file.doc_null[a:b]), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    files = manifest.select("uri", "first_id").repartition(max(1, manifest.count()))  # a row for each file, and a task
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn("doc_id", F.col("doc_id").cast(doc_type))
