"""Index files of sorted binary alignments: build, read, fetch of a region and reading in splits through the index.

A file's index maps each hierarchical bin to chunks of virtual offsets, each 16 kb window to the
least offset of an alignment that overlaps it, and counts mapped and unmapped records by contig.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import LEVELS, OPEN_END
from ..functions.shipping import ship_package
from . import bam, bgzf

#: Fixed values of the format: the bin that holds counts, and the width of a window of the linear part.
META_BIN, WINDOW_BITS = 37450, 14
REFERENCE_CODES = {0, 2, 3, 7, 8}
SCHEMA = "file_idx string, tid int, kind string, slot bigint, beg bigint, end bigint"


def _bin_of(beg: int, end: int) -> int:
    return next((first + (beg >> shift) for first, shift in LEVELS if beg >> shift == (end - 1) >> shift), 0)


def _bins_near(beg: int, end: int) -> set[int]:
    return {0} | {first + k for first, shift in LEVELS for k in range(beg >> shift, ((end - 1) >> shift) + 1)}


def _spans(data: bytes, at: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(start of the record, its end, tid, pos, reference end, flag) of all records."""
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        stop = at + 4 + size
        if stop > len(data):
            raise ValueError("the file is cut off")
        tid, pos, l_name, _, _, n_cigar, flag, *_ = bam.CORE.unpack_from(data, at + 4)
        ops = struct.unpack_from(f"<{n_cigar}I", data, at + 4 + bam.CORE.size + l_name)
        yield at, stop, tid, pos, pos + (sum(o >> 4 for o in ops if o & 15 in REFERENCE_CODES) or 1), flag
        at = stop


def build(content: bytes) -> bytes:
    """Index of a binary file that is sorted by contig and position; raises ValueError if it is not."""
    offsets, starts, parts, n = [], [], [], 0
    for offset, body in bgzf.blocks(content):
        if body:
            offsets.append(offset)
            starts.append(n)
            parts.append(body)
            n += len(body)
    data, end_block = b"".join(parts), len(content) - len(bgzf.EOF_BLOCK) if bgzf.has_eof(content) else len(content)

    def virtual(at: int) -> int:
        if at >= n:
            return end_block << 16
        block = bisect_right(starts, at) - 1
        return offsets[block] << 16 | at - starts[block]

    _, contigs, first = bam.read_dictionary(data)
    chunks: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
    linear: list[list[int]] = [[] for _ in contigs]
    meta: list[list[int] | None] = [None] * len(contigs)
    before, unplaced = (-1, -1), 0
    for at, stop, tid, pos, end, flag in _spans(data, first):
        beg_v, end_v = virtual(at), virtual(stop)
        if tid < 0 or pos < 0:
            unplaced += tid < 0
            before = (len(contigs), 0) if tid < 0 else before
            continue
        if (tid, pos) < before:
            raise ValueError("the alignments are not sorted")
        before = (tid, pos)
        held = chunks[tid].setdefault(_bin_of(pos, end), [])
        if held and held[-1][1] >> 16 >= beg_v >> 16:
            held[-1][1] = end_v  # chunks that meet in a block are one
        else:
            held.append([beg_v, end_v])
        windows = linear[tid]
        while len(windows) <= (end - 1) >> WINDOW_BITS:
            windows.append(0)
        for w in range(pos >> WINDOW_BITS, ((end - 1) >> WINDOW_BITS) + 1):
            windows[w] = windows[w] or beg_v
        seen = meta[tid] = meta[tid] or [beg_v, end_v, 0, 0]
        seen[1] = end_v
        seen[3 if flag & 4 else 2] += 1
    out = [b"BAI\1", struct.pack("<i", len(contigs))]
    for bins, windows, seen in zip(chunks, linear, meta):
        out.append(struct.pack("<i", len(bins) + (seen is not None)))
        for b, held in sorted(bins.items()):
            out.append(struct.pack("<Ii", b, len(held)) + b"".join(struct.pack("<2Q", *c) for c in held))
        if seen:
            out.append(struct.pack("<Ii4Q", META_BIN, 2, *seen))
        for w in range(1, len(windows)):
            windows[w] = windows[w] or windows[w - 1]
        out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
    return b"".join(out) + struct.pack("<Q", unplaced)


def parse(data: bytes) -> Iterator[tuple[int, str, int, int, int]]:
    """(tid, kind, slot, beg, end): ``chunk`` of a bin, ``window`` (beg only), ``counts`` (mapped, unmapped), ``unplaced`` (beg)."""
    if data[:4] != b"BAI\1":
        raise ValueError("no index of a binary alignment file")
    (n_ref,), at = struct.unpack_from("<i", data, 4), 8
    for tid in range(n_ref):
        (n_bin,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n_bin):
            b, n = struct.unpack_from("<Ii", data, at)
            pairs = list(struct.iter_unpack("<2Q", data[at + 8 : at + 8 + 16 * n]))
            at += 8 + 16 * n
            if b == META_BIN:
                yield tid, "counts", b, *pairs[1]
            else:
                yield from ((tid, "chunk", b, *p) for p in pairs)
        (n,) = struct.unpack_from("<i", data, at)
        yield from ((tid, "window", w, v, v) for w, v in enumerate(struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
    if len(data) >= at + 8:  # the last count is optional
        (n,) = struct.unpack_from("<Q", data, at)
        yield -1, "unplaced", 0, n, 0


def region_chunks(data: bytes, tid: int, beg: int, end: int) -> list[tuple[int, int]]:
    """Disjoint ranges of virtual offsets that hold all alignments which may overlap [beg, end)."""
    end = min(end, OPEN_END)
    if beg >= end:
        return []
    near, rows = _bins_near(beg, end), [r for r in parse(data) if r[0] == tid]
    windows = [r[3] for r in rows if r[1] == "window"]
    if not windows or beg >> WINDOW_BITS >= len(windows):
        return []  # nothing reaches so far
    least, out = windows[beg >> WINDOW_BITS], []
    for a, b in sorted((r[3], r[4]) for r in rows if r[1] == "chunk" and r[2] in near and r[4] > least):
        a = max(a, least)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def write_bai(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Write ``file.bam.bai`` beside each binary file; returns (file_idx, n_bytes). A file is a task."""
    ship_package(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        for batch in batches:
            for row in batch.to_pylist():
                index = build(row["content"])
                fs, at = pyarrow.fs.FileSystem.from_uri(_uri(row["path"]))
                part = f"{at}.bai.{TaskContext.get().taskAttemptId()}.tmp"
                with fs.open_output_stream(part) as out:
                    out.write(index)
                fs.move(part, f"{at}.bai")
                yield pa.RecordBatch.from_pydict({"file_idx": [row["path"]], "n_bytes": [len(index)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path)
    return files.select("path", "content").mapInArrow(write, "file_idx string, n_bytes bigint")


def _uri(path: str) -> str:
    """Spark writes local paths as file:/x; other readers want file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def read_bai(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Contents of index files: (file_idx, tid, kind, slot, beg, end), see ``parse``."""
    ship_package(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_idx", "tid", "kind", "slot", "beg", "end"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["path"], *r) for r in parse(row["content"])]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bai").load(path).select("path", "content").mapInArrow(rows, SCHEMA)


def fetch_region(spark: SparkSession, path: str | list[str], chrom: str, beg: int = 0, end: int = OPEN_END) -> DataFrame:
    """Alignments of indexed binary files that overlap [beg, end) of ``chrom``; only the index, the header and the chunks are read.

    ``file.bam.bai`` or ``file.bai`` must lie beside each file. ``rec_idx`` counts the rows fetched from a file.
    """
    ship_package(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(bam.SCHEMA))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for row in batch.to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(_uri(row["path"]))
                index = _index_of(fs, at)
                if index is None:
                    raise FileNotFoundError(f"{at}.bai")
                with fs.open_input_file(at) as f:
                    contigs, _ = _dictionary(f)
                    tid = next((i for i, c in enumerate(contigs) if c[0] == chrom), -1)
                    held, n = [], 0
                    for first, stop in region_chunks(index, tid, beg, end):
                        for r in bam.records(_between(f, first, stop), contigs, 0):
                            span = sum(c["len"] for c in r["cigar"] if c["op"] in "MDN=X") or 1
                            if r["tid"] == tid and r["pos"] < end and r["pos"] + span > beg:
                                held.append({"file_idx": row["path"], **r, "rec_idx": n})
                                n += 1
                            if len(held) == 10_000:
                                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                                held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path").mapInArrow(fetch, bam.SCHEMA)


def _block(f, at: int) -> tuple[bytes, int]:
    """Content of the block at an offset, and the offset of the next."""
    f.seek(at)
    head = f.read(bgzf.HEAD.size)
    if not head:
        return b"", at
    size = bgzf.block_size(head)
    (_, body), *_ = bgzf.blocks(head + f.read(size - len(head)))
    return body, at + size


def header_text(uri: str) -> str:
    """Header text of a file, from as many of its first blocks as it takes."""
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(_uri(uri))
    with fs.open_input_file(at) as f:
        return _head(f)[0]


def has_end(uri: str) -> bool:
    """Whether a file ends with the block that marks its end; without it, the file may be cut off."""
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(_uri(uri))
    with fs.open_input_file(at) as f:
        size, n = f.size(), len(bgzf.EOF_BLOCK)
        return size >= n and f.read_at(n, size - n) == bgzf.EOF_BLOCK


def _dictionary(f) -> tuple[list[tuple[str, int]], int]:
    """Contigs of an open file and the virtual offset of its first record."""
    return _head(f)[1:]


def _head(f) -> tuple[str, list[tuple[str, int]], int]:
    """Header text and contigs of an open file, from as many of its first blocks as it takes, and the virtual offset of its first record."""
    data, at, places = b"", 0, []
    while True:
        body, after = _block(f, at)
        if body:
            places.append((len(data), at))
        data += body
        try:
            text, contigs, first = bam.read_dictionary(data)
        except (struct.error, IndexError, UnicodeDecodeError):
            if after == at:
                raise
        else:
            if first < len(data):
                start, block = next(p for p in reversed(places) if p[0] <= first)
                return text, contigs, block << 16 | first - start
            if len(data) == first:
                return text, contigs, after << 16
        at = after


def _index_of(fs, at: str) -> bytes | None:
    """Content of ``file.bam.bai`` or ``file.bai``, if one of them is there."""
    import pyarrow.fs

    names = [f"{at}.bai", at.removesuffix(".bam") + ".bai"]
    for name in (i.path for i in fs.get_file_info(names) if i.type == pyarrow.fs.FileType.File):
        with fs.open_input_stream(name) as f:
            return f.read()
    return None


def split_points(index: bytes | None, first: int, split_bytes: int) -> list[int]:
    """Virtual offsets, ``first`` and then starts of records at least ``split_bytes`` of the file apart; only ``first`` without an index."""
    out = [first]
    for at in sorted({r[3] for r in parse(index) if r[1] in ("chunk", "window")} if index else ()):
        if (at >> 16) - (out[-1] >> 16) >= split_bytes:
            out.append(at)
    return out


def _record_parts(f, first: int, stop: int | None, most: int = 1 << 20) -> Iterator[bytes]:
    """Whole records between two virtual offsets (None: to the file's end), in pieces of about ``most`` bytes."""
    held, at = b"", first >> 16
    while stop is None or at < stop >> 16 or at == stop >> 16 and stop & 0xFFFF:
        body, after = _block(f, at)
        if after == at:
            break
        held += body[first & 0xFFFF if at == first >> 16 else 0 : stop & 0xFFFF if stop is not None and at == stop >> 16 else len(body)]
        at = after
        if len(held) >= most:
            end = _last_record(held)
            yield held[:end]
            held = held[end:]
    yield held  # what is cut off here is cut off in the file


def _last_record(data: bytes) -> int:
    """Where the last whole record ends."""
    at = 0
    while at + 4 <= len(data) and (after := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
        at = after
    return at


def read_bam_splits(spark: SparkSession, path: str | list[str], split_bytes: int = 32 << 20) -> DataFrame:
    """Alignments of binary files of any size, with the columns of ``bam.read_bam``.

    A file with an index beside it is read in tasks of about ``split_bytes``, cut where the index says that
    a record starts; one without is one task. Tasks stream: they hold about 1 MB of records. ``rec_idx`` rises along
    a file, with gaps between its splits.
    """
    ship_package(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(bam.SCHEMA))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for file in batch.column("path").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(_uri(file))
                with fs.open_input_file(at) as f:
                    points = split_points(_index_of(fs, at), _dictionary(f)[1], split_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(points)), pa.array(points), pa.array([*points[1:], None], pa.int64())], names=["path", "first", "stop"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for row in batch.to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(_uri(row["path"]))
                with fs.open_input_file(at) as f:
                    contigs, n = _dictionary(f)[0], row["first"]
                    for part in _record_parts(f, row["first"], row["stop"]):
                        held = [{"file_idx": row["path"], **r, "rec_idx": n + r["rec_idx"]} for r in bam.records(part, contigs, 0)]
                        n += len(held)
                        if held:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    # listed without the option's glob, so that a single file may have any name
    files = spark.read.format("binaryFile").load(path).filter(~F.col("path").endswith(".bai")).select("path", "length")
    tasks = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    # a row for each split, dealt in turn: neighbours in a file go to different tasks
    return files.mapInArrow(plan, "path string, first bigint, stop bigint").repartition(int(tasks)).mapInArrow(scan, bam.SCHEMA)


def _between(f, first: int, stop: int) -> bytes:
    """Content between two virtual offsets."""
    out, at = [], first >> 16
    while at < stop >> 16 or at == stop >> 16 and stop & 0xFFFF:
        body, after = _block(f, at)
        if after == at:
            break
        low, high = (first & 0xFFFF if at == first >> 16 else 0), (stop & 0xFFFF if at == stop >> 16 else len(body))
        out.append(body[low:high])
        at = after
    return b"".join(out)
