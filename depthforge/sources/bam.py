"""Binary alignments: reader over ``binaryFile`` and writer, both in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cigar import OPS
from ..functions.shipping import ship_package
from . import bgzf

#: Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
CORE = struct.Struct("<iiBBHHHiiii")
SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f", "d": "<d"}
SCHEMA = "file_idx string, rec_idx bigint, qname string, flag int, tid int, chrom string, pos int, mapq int, cigar array<struct<op:string,len:int>>, mtid int, mchrom string, mpos int, isize int, l_qseq int, seq string, qual string, aux map<string,struct<type:string,value:string>>"


def read_dictionary(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs (name, length) and the place of the first record."""
    if data[:4] != b"BAM\1":
        raise ValueError("no binary alignment file")
    (n,) = struct.unpack_from("<i", data, 4)
    text = data[8 : 8 + n].rstrip(b"\0").decode()
    (count,) = struct.unpack_from("<i", data, 8 + n)
    at, contigs = 12 + n, []
    for _ in range(count):
        (size,) = struct.unpack_from("<i", data, at)
        name = data[at + 4 : at + 3 + size].decode()
        (length,) = struct.unpack_from("<i", data, at + 4 + size)
        contigs.append((name, length))
        at += 8 + size
    return text, contigs, at


def _tags(blob: bytes) -> list[tuple[str, dict[str, str]]]:
    at, out = 0, []
    while at + 3 <= len(blob):
        tag, kind = blob[at : at + 2].decode(), chr(blob[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(blob[at]), at + 1
        elif kind in SCALARS:
            value = repr(struct.unpack_from(SCALARS[kind], blob, at)[0])
            at += struct.calcsize(SCALARS[kind])
        elif kind in "ZH":
            end = blob.index(0, at)
            value, at = blob[at:end].decode(), end + 1
        elif kind == "B":
            inner, n = chr(blob[at]), struct.unpack_from("<i", blob, at + 1)[0]
            items = struct.unpack_from("<" + SCALARS[inner][1] * n, blob, at + 5)
            value, at = ",".join([inner, *map(str, items)]), at + 5 + n * struct.calcsize(SCALARS[inner])
        else:
            raise ValueError(f"tag type {kind}")
        out.append((tag, {"type": kind, "value": value}))
    return out


def records(data: bytes, contigs: list[tuple[str, int]], at: int) -> Iterator[dict]:
    name = lambda t: contigs[t][0] if 0 <= t < len(contigs) else None
    i = 0
    while at < len(data):
        if at + 4 > len(data) or at + 4 + (size := struct.unpack_from("<i", data, at)[0]) > len(data):
            raise ValueError("the file is cut off")
        tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, isize = CORE.unpack_from(data, at + 4)
        x = at + 4 + CORE.size
        qname = data[x : x + l_name - 1].decode()
        x += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", data, x)
        x += 4 * n_cigar
        packed = data[x : x + (l_seq + 1) // 2]
        x += len(packed)
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
        qual = data[x : x + l_seq]
        text = "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
        yield {"rec_idx": i, "qname": qname, "flag": flag, "tid": tid, "chrom": name(tid), "pos": pos, "mapq": mapq, "cigar": [{"op": OPS[o & 15], "len": o >> 4} for o in ops], "mtid": mtid, "mchrom": name(mtid), "mpos": mpos, "isize": isize, "l_qseq": l_seq, "seq": seq or "*", "qual": text, "aux": _tags(data[x + l_seq : at + 4 + size])}
        at += 4 + size
        i += 1


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of binary files of any size; files with an index beside them are read in splits. The union of files needs no order."""
    from .bai import read_bam_splits

    return read_bam_splits(spark, path)


def read_bam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines (type, tags, text, line) of a binary file, read from its first blocks."""
    ship_package(spark)
    from .bai import header_text
    from .text import header_lines

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": header_text(file).splitlines() or [""]})

    return header_lines(spark.read.format("binaryFile").load(path).select("path").mapInArrow(texts, "value string"))


def encode_record(r: dict) -> bytes:
    from ..functions.tags import TYPE_SIZES  # noqa: F401  the types that can occur

    name = r["qname"].encode() + b"\0"
    cigar = r["cigar"] or []
    ops = b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in cigar)
    seq = "" if r["seq"] in (None, "*") else r["seq"]
    codes = [max(BASES.find(c), 0) if c != "N" else 15 for c in seq.upper()] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    qual = bytes(255 for _ in seq) if r["qual"] in (None, "*") else bytes(ord(c) - 33 for c in r["qual"])
    span = sum(c["len"] for c in cigar if c["op"] in "MDN=X") or 1
    beg, last = r["pos"], r["pos"] + span - 1
    bin_ = next((first + (beg >> s) for first, s in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)) if beg >> s == last >> s), 0) if beg >= 0 else 4680
    tags = b""
    for tag, v in (r["aux"] or {}).items():
        kind, value = v["type"], v["value"]
        body = value[:1].encode() if kind == "A" else value.encode() + b"\0" if kind in "ZH" else b""
        if kind in SCALARS:
            body = struct.pack(SCALARS[kind], float(value) if kind in "fd" else int(value))
        if kind == "B":
            inner, *items = value.split(",")
            body = inner.encode() + struct.pack("<i", len(items)) + b"".join(struct.pack(SCALARS[inner], float(i) if inner in "fd" else int(i)) for i in items)
        tags += tag.encode() + kind.encode() + body
    core = CORE.pack(r["tid"], r["pos"], len(name), r["mapq"], bin_ & 0xFFFF, len(cigar), r["flag"], len(seq), r["mtid"], r["mpos"], r["isize"])
    body = core + name + ops + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def encode_head(header: str, contigs: list[tuple[str, int]]) -> bytes:
    """What comes before the records."""
    text = header.encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    return head + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


def encode_file(header: str, contigs: list[tuple[str, int]], rows: list[dict]) -> bytes:
    """A whole binary file."""
    return bgzf.compress(encode_head(header, contigs) + b"".join(map(encode_record, rows)))


def write_bam(reads: DataFrame, path: str, header: str, contigs: list[tuple[str, int]]) -> DataFrame:
    """Write a binary file for each partition of ``reads`` below ``path``, a folder all executors share; returns (path, n).

    A task holds a batch of rows and a part of a block; empty partitions write no file.
    """
    spark = reads.sparkSession
    ship_package(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        name = f"{at}/part-{task.partitionId():05d}.bam"
        part, out, n = f"{name}.{task.taskAttemptId()}.tmp", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(at)
                out, held = fs.open_output_stream(part), encode_head(header, contigs)
            held += b"".join(encode_record(dict(r, aux=dict(r["aux"] or []))) for r in batch.to_pylist())
            full = len(held) // bgzf.MOST * bgzf.MOST
            out.write(bgzf.pack(held[:full]))
            held, n = held[full:], n + batch.num_rows
        if out is not None:
            out.write(bgzf.compress(held))
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]})

    return reads.mapInArrow(write, "path string, n bigint")
