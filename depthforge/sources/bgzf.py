"""Blocked gzip: blocks of at most 64 KiB, each a gzip member with its size in the extra field."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: Fixed values of the format: header with its extra field, and the block that ends a file.
HEAD = struct.Struct("<4BI2BH2BHH")
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 0xFF00


def block_size(data: bytes, at: int = 0) -> int:
    """Whole size of the block at ``at``."""
    a, b, c, d, _, _, _, extra, s1, s2, _, size = HEAD.unpack_from(data, at)
    if (a, b, c) != (31, 139, 8) or not d & 4 or (s1, s2) != (66, 67) or extra < 6:
        raise ValueError("no block of a blocked gzip file")
    return size + 1


def is_bgzf(data: bytes) -> bool:
    try:
        return block_size(data) > 0
    except (struct.error, ValueError):
        return False


def has_eof(data: bytes) -> bool:
    return data.endswith(EOF_BLOCK)


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset of the block, its content) of a file's bytes."""
    at = 0
    while at < len(data):
        size = block_size(data, at)
        body = zlib.decompress(data[at + HEAD.size : at + size - 8], wbits=-15)
        crc, length = struct.unpack_from("<II", data, at + size - 8)
        if len(body) != length or zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        yield at, body
        at += size


def pack(data: bytes, level: int = 6) -> bytes:
    """Blocks of ``data``, without the end block."""
    out = []
    for i in range(0, len(data), MOST):
        part = data[i : i + MOST]
        deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out.append(HEAD.pack(31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + HEAD.size + 8 - 1) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def compress(data: bytes, level: int = 6) -> bytes:
    """Blocks of ``data`` and the end block."""
    return pack(data, level) + EOF_BLOCK


def seek(data: bytes, virtual: int) -> bytes:
    """Content from a virtual offset (block offset << 16 | place in the block) to the file's end."""
    first, inside = virtual >> 16, virtual & 0xFFFF
    return b"".join(body for _, body in blocks(data[first:]))[inside:]
