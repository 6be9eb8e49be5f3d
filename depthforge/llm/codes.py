"""Texts as arrays of code points, for operators that work on whole batches at once."""

from __future__ import annotations

import numpy as np

_BMP = 1 << 16


def _table(of) -> np.ndarray:
    return np.array([of(chr(i)) for i in range(_BMP)])


class _Tables:
    def __init__(self) -> None:
        lower = lambda c: ord(x) if len(x := c.lower()) == 1 else ord(c)
        self.lower = _table(lower).astype(np.uint32)
        self.letter = _table(str.isalpha)
        self.alnum = _table(str.isalnum)


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    _tables = _tables or _Tables()
    return _tables


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a 0, and the start of each text (one more at the end)."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)])


def _beyond(codes: np.ndarray, out: np.ndarray, of) -> np.ndarray:
    if len(at := np.flatnonzero(codes >= _BMP)):
        kinds, back = np.unique(codes[at], return_inverse=True)
        out[at] = np.array([of(chr(c)) for c in kinds])[back]
    return out


def lowered(codes: np.ndarray) -> np.ndarray:
    out = tables().lower[np.minimum(codes, _BMP - 1)]
    return _beyond(codes, out, lambda c: ord(x) if len(x := c.lower()) == 1 else ord(c))


def letters(codes: np.ndarray) -> np.ndarray:
    return _beyond(codes, tables().letter[np.minimum(codes, _BMP - 1)], str.isalpha)


def alphanumeric(codes: np.ndarray) -> np.ndarray:
    return _beyond(codes, tables().alnum[np.minimum(codes, _BMP - 1)], str.isalnum)
