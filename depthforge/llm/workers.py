"""Memory of Python workers, which Spark keeps alive, and idle, after their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from . import tokenize


def give_back() -> None:
    """Return freed memory to the system; without this, allocators keep it for the life of the process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], drop_words: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for mapInArrow, with memory given back at its end.

    ``drop_words``: first drop the words that tokenizing tasks have left in this process, which count
    against an executor's memory although this task has no use for them.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if drop_words:
            tokenize.drop_encoders()
            give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
