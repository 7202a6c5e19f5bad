"""Memory of the Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def tidied(run: Callable[[Iterator], Iterator], *drop: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow, such that a worker gives its memory back when a task's rows are done.

    Spark uses workers again, so what one step leaves would add to the next one's: ``drop`` empties tables that outlive a task.
    """

    def rows(batches):
        try:
            yield from run(batches)
        finally:
            for d in drop:
                d()
            give_back()

    return rows


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
