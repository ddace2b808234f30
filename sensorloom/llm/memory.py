"""Gives memory back to the system: Python workers stay for later tasks and stages, beside the heap of their executor."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa


@functools.cache
def _allocator():
    """The C library, where it can give memory back."""
    try:
        library = ctypes.CDLL(None)
        library.malloc_trim  # noqa: B018
        return library
    except (AttributeError, OSError):
        return None


def release() -> None:
    """Gives back what is free."""
    pa.default_memory_pool().release_unused()
    if _allocator() is not None:
        _allocator().malloc_trim(0)


def trim() -> None:
    """Gives back what a task's arrays held, as the worker lives on."""
    gc.collect()
    release()


def releasing(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` of one group, after which what it held goes back."""

    def held(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return held
