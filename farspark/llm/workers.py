"""Memory of Python workers. They live on from task to task, and a slot may have several of them: what one task has freed
stays with its process, while the next task takes its memory in another one."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def release() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that hands back its memory when it ends."""
    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def releasing_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function over one group that hands back its memory when it ends."""
    @wraps(work)
    def run(table):
        out = work(table)
        release()
        return out

    return run
