"""Python workers serve many tasks; what one task needed should not stay with the worker."""

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and, where the C library can, the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function that gives memory back before it begins, as earlier tasks may have kept some, and when its task is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_series(run: Callable[..., pd.Series]):
    """A function of several series as an iterator function for ``pandas_udf`` that gives memory back as :func:`tidy` does."""

    def wrapped(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        give_back()
        try:
            for columns in batches:
                yield run(*columns)
        finally:
            give_back()

    return wrapped
