"""Texts as Arrow batches of bounded size, and as flat byte arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold a few megabytes at most, whatever the length of the texts
    (a single longer text is a batch of its own). Applies to the whole session."""
    for key, bound in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        if int(spark.conf.get(name, "2147483647")) > bound:
            spark.conf.set(name, str(bound))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one entry more than
    texts). Null texts are empty."""
    array = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def groups(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` bytes together; one text at least."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        yield first, last
        first = last


def stamped(texts: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return pc.fill_null(texts, "").to_pylist()


_owner: str | None = None
_kept: dict[Any, Any] = {}


def kept(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What the tasks of one operator share in a worker. It goes as soon as a task of another
    operator runs there, so that what one stage has kept is no burden on the next."""
    only(owner)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def only(owner: str) -> None:
    global _owner
    if owner != _owner:
        _kept.clear()
        _owner = owner


def tidied(owner: str) -> Callable[[Callable], Callable]:
    """For functions over the batches of a task: lets go what other operators have kept in
    the worker, and gives unused memory back to the machine when the task ends, as workers
    go on to other tasks."""

    def decorate(function: Callable) -> Callable:
        @wraps(function)
        def run(batches):
            only(owner)
            try:
                yield from function(batches)
            finally:
                pa.default_memory_pool().release_unused()
                with suppress(OSError, AttributeError):
                    ctypes.CDLL(None).malloc_trim(0)

        return run

    return decorate
