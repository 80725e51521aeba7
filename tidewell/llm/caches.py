"""What a Python worker remembers between tasks, for one operator at a time.

Spark hands tasks of different steps to the same worker processes.  Every operator that
runs in Python begins its tasks here: the caches of others in this process are emptied,
and the memory they had goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 8 << 20
_held: dict[str, Callable[[], None]] = {}
_now: list[str] = []


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """The task is the named operator's; ``clear`` empties its cache when another one's begins."""
    if _now != [name]:
        _now[:] = [name]
        gc.set_threshold(1_000_000, 50, 100)  # operators make millions of small objects, few in cycles
        for other in [k for k in _held if k != name]:
            _held.pop(other)()
        release()
    if clear:
        _held[name] = clear


def release() -> None:
    """Free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python in batches bounded by bytes: texts are of any length, so a number of rows bounds nothing."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
