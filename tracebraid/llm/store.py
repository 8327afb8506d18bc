"""Intermediate tables and files in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import shared_dir, spent, written

__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "give_back", "shared_dir", "spent", "written"]

#: Rows of a table that may be broadcast; its rows must be of a few fixed columns.
BROADCAST_ROWS = 500_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def give_back() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
