"""Helpers for Arrow batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa

from sparkloom.operators.names import free_names

__all__ = ["byte_values", "free_names", "release_memory"]


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def release_memory() -> None:
    """Give freed memory back to the system: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
