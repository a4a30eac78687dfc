"""What a Python worker keeps between tasks: one thing at a time.

Workers are used again by the tasks of other operators, so what one operator keeps for its next task must go when another one starts; else the workers of a
pipeline hold the memories of all its stages. That goes for memory that is free, but not yet given back to the system, as well.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

Kept = TypeVar("Kept")
_kept: dict[Hashable, object] = {}


def kept(key: Hashable, build: Callable[[], Kept]) -> Kept:
    """What was built under the key in this worker, built anew if something else was kept since."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]  # type: ignore[return-value]


def release() -> None:
    """Keep nothing, and give what is free back to the system; for tasks that need the room."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
