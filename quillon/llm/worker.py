"""What an operator has learnt in a Python worker is bounded by bytes, and makes room for the next operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

#: Longer words and pieces are worked out each time they are met.
LONGEST_KEPT = 256
#: A dictionary's own bytes for an entry, at its usual load, and the heads of key and value.
ENTRY_BYTES = 200

_HOLDERS: dict[str, Callable[[], None]] = {}


def entry_bytes(key: str | bytes) -> int:
    return ENTRY_BYTES + len(key)


def claim(name: str, forget: Callable[[], None]) -> None:
    """Make ``name`` the only holder of a cache in this worker: workers outlive stages, and their caches would add up."""
    others = [n for n in _HOLDERS if n != name]
    for other in others:
        _HOLDERS.pop(other)()
    if others:
        give_back()
    _HOLDERS[name] = forget


def give_back() -> None:
    """Return freed memory to the machine: neither Python nor Arrow does so by itself."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc
