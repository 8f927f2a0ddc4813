"""What a Python worker keeps from task to task.

Workers outlive tasks and serve one operator after another. Each operator that keeps models or
caches in a worker says so when a task begins; what others kept is dropped then, so that their sizes do not add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}
_trim: list = []


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, then the C allocator's where it can be asked."""
    if not _trim:
        _trim.append(getattr(ctypes.CDLL(None), "malloc_trim", None))
    pa.default_memory_pool().release_unused()
    if _trim[0]:
        _trim[0](0)


def only(name: str, clear: Callable[[], None]) -> None:
    """Drop what operators other than ``name`` keep; ``clear`` drops what this one does."""
    others = [n for n in _kept if n != name]
    for other in others:
        _kept.pop(other)()
    if others:
        gc.collect()
    _kept[name] = clear
    # each task begins with what it needs; a worker's last batch must not add to the next ones
    give_back()
