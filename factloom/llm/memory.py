"""Gives the free memory of a Python worker back to the system.

Workers are kept for later tasks, and allocators keep what a task has freed; beside a JVM that fills its own share, that adds up.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: Bytes of a group, or of the batches of a task so far, from which memory is given back at once; less does not repay the call.
LARGE = 4_000_000

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Return what no object uses any more."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def by_task(run):
    """A function of batches that gives its memory back behind every ``LARGE`` bytes of them, and when its task ends, however it ends."""

    def metered(batches):
        seen = 0
        for b in batches:
            seen += b.nbytes
            yield b
            if seen >= LARGE:  # else the allocator keeps what earlier batches have freed
                release()
                seen = 0

    def freed(batches):
        try:
            yield from run(metered(batches))
        finally:
            release()

    return freed


def by_group(run):
    """A function of a group's key and table that gives its memory back after a large group."""

    def freed(key, table):
        out = run(key, table)
        if table.nbytes >= LARGE:
            release()
        return out

    return freed
