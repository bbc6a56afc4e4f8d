"""What the operators share: folders that every executor sees, text columns as byte arrays, fixed character sets."""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.sources.scratch import clear_scratch, scratch_folder, shared_folder, written  # noqa: F401

#: The word and letter classes of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What tasks of a kind keep in a Python worker for the next of that kind: the kind, and how to forget it.
KEPT: dict = {}


@cache
def libc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Freed memory goes back to the system; the allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if libc():
        libc().malloc_trim(0)


def lean(task, kind: str = ""):
    """task of a mapInArrow such that its worker, which lives on, holds nothing afterwards but what this kind of task keeps."""

    def run(batches):
        for other, forget in KEPT.items():
            if other != kind:
                forget()
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % n


def unit_hash(ident: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and a seed, the same in each run (52 bits of an MD5)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column in one byte array, with n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def small_batches(batches, rows: int = 1024):
    """Arrow batches of at most so many rows, so that what a task holds doesn't depend on the session's batch size."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def sized_batches(batches, column: int, size: int, rows: int = 1024):
    """Arrow batches of at most so many rows and about so many bytes in a string or binary column; a longer value stands alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        a = held = 0
        for k, n in enumerate(lengths.tolist()):
            if k > a and (held + n > size or k - a >= rows):
                yield batch.slice(a, k - a)
                a, held = k, 0
            held += n
        if batch.num_rows > a:
            yield batch.slice(a)
