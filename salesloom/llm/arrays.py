"""Arrow and numpy helpers that work on many texts at once inside a task."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# A task works on about this many text bytes at a time; one longer text is a slice alone.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# Odd multipliers of the words of a shingle, by place.
_PLACE = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F],
    dtype=np.uint64,
)
_powers: dict[int, np.ndarray] = {}
_memories: list[dict] = []


def memory() -> dict:
    """What a worker process remembers between tasks until ``release``."""
    _memories.append({})
    return _memories[-1]


def release() -> None:
    """Let go what earlier stages have left in this process. Tasks that need room call it."""
    for held in _memories:
        held.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, df: DataFrame, *others: str) -> str:
    """``name``, with underscores before it until no column or other name is the same."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sliced(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes, dtype=np.int64) - 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finisher of a splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words start (n + 1 numbers).

    A word is a run of characters other than space and ``\\x09`` to ``\\x0D``;
    a null text has none. ``lower`` turns A to Z into a to z.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    owners = np.repeat(np.arange(len(texts)), counts)[real]
    return flat.filter(pa.array(real)), np.searchsorted(owners, np.arange(len(texts) + 1))


def string_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the n + 1 offsets of its values."""
    if pa.types.is_large_string(values.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=kind)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(at) == 0:
        at = np.zeros(1, dtype=kind)
    return raw[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base``. A table longer than a slice's usual bytes is not kept."""
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= SLICE_BYTES + 1:
            _powers[int(base)] = table
    return table[:n]


def word_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes, from prefix sums."""
    if len(values) == 0:
        return np.zeros(0, dtype=np.uint64)
    raw, at = string_bytes(values)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(raw)), out=sums[1:])
    own = (sums[at[1:]] - sums[at[:-1]]) * _power_table(_INVERSE, len(raw) + 1)[at[:-1]]
    return mix(own ^ (at[1:] - at[:-1]).astype(np.uint64))


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words and where each text's runs start.

    A text with fewer words gives its whole sequence as one run; a text without
    words gives none.
    """
    counts = np.diff(starts)
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(per_text)])
    first = np.arange(begins[-1]) - np.repeat(begins[:-1] - starts[:-1], per_text)
    width = np.repeat(np.minimum(counts, size), per_text)
    total = width.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    short = bool((width < size).any())
    for k in range(size):
        part = padded[first + k] * _PLACE[k]
        total = total + (np.where(width > k, part, np.uint64(0)) if short else part)
    return mix(total), begins
