"""Vectorised text kernels on Arrow string columns.

A column is seen as one array of UTF-8 bytes plus document offsets, so that word splitting,
hashing and counting run over whole blocks of documents. ASCII separators never occur inside
a multi-byte UTF-8 character, which makes the byte view exact for the word rules used here.
Blocks hold whole documents of about BLOCK bytes; a longer document is a block of its own, and
sums over its bytes are taken PIECE bytes at a time, so nothing of eight bytes is kept for each
byte of a text. slices() cuts a long document further where words suffice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Bytes (or words) of one prefix sum.
PIECE = 1 << 20

_byte = np.arange(256)
#: Words are runs of anything but ASCII white space.
NONSPACE = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = (
    ((_byte >= 0x30) & (_byte <= 0x39))
    | ((_byte >= 0x41) & (_byte <= 0x5A))
    | ((_byte >= 0x61) & (_byte <= 0x7A))
    | (_byte >= 0x80)
)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its document offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of consecutive blocks."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs of true; a run ends at its document's end."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    cut = np.zeros(len(inside) + 1, bool)
    cut[offs] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offs, starts, "right") - 1


def _polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start + i] * BASE**i of each span; spans lie within PIECE values."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def _long_polynomial(data: np.ndarray) -> int:
    """The same for one span of any length."""
    out, base = 0, pow(int(_BASE), PIECE, 1 << 64)
    for at in range((len(data) - 1) // PIECE * PIECE, -1, -PIECE):
        part = data[at : at + PIECE].astype(np.uint64) + np.uint64(1)
        out = (out * base + int(_polynomials(part, np.array([0]), np.array([len(part)]))[0])) % (1 << 64)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in rising order: equal spans have equal hashes, wherever they lie."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        if ends[j - 1] - first > PIECE:
            out[i] = _long_polynomial(data[first : ends[i]])
        else:
            out[i:j] = _polynomials(data[first : ends[j - 1]].astype(np.uint64) + np.uint64(1), starts[i:j] - first, ends[i:j] - first)
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = False):
    """Starts, ends, documents and hashes of all words."""
    starts, ends, doc = runs(table[data], offs)
    return starts, ends, doc, span_hashes(LOWER[data] if lower else data, starts, ends)


def grams(hashes: np.ndarray, doc: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose words at the given steps lie in one document, and the hashes of those words in order."""
    n = len(hashes) - steps[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[steps[-1] :])
    out = np.full(len(at), np.uint64(len(steps)), np.uint64)
    for k, s in enumerate(steps):
        out = mix(out * _GRAM[k % len(_GRAM)] + hashes[at + s])
    return at, out


def rolling(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for k consecutive words, in time that does not grow with k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for low in range(0, n, PIECE):
        i, j = np.searchsorted(at, (low, low + PIECE))
        out[i:j] = _polynomials(hashes[low : low + PIECE + k - 1], at[i:j] - low, at[i:j] - low + k)
    return at, mix(out + np.uint64(k))


def slices(data: np.ndarray, table: np.ndarray, overlap: int, limit: int = BLOCK) -> Iterator[np.ndarray]:
    """The bytes of one document in slices of about `limit` whole words; each begins with the last `overlap` words of the one before."""
    at, size = 0, limit
    while True:
        part = data[at : at + size]
        if at + size >= len(data):
            yield part
            return
        starts, ends, _ = runs(table[part], np.array([0, len(part)]))
        whole = len(starts) - (len(ends) > 0 and ends[-1] == len(part))  # the last word may go on
        if whole <= overlap:
            size *= 2  # very long words
            continue
        yield part[: ends[whole - 1]]
        at, size = at + int(starts[whole - overlap] if overlap else ends[whole - 1]), limit


def unique_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value), sorted by both."""
    if not len(doc):
        return doc, value
    if doc.min() == doc.max():
        value = np.unique(value)
        return np.full(len(value), doc[0]), value
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def passthrough(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    """The chosen rows of a batch."""
    return batch.filter(pa.array(rows, pa.bool_()))


_owner: str | None = None
_held: list[Callable[[], None]] = []


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called as a task begins: frees what another operator keeps between its tasks in this worker.

    A worker outlives a stage, so a cache of one stage would stand beside the next one's memory.
    """
    global _owner
    if owner != _owner:
        for free in _held:
            free()
        _held.clear()
        _owner = owner
        trim()
    if release and release not in _held:
        _held.append(release)


def trim() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and its heap would stay at its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing is lost but the memory
