"""Vectorised access to whole texts: bytes, words and rolling word windows as numpy arrays.

Texts arrive as Arrow columns. They are handled in chunks of about a megabyte, so that a
worker's memory depends on the chunk and on the longest single text, never on the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Chunk:
    """Texts of some consecutive rows: their bytes end to end; text i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = column.buffers()
    if len(column) == 0 or raw[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts, as many as fit into size bytes, one at least."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    trimmed()


def byte_class(inside) -> np.ndarray:
    """256 flags: which bytes belong to a word."""
    return np.fromiter((bool(inside(b)) for b in range(256)), bool, 256)


#: `[^\x20\x09-\x0D]+`: what is not ASCII white space.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and every byte beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of a chunk. start and end are byte positions; words of text i are [offsets[i], offsets[i+1])."""

    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(chunk: Chunk, inside: np.ndarray, lower: bool = False) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    flag = inside[data]
    before = np.empty(len(flag) + 1, bool)
    before[:1] = False
    before[1:] = flag
    edges = chunk.offsets[:-1]
    edges = edges[edges < len(flag)]
    opening = flag & ~before[:-1]
    opening[edges] = flag[edges]
    after = np.empty(len(flag), bool)
    after[:-1] = flag[1:]
    after[-1:] = False
    last = chunk.offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(opening)
    end = np.flatnonzero(flag & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets), data)


#: Longer words are hashed one by one.
_LONG = 512
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: its length, then its bytes, eight at a time, each mixed into what came before.

    Words of up to eight bytes and one length never share a hash; no structure of a text makes longer ones do.
    """
    size = w.end - w.start
    out = mix64(size.astype(U64))
    raw = np.empty(len(w.data) + 8, np.uint8)
    raw[:-8] = w.data
    raw[-8:] = 0
    eight = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(w.data) + 1,), (1,))
    live = np.flatnonzero(size <= _LONG)
    done = 0
    while len(live):
        part = eight[w.start[live] + done] & _FIRST[np.minimum(size[live] - done, 8)]
        out[live] = mix64(out[live] ^ part) + U64(0x9E3779B97F4A7C15)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(w.data[w.start[i] : w.end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    c = a * U64(0xD6E8FEB86659FD93)
    c ^= c >> U64(32)
    c += b
    c *= U64(0xA0761D6478BD642F)
    c ^= c >> U64(29)
    return c


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive codes, text boundaries ignored; len(codes) - n + 1 of them.

    Runs of 1, 2, 4, ... codes are joined pair by pair, then those that n consists of: no sums, so no patterns that cancel.
    """
    m = len(codes)
    if m < n or not n:
        return np.empty(0, U64)
    part, wide, out, used = codes, 1, None, 0
    while True:
        if n & wide:
            out = part if out is None else joined(out[: m - used - wide + 1], part[used : m - wide + 1])
            used += wide
        if used == n:
            return mix64(out[: m - n + 1])
        part = joined(part[:-wide], part[wide:])
        wide *= 2


def gram_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Flags of the word positions at which n words of one text start; as many as gram_hashes gives."""
    m = int(offsets[-1])
    ok = np.ones(max(0, m - n + 1), bool)
    for back in range(1, n):
        stop = offsets[1:] - back
        stop = stop[(stop >= 0) & (stop < len(ok))]
        ok[stop] = False
    return ok


def owners(offsets: np.ndarray) -> np.ndarray:
    """For every word (or byte) the index of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def covered(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions below size that lie in one of [start, start + length)."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def trimmed() -> None:
    """Gives freed memory of numpy and Arrow back: workers live on for the next stage."""
    libc_trim()(0)
    pa.default_memory_pool().release_unused()


@lru_cache(maxsize=1)
def libc_trim():
    """glibc's malloc_trim, where there is one: gives freed pages back between groups."""
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0
