"""Hash membership over a whole corpus with few shuffled bytes.

Rows are grouped into batches by a hash of the row; a batch is small enough for one Arrow
group. A batch states its distinct 64-bit (or shorter) hashes once, sorted and delta-coded, in
one payload for each range of hash values; a reducer of a range sees each hash at most once from
each batch however often it occurs there, so that a frequent passage is no hot key, and
answers each batch. Batches recompute their hashes and apply the answers.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import slots, volume

#: Bytes of text in a batch; they grow with the corpus, so that a batch has some dozens of hashes for each range, up to a bound that a worker can hold.
BATCH_BYTES, MOST_BATCH_BYTES = 4 << 20, 64 << 20
#: Distinct hashes that a range holds, about.
RANGE_HASHES = 2_000_000
_HEAD = struct.Struct("<QBQ")


def pack(values: np.ndarray) -> bytes:
    """Strictly ascending unsigned 64-bit integers: deltas in as few bytes each as nearly all need, the rest listed apart."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 1, 0)
    delta = np.empty(n, np.uint64)
    delta[0] = values[0]
    delta[1:] = values[1:] - values[:-1]
    wide = np.searchsorted(1 << (8 * np.arange(1, 8, dtype=np.uint64)), delta, "right") + 1
    total = np.bincount(wide, minlength=9)
    cost = [n * w + 16 * int(total[w + 1 :].sum()) for w in range(1, 9)]
    w = int(np.argmin(cost)) + 1
    odd = np.flatnonzero(wide > w)
    raw = delta.astype("<u8").view(np.uint8).reshape(n, 8)[:, :w].T.tobytes()
    return _HEAD.pack(n, w, len(odd)) + raw + odd.astype("<u8").tobytes() + delta[odd].astype("<u8").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, bytes]:
    """The integers, and what follows them."""
    n, w, n_odd = _HEAD.unpack_from(raw)
    at = _HEAD.size
    full = np.zeros((n, 8), np.uint8)
    full[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T
    delta = full.reshape(-1).view("<u8")
    at += n * w
    delta[np.frombuffer(raw, "<u8", n_odd, at).astype(np.int64)] = np.frombuffer(raw, "<u8", n_odd, at + 8 * n_odd)
    return np.cumsum(delta, dtype=np.uint64), raw[at + 16 * n_odd :]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)


def batched(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """docs with a column `batch`, the number of batches, and the bytes of text."""
    _, n_bytes = volume(docs, text)
    batch_bytes = min(MOST_BATCH_BYTES, max(BATCH_BYTES, n_bytes >> 15))
    n = max(1, 2 * slots(docs.sparkSession), -(-n_bytes // batch_bytes))
    key = [F.col(c) for c in ("doc_id", text) if c in docs.columns]
    return docs.withColumn("batch", F.pmod(F.xxhash64(*key), F.lit(n))), n, n_bytes


def range_count(spark, n_hashes: int) -> int:
    return max(1, min(slots(spark), 4096), -(-n_hashes // RANGE_HASHES))


def range_of(hashes: np.ndarray, n_ranges: int, width: int) -> np.ndarray:
    """Which of n_ranges equal ranges of width-bit values (32 at least) each hash falls into."""
    return (((hashes >> np.uint64(width - 32)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int64)


def parted(sorted_hashes: np.ndarray, n_ranges: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted_hashes fall into, and where each one's start; one entry more for the end. Costs no more for more ranges."""
    where = range_of(sorted_hashes, n_ranges, width)
    start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.empty(0, np.int64)
    return where[start], np.append(start, len(where))


def payloads(batch: int, sorted_hashes: np.ndarray, flags: list[np.ndarray], n_ranges: int, width: int) -> pa.Table:
    """Rows (range, batch, data): a batch's hashes of each range with their flags."""
    full, at = parted(sorted_hashes, n_ranges, width)
    data = [pack(sorted_hashes[a:b]) + b"".join(bits(f[a:b]) for f in flags) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return pa.table({"range": pa.array(full, pa.int32()), "batch": pa.array([batch] * len(full), pa.int64()), "data": pa.array(data, pa.binary())})


def placed(sorted_hashes: np.ndarray, ranges_: list[int], n_ranges: int, width: int) -> list[slice]:
    """Where the hashes of the given ranges stand."""
    full, at = parted(sorted_hashes, n_ranges, width)
    which = np.searchsorted(full, np.array(ranges_, np.int64)).tolist()
    return [slice(int(at[k]), int(at[k + 1])) for k in which]


PAYLOAD = "range int, batch long, data binary"


def gathered(t: pa.Table, n_flags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All payloads of a range: batches, their ends, hashes and flags."""
    hashes, flags = [], [[] for _ in range(n_flags)]
    for raw in t.column("data").to_pylist():
        h, rest = unpack(raw)
        hashes.append(h)
        step = -(-len(h) // 8)
        for k in range(n_flags):
            flags[k].append(unbits(rest, len(h), k * step))
    ends = np.cumsum([len(h) for h in hashes])
    return t.column("batch").to_numpy(), ends, np.concatenate(hashes), [np.concatenate(f) for f in flags]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, which one each hash is, and whether it occurs more than once."""
    found, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    return found, which, n > 1


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where each run of equal ones starts."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return order, starts
