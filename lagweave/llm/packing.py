"""Packing documents into fixed-length training sequences over the histogram of lengths.

Texts are tokenized once; a document longer than a sequence is cut into full pieces and a rest.
Only the histogram of piece lengths (at most `size` counts) reaches the driver. There, lengths
are placed longest first, all pieces of a length at once, always into the shortest open packs
that still hold them; a pattern is a list of lengths with the number of packs that look like
it. Patterns go back to the documents by rank: the r-th piece of a length takes the r-th slot
of that length, so that a lookup in the slot table (bounded by the pattern count, not by the
corpus) gives each piece its sequence and offset.

Defined results: a null or empty text is its end id alone; repeated rows, also with equal
doc_id, are packed separately; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import documents, written
from .text import ranges
from .tokens import encoded

SIZE = 2048
END_ID = 1
#: Ranks within a length are counted in so many parts, so that one frequent length is no hot key.
SALTS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


def padded(filled: int, size: int = SIZE) -> int:
    """Length of a sequence in storage: padded to size, but kept as it is at a power of two."""
    return filled if filled > 0 and filled & (filled - 1) == 0 else size


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: document, ids before it, length, crc32 of its ids, ids of the document (PIECES)."""

    def cut(batches):
        for batch in batches:
            for first, ids, offsets in encoded(batch.column("text"), tokenizer, end_id):
                total = np.diff(offsets)
                n = -(-total // size)
                row = np.repeat(np.arange(len(total)), n)
                start = ranges(np.zeros(len(n), np.int64), n) * size
                length = np.minimum(total[row] - start, size)
                at = 4 * (offsets[row] + start)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(first + row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents(docs).mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first over the histogram: (lengths in a pack, packs of that kind)."""
    open_: dict[int, list[list]] = {}  # sum of a pack -> [lengths, packs]
    sums: list[int] = []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, fresh = histogram[length], []
        while left:
            if not sums or sums[0] + length > size:
                # a new pack stays the shortest until its pieces no longer fit
                each = size // length
                fresh += [(each * length, (length,) * each, left // each), (left % each * length, (length,) * (left % each), 1)]
                break
            short = sums[0]
            kinds = open_[short]
            kind = kinds[-1]
            taken = min(left, kind[1])
            left -= taken
            kind[1] -= taken
            _add(open_, sums, short + length, kind[0] + (length,), taken)
            if not kind[1]:
                kinds.pop()
                if not kinds:
                    del open_[short]
                    sums.pop(0)
        for total, kind, n in fresh:
            if total and n:
                _add(open_, sums, total, kind, n)
    return [(tuple(k), n) for s in sorted(open_, reverse=True) for k, n in open_[s]]


def _add(open_, sums, total, kind, n) -> None:
    if total not in open_:
        open_[total] = []
        insort(sums, total)
    open_[total].append([kind, n])


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each slot of each pattern: length, first rank, first sequence, offset; by length and rank."""
    rows, used, base = [], {}, 0
    for kind, n in found:
        at = 0
        for length in kind:
            rank = used.get(length, 0)
            rows.append((length, rank, base, at))
            used[length] = rank + n
            at += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "base", "offset"))}


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces with sequence and offset (PLACED)."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, size, end_id), "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(patterns(histogram, size)))
    ranked = (
        cut.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")))
        .join(before.select("length", "salt", "before"), ["length", "salt"])
        .withColumn("rank", F.col("place") - 1 + F.coalesce("before", F.lit(0)))
    )

    def place(batches):
        t = table.value
        wide = 1 << 48
        keys = t["length"] * wide + t["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            out = {n: batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": t["base"][at] + rank - t["rank"][at], "offset": t["offset"][at]})

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, PLACED)
