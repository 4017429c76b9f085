"""Word passages that repeat anywhere in the corpus, found by fixed-block anchors.

A window of `window` words always holds a whole block of (window + 1) // 2 words that starts at a
multiple of that length in its document. Those non-overlapping reference blocks are the index;
every rolling run of the block's length probes it. A run is a hit if its hash is an indexed
block's and stands in more than one place. Around hits, and only there, the windows that hold
a hit are compared over the corpus by two 64-bit hashes; windows found twice extend the hit to the
maximal exact repeat, which is the union of the repeated windows in a row.

The texts are shuffled once, by batch; probes travel as sorted distinct hashes of a batch in
about three bytes each, answers as bits, and windows only from regions with a hit. No pairs of
occurrences are made, so a passage that a third of all documents share costs no more
than any other. Windows are equal if 128 bits are: among 10^12 distinct ones a chance equality has a probability of about 1 in 10^15.

Defined results: a null or empty text has no words; texts shorter than a window lose nothing; rows repeated
whole are two places; ties don't arise, as every repeat counts alike; a text of any length is one task's work, a chunk at a time; an empty table gives no rows;
other columns are ignored, or kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import PAYLOAD, batched, bits, distinct, gathered, grouped, pack, parted, payloads, placed, range_count, unbits, unpack
from .runtime import documents
from .text import SPACED, chunks, covered, gram_hashes, gram_starts, mix64, word_hashes, words

WINDOW = 35
_SALT = np.uint64(0x5851F42D4C957F2D)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and each text's first word; one entry more for the end."""
    codes, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for chunk in chunks(column):
        w = words(chunk, SPACED)
        codes.append(word_hashes(w))
        counts.append(w.counts())
    return np.concatenate(codes), np.cumsum(np.concatenate(counts))


def probe_width(n_bytes: int) -> int:
    """Bits of a probe: chance hits stay below one in some hundred probes."""
    return int(min(64, max(40, np.ceil(np.log2(max(n_bytes, 1))) + 6)))


class Plan:
    """Parameters of a run, and what batches and ranges do."""

    def __init__(self, window: int, width: int, n_ranges: int, n_window_ranges: int):
        self.window, self.block, self.width = window, (window + 1) // 2, width
        self.n_ranges, self.n_window_ranges = n_ranges, n_window_ranges

    def runs(self, codes, offsets):
        """Position and hash of every rolling run of a block's length in texts that hold a window, and whether it is a reference block."""
        ok = gram_starts(offsets, self.block)
        size = np.diff(offsets)
        ok &= np.repeat(size >= self.window, size)[: len(ok)]
        at = np.flatnonzero(ok)
        hashes = gram_hashes(codes, self.block)[at] >> np.uint64(64 - self.width)
        inside = at - np.repeat(offsets[:-1], size)[at]
        return at, hashes, inside % self.block == 0

    def probe(self, t: pa.Table) -> pa.Table:
        codes, offsets = coded(t.column("text"))
        _, hashes, anchor = self.runs(codes, offsets)
        found, which, twice = distinct(hashes)
        anchored = np.zeros(len(found), bool)
        anchored[which[anchor]] = True
        return payloads(t.column("batch")[0].as_py(), found, [anchored, twice], self.n_ranges, self.width)

    def match(self, t: pa.Table) -> pa.Table:
        """Which hashes of each batch are an anchor's and stand in more than one place."""
        batch, ends, hashes, (anchored, twice) = gathered(t, 2)
        order, starts = grouped(hashes)
        hit = np.logical_or.reduceat(anchored[order], starts) & (np.add.reduceat(1 + twice[order].astype(np.int64), starts) > 1)
        flag = np.empty(len(hashes), bool)
        flag[order] = np.repeat(hit, np.diff(np.append(starts, len(order))))
        parts = np.split(flag, ends[:-1])
        return pa.table({"batch": batch, "range": pa.array([t.column("range")[0].as_py()] * len(batch), pa.int32()), "data": pa.array([bits(p) for p in parts], pa.binary())}).filter(pa.array([bool(p.any()) for p in parts]))

    def extend(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Hashes of the windows that hold a hit."""
        if not docs.num_rows or not answers.num_rows:
            return pa.table({"range": pa.array([], pa.int32()), "batch": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        codes, offsets = coded(docs.column("text"))
        at, hashes, _ = self.runs(codes, offsets)
        found, which = np.unique(hashes, return_inverse=True)
        hit = np.zeros(len(found), bool)
        for at_, raw in zip(placed(found, answers.column("range").to_pylist(), self.n_ranges, self.width), answers.column("data").to_pylist()):
            hit[at_] = unbits(raw, at_.stop - at_.start)
        places = at[hit[which]]
        near = covered(np.maximum(places - (self.window - self.block), 0), np.minimum(places, self.window - self.block) + 1, len(codes) + 1)
        near = near[: max(0, len(codes) - self.window + 1)] & gram_starts(offsets, self.window)
        at = np.flatnonzero(near)
        hashes, first, times = np.unique(gram_hashes(codes, self.window)[at], return_index=True, return_counts=True)
        check = gram_hashes(mix64(codes ^ _SALT), self.window)[at[first]]
        full, edge = parted(hashes, self.n_window_ranges, 64)
        data = [pack(hashes[a:b]) + bits(times[a:b] > 1) + check[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return pa.table({"range": pa.array(full, pa.int32()), "batch": pa.array([docs.column("batch")[0].as_py()] * len(full), pa.int64()), "data": pa.array(data, pa.binary())})

    def repeated(self, t: pa.Table) -> pa.Table:
        """The windows of each batch that start in more than one place."""
        batch, ends, hashes, (twice,) = gathered(t, 1)
        check = np.concatenate([np.frombuffer(raw, np.uint64, offset=len(raw) - 8 * n) for raw, n in zip(t.column("data").to_pylist(), np.diff(ends, prepend=0).tolist())])
        order = np.lexsort([check, hashes])
        new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])])
        which = np.cumsum(new) - 1
        flag = np.empty(len(hashes), bool)
        flag[order] = (np.bincount(which, 1 + twice[order].astype(np.int64)) > 1)[which]
        data = [pack(h[f]) for h, f in zip(np.split(hashes, ends[:-1]), np.split(flag, ends[:-1]))]
        return pa.table({"batch": batch, "range": pa.array([0] * len(batch), pa.int32()), "data": pa.array(data, pa.binary())})

    def removed(self, docs: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Flags of all words that a repeated window covers, and the texts' first words."""
        codes, offsets = coded(docs.column("text"))
        if not answers.num_rows:
            return np.zeros(len(codes), bool), offsets
        known = np.unique(np.concatenate([unpack(raw)[0] for raw in answers.column("data").to_pylist()]))
        hashes = gram_hashes(codes, self.window)
        at = np.flatnonzero(gram_starts(offsets, self.window))
        if not len(known) or not len(at):
            return np.zeros(len(codes), bool), offsets
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        return covered(at[known[place] == hashes[at]], self.window, len(codes)), offsets


def planned(docs: DataFrame, window: int) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, docs in batches, and the answers for each batch."""
    spark = docs.sparkSession
    parts, _, n_bytes = batched(docs)
    ranges = range_count(spark, n_bytes // 6)
    plan = Plan(window, probe_width(n_bytes), ranges, range_count(spark, n_bytes // 12))
    hits = parts.groupBy("batch").applyInArrow(lambda t: plan.probe(t), PAYLOAD).groupBy("range").applyInArrow(lambda t: plan.match(t), "batch long, range int, data binary")
    windows = parts.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(lambda t, a: plan.extend(t, a), PAYLOAD)
    return plan, parts, windows.groupBy("range").applyInArrow(lambda t: plan.repeated(t), "batch long, range int, data binary")


def kept(column: pa.ChunkedArray, removed: np.ndarray, offsets: np.ndarray):
    """For each text its remaining words, joined by one blank."""
    lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[offsets]).tolist()
    for i, text in enumerate(column.to_pylist()):
        parts = text.encode().split() if text else []
        yield b" ".join(parts if not lost[i] else compress(parts, (~removed[offsets[i] : offsets[i + 1]]).tolist()))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words removed, and the sha256 of what is left (RESULT)."""
    plan, parts, answers = planned(documents(docs), window)

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        removed, offsets = plan.removed(t, a)
        return pa.table(
            {
                "doc_id": t.column("doc_id"),
                "n_words": np.diff(offsets),
                "n_removed": np.diff(np.concatenate([[0], np.cumsum(removed)])[offsets]),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept(t.column("text"), removed, offsets)],
            }
        )

    return parts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, RESULT)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, without the repeated passages: a text that loses words becomes its remaining words joined by one blank, a row that loses all of them goes; n_chars follows."""
    schema = docs.schema
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}  # no name can clash with `batch`
    docs = docs.withColumnsRenamed(own)
    columns = docs.columns
    plan, parts, answers = planned(docs, window)

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        removed, offsets = plan.removed(t, a)
        lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[offsets])
        old = t.column("text").to_pylist()
        new = [x if not n else y.decode() for x, n, y in zip(old, lost.tolist(), kept(t.column("text"), removed, offsets))]
        t = t.set_column(t.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        if "n_chars" in columns:
            at = t.schema.get_field_index("n_chars")
            was = t.column("n_chars").to_pylist()
            t = t.set_column(at, "n_chars", pa.array([len(x) if n else c for x, n, c in zip(new, lost.tolist(), was)], t.schema.field(at).type))
        return t.select(columns).filter(pa.array((lost == 0) | (lost < np.diff(offsets))))

    out = parts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, docs.schema)
    return out.toDF(*schema.names)
