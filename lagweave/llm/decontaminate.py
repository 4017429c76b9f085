"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each shard (a few megabytes of whole texts) becomes a word sequence in the benchmark's
vocabulary. Runs of words that the benchmark knows are kept, everything else is a separator:
no verbatim match can reach across it. The runs are sorted into a suffix array by prefix
doubling, and every suffix of every benchmark item is binary-searched in it, which gives its
longest verbatim match with its place, and the range of suffixes that begin with its window.
Occurrences are followed from their first word to their last, which gives each text its longest match.
Shards are independent, so nothing is shuffled; the index of the benchmark is broadcast in
blocks of checked size, one after another, and what several blocks find in a text is merged by row.

Defined results: a null or empty text has no words and no hits; a null item text has no window;
a null item_id is reported as "null"; rows with equal item_id count as one item; an empty benchmark leaves
every text clean; of equally long matches the first in the text counts, then the item that sorts first; a text of any length is searched to its end, by one task;
repeated document rows each get their own result row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, written
from .text import ALNUM, Chunk, chunks, covered, ranges, word_hashes, words

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text in one broadcast block; a larger benchmark takes several.
BLOCK_BYTES = 32 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_start long, longest_item string"
MATCHES = "item_id string, item_start long, length long, doc_id long, doc_start long"


@dataclass
class Benchmark:
    """Items in the numbering of their own vocabulary (1..V); item i is ids[offsets[i]:offsets[i+1]]."""

    names: list[str]
    vocabulary: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    window: int

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int = WINDOW) -> Benchmark:
        table = pa.array([t for _, t in rows], pa.large_string())
        codes, counts = [], []
        for chunk in chunks(table):
            w = words(chunk, ALNUM, lower=True)
            codes.append(word_hashes(w))
            counts.append(w.counts())
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        vocabulary, ids = np.unique(flat, return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, np.int64)
        return cls([n for n, _ in rows], vocabulary, ids.astype(np.int32) + 1, offsets, window)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all suffixes that hold a whole window: item, start, words to the item's end, words in the window."""
        size = np.diff(self.offsets)
        wide = np.minimum(size, self.window)
        n = np.where(size > 0, size - wide + 1, 0)
        item = np.repeat(np.arange(len(size)), n)
        start = ranges(self.offsets[:-1], n)
        return item, start, self.offsets[item + 1] - start, wide[item]


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of seq in the order of their first `depth` (or more) symbols, by prefix doubling; 0 ends a suffix's comparison."""
    n = len(seq)
    rank = seq.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and n:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:]
        nxt[rank == 0] = 0
        key = rank * (int(nxt.max(initial=0)) + 1) + nxt
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        zero = int(np.count_nonzero(seq == 0))
        fresh = np.empty(n, np.int64)
        fresh[order] = step + (0 if zero else 1)
        fresh[seq == 0] = 0
        done = step[-1] + 1 >= n - zero + (zero > 0)
        rank, k = fresh, 2 * k
        if done:
            break
    return order[seq[order] != 0]


def bounds(seq: np.ndarray, order: np.ndarray, test: np.ndarray, start: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of test[start:start+depth], all at once: the first suffix not below it, or the first beyond those that begin with it."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        common, below = compare(seq, order[mid], test, start[open_], depth[open_])
        right = below | (after & (common == depth[open_]))
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def compare(seq: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words (depth at most) of seq from `at` and test from `start`, and whether seq is the smaller."""
    common = np.zeros(len(at), np.int64)
    below = np.zeros(len(at), bool)
    live = np.arange(len(at))
    while len(live := live[common[live] < depth[live]]):
        a, b = seq[at[live] + common[live]], test[start[live] + common[live]]
        same = a == b
        below[live[~same]] = (a < b)[~same]
        live = live[same]
        common[live] += 1
    return common, below


@dataclass
class Shard:
    """A shard's runs of known words as one sequence with 0 between them, and where each symbol stands."""

    seq: np.ndarray
    place: np.ndarray
    offsets: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, chunk: Chunk, bench: Benchmark, depth: int, least: int) -> Shard:
        w = words(chunk, ALNUM, lower=True)
        codes = word_hashes(w)
        at = np.searchsorted(bench.vocabulary, codes)
        at[at == len(bench.vocabulary)] = 0
        known = (bench.vocabulary[at] == codes) if len(bench.vocabulary) else np.zeros(len(codes), bool)
        edge = np.zeros(len(codes) + 1, bool)
        edge[w.offsets] = True
        opens = known & (edge[:-1] | np.concatenate([[True], ~known[:-1]]))
        first = np.flatnonzero(opens)
        closes = known & (edge[1:] | np.concatenate([~known[1:], [True]]))
        length = np.flatnonzero(closes) + 1 - first
        first, length = first[length >= least], length[length >= least]
        place = ranges(first, length + 1)
        ends = np.cumsum(length + 1) - 1
        seq = np.zeros(len(place), np.int32)
        inner = np.ones(len(place), bool)
        inner[ends] = False
        seq[inner] = at[place[inner]] + 1
        return cls(seq, place, w.offsets, suffix_array(seq, depth))


def occurrences(shard: Shard, bench: Benchmark, suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of a window in the shard: its place in the shard's sequence, and the item suffix."""
    item, start, rest, wide = suffixes
    if not len(shard.order) or not len(item):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = bounds(shard.seq, shard.order, bench.ids, start, wide, False)
    inside = np.flatnonzero(low < len(shard.order))
    common, _ = compare(shard.seq, shard.order[low[inside]], bench.ids, start[inside], wide[inside])
    hit = inside[common == wide[inside]]
    n = bounds(shard.seq, shard.order, bench.ids, start[hit], wide[hit], True) - low[hit]
    return shard.order[ranges(low[hit], n)], np.repeat(hit, n)


def followed(shard: Shard, bench: Benchmark, suffixes, at: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches: of the occurrences that no occurrence one word before reaches, place in the sequence, words, item."""
    item, start, rest, _ = (x[suffix] for x in suffixes)
    inner = (start > bench.offsets[item]) & (at > 0)
    inner[inner] = shard.seq[at[inner] - 1] == bench.ids[start[inner] - 1]
    own = np.flatnonzero(~inner)
    length, _ = compare(shard.seq, at[own], bench.ids, start[own], rest[own])
    return at[own], length, item[own]


def longest(shard: Shard, bench: Benchmark, start: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For every item suffix the words of its longest verbatim match in the shard."""
    best = np.zeros(len(start), np.int64)
    if len(shard.order):
        low = bounds(shard.seq, shard.order, bench.ids, start, rest, False)
        for near in (low - 1, low):
            ok = np.flatnonzero((near >= 0) & (near < len(shard.order)))
            common, _ = compare(shard.seq, shard.order[near[ok]], bench.ids, start[ok], rest[ok])
            best[ok] = np.maximum(best[ok], common)
    return best


def first_match(shard: Shard, bench: Benchmark, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every match (item suffix, words) the least key of all its places; key is by place in the suffix array."""
    if not len(start):
        return np.empty(0, np.int64)
    low, high = (bounds(shard.seq, shard.order, bench.ids, start, length, after) for after in (False, True))
    pair, which = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
    return np.minimum.reduceat(np.append(key, len(key)), pair.T.ravel())[::2][which.ravel()]


def blocks(benchmark: DataFrame, window: int) -> tuple[int, Callable[[int], object]]:
    """The number of blocks of at most BLOCK_BYTES each that the benchmark takes, and what broadcasts one of them."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    n_bytes = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-n_bytes // BLOCK_BYTES))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    sc = benchmark.sparkSession.sparkContext
    return n, lambda k: sc.broadcast(Benchmark.build([(r["i"], r["t"]) for r in rows.where(F.col("b") == k).toLocalIterator()], window))


def _found(batches, block, depth_beyond: int = 1):
    """Per batch and shard: first row, chunk, shard, benchmark, suffixes."""
    bench = block.value
    suffixes = bench.suffixes()
    depth = max(int(suffixes[3].max(initial=1)), depth_beyond)
    least = int(suffixes[3].min(initial=depth))
    for batch in batches:
        for chunk in chunks(batch.column("text"), SHARD_BYTES):
            yield batch, chunk, Shard.build(chunk, bench, depth, least), bench, suffixes


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _per_text(shard: Shard, bench: Benchmark, suffixes):
    """Flags of the hit words, and for each text with hits its items and its longest match (words, first word, item)."""
    at, suffix = occurrences(shard, bench, suffixes)
    hit = covered(shard.place[at], suffixes[3][suffix], int(shard.offsets[-1]))
    text = np.searchsorted(shard.offsets, shard.place[at], "right") - 1
    pairs = np.unique(np.stack([text, suffixes[0][suffix]]), axis=1) if len(at) else np.empty((2, 0), np.int64)
    items: dict[int, set[str]] = {}
    for t, i in pairs.T.tolist():
        items.setdefault(t, set()).add(bench.names[i])
    best: dict[int, tuple[int, int, str]] = {}
    where, length, item = followed(shard, bench, suffixes, at, suffix)
    place = shard.place[where]
    text = np.searchsorted(shard.offsets, place, "right") - 1
    first = place - shard.offsets[text]
    order = np.lexsort([first, -length, text])
    top = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])] if len(order) else order
    for t, n, s in zip(text[top].tolist(), length[top].tolist(), first[top].tolist()):
        best[t] = n, s, ""
    same = [k for k in order.tolist() if (length[k], first[k]) == best[int(text[k])][:2]]
    for k in same:
        t, name = int(text[k]), bench.names[item[k]]
        best[t] = *best[t][:2], min(best[t][2] or name, name)
    return hit, items, best


def _rows(doc_id, n_words, n_hit, items, best) -> pa.RecordBatch:
    n_hit = np.asarray(n_hit, np.int64)
    best = [b or (0, None, None) for b in best]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": doc_id,
            "n_words": np.asarray(n_words, np.int64),
            "n_hit": n_hit,
            "n_items": np.array([len(x) for x in items], np.int64),
            "items_sha256": [digest(list(x)) for x in items],
            "contaminated": n_hit > 0,
            "longest_match": pa.array([b[0] for b in best], pa.int64()),
            "longest_start": pa.array([b[1] for b in best], pa.int64()),
            "longest_item": pa.array([b[2] for b in best], pa.string()),
        }
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, the benchmark items found in it, and its longest verbatim match with an item: words, first word, item (RESULT)."""
    n, load = blocks(benchmark, window)
    docs = documents(docs)
    if n == 1:
        block = load(0)

        def one(batches):
            for batch, chunk, shard, bench, suffixes in _found(batches, block):
                hit, items, best = _per_text(shard, bench, suffixes)
                total = np.concatenate([[0], np.cumsum(hit)])[shard.offsets]
                yield _rows(batch.column("doc_id").slice(chunk.first, len(chunk)), np.diff(shard.offsets), np.diff(total), [items.get(i, ()) for i in range(len(chunk))], [best.get(i) for i in range(len(chunk))])

        return docs.mapInArrow(one, RESULT)
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # numbered once: all blocks see the same rows
    parts = None
    for k in range(n):
        block = load(k)

        def some(batches, block=block):
            for batch, chunk, shard, bench, suffixes in _found(batches, block):
                hit, items, best = _per_text(shard, bench, suffixes)
                best = [best.get(i) or (0, None, None) for i in range(len(chunk))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column("row").slice(chunk.first, len(chunk)),
                        "doc_id": batch.column("doc_id").slice(chunk.first, len(chunk)),
                        "n_words": np.diff(shard.offsets),
                        "hits": pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(shard.offsets[:-1], shard.offsets[1:])], pa.binary()),
                        "items": pa.array([sorted(items.get(i, ())) for i in range(len(chunk))], pa.list_(pa.string())),
                        "longest": pa.array([b[0] for b in best], pa.int64()),
                        "start": pa.array([b[1] for b in best], pa.int64()),
                        "item": pa.array([b[2] for b in best], pa.string()),
                    }
                )

        part = written(docs.mapInArrow(some, "row long, doc_id long, n_words long, hits binary, items array<string>, longest long, start long, item string"), "hits")
        block.unpersist()
        parts = part if parts is None else parts.unionAll(part)

    def merged(t: pa.Table) -> pa.Table:
        hits = np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in t.column("hits").to_pylist()])
        names = set().union(*t.column("items").to_pylist())
        found = [x for x in zip(t.column("longest").to_pylist(), t.column("start").to_pylist(), t.column("item").to_pylist()) if x[0]]
        best = min(found, key=lambda x: (-x[0], x[1], x[2])) if found else None
        return pa.Table.from_batches([_rows(t.column("doc_id").combine_chunks().slice(0, 1), t.column("n_words").to_numpy()[:1], [int(np.unpackbits(hits).sum())], [names], [best])])

    return parts.groupBy("row").applyInArrow(merged, RESULT)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per benchmark item: its longest verbatim match in the corpus and one place of it (MATCHES); ties go to the smaller document, then place, then place in the item. Matches of any length count, a single word too."""
    n, load = blocks(benchmark, window)
    out = None
    for k in range(n):
        block = load(k)

        def best(batches, block=block):
            bench = block.value
            size = np.diff(bench.offsets)
            deep = int(size.max(initial=1))
            items, starts = np.repeat(np.arange(len(size)), size), np.arange(bench.offsets[-1])
            for batch, chunk in ((b, c) for b in batches for c in chunks(b.column("text"), SHARD_BYTES)):
                shard = Shard.build(chunk, bench, deep, 1)
                ids = batch.column("doc_id").slice(chunk.first, len(chunk))
                length = longest(shard, bench, starts, bench.offsets[items + 1] - starts)
                top = np.zeros(len(size), np.int64)
                np.maximum.at(top, items, length)
                best_of = np.flatnonzero((length > 0) & (length == top[items]))
                item, start, length = items[best_of], starts[best_of], length[best_of]
                # places by document, those without an id last
                at = shard.place[shard.order]
                text = np.searchsorted(shard.offsets, at, "right") - 1
                none, number = np.array(ids.is_null()), np.array(ids.fill_null(0))
                by_document = np.lexsort([at - shard.offsets[text], number[text], none[text]])
                key = np.empty(len(at), np.int64)
                key[by_document] = np.arange(len(at))
                least = first_match(shard, bench, start, length, key)
                order = np.lexsort([start, least, item])
                order = order[np.concatenate([[True], item[order][1:] != item[order][:-1]])] if len(order) else order
                where = at[by_document[least[order]]]
                text = np.searchsorted(shard.offsets, where, "right") - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_id": pa.array([bench.names[i] for i in item[order]], pa.string()),
                        "item_start": start[order] - bench.offsets[item[order]],
                        "length": length[order],
                        "doc_id": ids.take(pa.array(text)),
                        "doc_start": where - shard.offsets[text],
                    }
                )

        part = documents(docs).mapInArrow(best, MATCHES)
        if n > 1:
            part = written(part, "matches")
            block.unpersist()
        out = part if out is None else out.unionAll(part)
    first = F.max_by(F.struct("item_start", "length", "doc_id", "doc_start"), F.struct("length", -F.col("doc_id"), -F.col("doc_start"), -F.col("item_start"))).alias("m")
    return out.groupBy("item_id").agg(first).select("item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    n, load = blocks(benchmark, window)
    for k in range(n):
        block = load(k)

        def clean(batches, block=block):
            for batch, chunk, shard, bench, suffixes in _found(batches, block):
                at, _ = occurrences(shard, bench, suffixes)
                keep = np.ones(len(chunk), bool)
                keep[np.searchsorted(shard.offsets, shard.place[at], "right") - 1] = False
                yield batch.slice(chunk.first, len(chunk)).filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        if n > 1:
            docs = written(docs, "clean")
            block.unpersist()
    return docs
