"""Exact Jaccard join over word shingles, with skipping by set relations.

Texts with the same shingle set are one class. The shingles of a set are put in a global order, rare ones first
(by a count sketch of fixed size over all documents, then by hash), and the first n - ceil(t * n) + 1 of them,
its prefix, and LEAST - 1 more go into inverted lists with size and position. Two sets over the threshold share their first LEAST common
shingles there (fewer, if they need not have so many in common), so that a pair is looked at only if it meets in so many lists.

Index-level skipping: the position p of an entry bounds the size of a partner, because at most n - p shingles, and
LEAST - 1 before, can agree; entries are compared only within these bounds.

Answer-level skipping. First every list links its entries to a leader each: the entry with the fewest rare shingles before the list's
own, so that a group of near copies has few leaders, and central ones. For each pair of leader and member the difference is kept,
not only its size d: the shingles that the member adds to the leader's set or lacks from it. A class is then anchored to the leader
with the most members. Later pairs are answered from these differences without reading a set:
* same anchor: x and y differ by d(x) + d(y) - 2 * (what their differences share). If their labels differ, at least one of them is not linked
  to the anchor, and then a link needs a shared part; so pairs are sought by a prefix join over the differences, new shingles first.
* different anchors L, M: x and y differ by d(L, M) - d(x) - d(y) at least, and only leaders that meet in a list are compared.
Whatever the leaders, the parity sketches of two sets (256 bits, each flipped by the shingles that fall on it) differ in no more bits than the sets in shingles,
which rules out most pairs that meet by chance. Only the pairs that these bounds leave open are read. A group of near copies thus costs a few comparisons a member.

These rounds give the components, which is what near_duplicates, one_of_each and the queries need, and of the links a part that
spans them. joined(complete=True) adds a round for all links, inside components too: the answers of two members' leaders
bound their difference from both sides, and only pairs that the bounds leave open are read. All links of a group are as many as
its pairs of different texts.

Each text is read once; its set of 64-bit shingle hashes is written to the shared folder, and all later steps read it there, the
comparisons only the sets of classes that have a pair (a filter of fixed size picks them before any shuffle).
Classes, not documents, are compared; copies of a hot class reach a list or a comparison at most once from each task.
The list of one shingle is one task's work, 24 bytes for each class that has it in its prefix. Components are found by distributed star steps.

Defined results: a null or empty text, or one without words, has an empty set and is alone; fewer words than a shingle
make one shingle; rows that repeat share their class; a null doc_id gets a null component unless another copy has an id, and never
names one; equal sizes and positions go by a hash of the class, without influence on the result; a text of any length is one set, held whole by one task;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .exchange import pack, range_of, unpack
from .runtime import documents, few_rows, scratch, slots, written
from .text import SPACED, U64, buffers, chunks, gram_hashes, mix64, ranges, word_hashes, words

SHINGLE, PERCENT = 4, 85
#: Lists in which a pair has to meet.
LEAST = 3
#: Cells of the count sketch, and of the filter for classes that have a pair; both of fixed size.
CELL_BITS, FILTER_BITS = 20, 24
SLICES = 16
#: Entries of lists that one task sorts, about.
ENTRIES = 300_000
#: Pairs that a task of the complete mode gathers before it drops repeated ones.
PAIRS = 1 << 22
#: Ids that may be broadcast.
FEW = 1_000_000
#: Bytes of sets that one task compares at a time, about.
PART_BYTES = 4 << 20
SETS = "doc_id long, n long, digest long, data binary, s0 long, s1 long, s2 long, s3 long"
SKETCH = ("s0", "s1", "s2", "s3")
#: Bits by which the sketches of a leader and a member may differ although the pair is not linked; a member beyond has no leader.
LOOSE = 96
INDEX = "kind int, token long, digest long, n int, pos int, other long"
ANSWER = "a long, b long, n_a long, n_b long, overlap long"
MET = "range long, token long, a long, b long, times long"
LIST, STAR = 0, 2


def shingle_sets(column, shingle: int):
    """For chunks of texts: first row, and for each text its sorted distinct shingle hashes."""
    for chunk in chunks(column):
        w = words(chunk, SPACED, lower=True)
        codes = word_hashes(w)
        grams = gram_hashes(codes, shingle)
        out = []
        for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
            if b - a >= shingle:
                out.append(np.unique(grams[a : b - shingle + 1]))
            else:
                out.append(mix64(gram_hashes(codes[a:b], b - a) + U64(b - a)) if b > a else codes[:0])
        yield chunk.first, out


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n1, n2, percent: int):
    """The least overlap of sets of these sizes that links them."""
    return -(-percent * (n1 + n2) // (100 + percent))


def sketch(rows: DataFrame, cells_of, n_cells: int, most: int) -> np.ndarray:
    """Counts of rows' cells, up to `most`; cells_of(batch) yields arrays of cell numbers. n_cells numbers reach the driver."""
    wide = n_cells // SLICES

    def count(batches):
        total = np.zeros(n_cells, np.uint32)
        for batch in batches:
            for cells in cells_of(batch):
                total += np.bincount(cells, minlength=n_cells).astype(np.uint32)
        if total.any():
            low = np.minimum(total, most).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"slice": np.arange(SLICES), "data": pa.array([zlib.compress(low[k * wide : (k + 1) * wide].tobytes(), 1) for k in range(SLICES)], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(wide, np.uint64)
        for raw in t.column("data").to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
        return pa.table({"slice": t.column("slice").slice(0, 1), "data": pa.array([zlib.compress(np.minimum(total, most).astype(np.uint32).tobytes(), 1)], pa.binary())})

    part = rows.mapInArrow(count, "slice long, data binary").withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(16)))
    for keys in (["slice", "deal"], ["slice"]):
        part = part.groupBy(*keys).applyInArrow(add, "slice long, data binary").withColumn("deal", F.lit(0))
    out = np.zeros((SLICES, wide), np.uint32)
    for r in part.select("slice", "data").collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint32)
    return out.ravel()


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of sets, end to end, and where each set starts."""
    data, offsets = buffers(column)
    return data.view("<u8"), offsets // 8


def parity(s: np.ndarray) -> np.ndarray:
    """256 bits, each flipped by every shingle that falls on it; two sets' differ in at most as many bits as the sets in shingles."""
    return np.packbits(np.bincount((s >> U64(8)).astype(np.uint8), minlength=256).astype(np.uint8) & 1).view(np.int64)


def portions(batches, size: int = 1 << 17):
    """Classes, hashes and starts of about `size` hashes of sets at a time."""
    for batch in batches:
        values, offsets = flat(batch.column("data"))
        names, i = batch.column("digest").to_numpy(), 0
        while i < len(names):
            j = min(len(names), max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
            yield names[i:j], values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def coded(batches, shingle: int):
    """Per document its class and size; the set itself where the class is new to the task (SETS)."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column("doc_id")
        for first, sets in shingle_sets(batch.column("text"), shingle):
            name = [digest(s) if len(s) else 0 for s in sets]
            data = [s.tobytes() if len(s) and d not in seen and not seen.add(d) else None for s, d in zip(sets, name)]
            sketches = np.array([parity(s) if x is not None else (0, 0, 0, 0) for s, x in zip(sets, data)], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(name, pa.int64()), pa.array(data, pa.binary()), *(pa.array(sketches[:, k]) for k in range(4))], ["doc_id", "n", "digest", "data", *SKETCH]
            )


def marked(rows: DataFrame, cells_of, bits: int) -> np.ndarray:
    """Which of 2**bits cells occur; an eighth of a byte of each reaches the driver."""
    wide = (1 << bits) // SLICES // 8

    def mark(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for cells in cells_of(batch):
                seen[cells] = True
        if seen.any():
            low = np.packbits(seen)
            yield pa.RecordBatch.from_pydict({"slice": np.arange(SLICES), "data": pa.array([zlib.compress(low[k * wide : (k + 1) * wide].tobytes(), 1) for k in range(SLICES)], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(wide, np.uint8)
        for raw in t.column("data").to_pylist():
            total |= np.frombuffer(zlib.decompress(raw), np.uint8)
        return pa.table({"slice": t.column("slice").slice(0, 1), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    part = rows.mapInArrow(mark, "slice long, data binary").withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(16)))
    for keys in (["slice", "deal"], ["slice"]):
        part = part.groupBy(*keys).applyInArrow(add, "slice long, data binary").withColumn("deal", F.lit(0))
    out = np.zeros((SLICES, wide), np.uint8)
    for r in part.select("slice", "data").collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out.ravel()


def occurs(cells_seen: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (cells_seen[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


class Join:
    def __init__(self, percent: int, n_ranges: int, order: np.ndarray):
        self.percent, self.n_ranges = percent, n_ranges
        self.order = order  # frequency class of each sketch cell, small numbers first

    def ordered(self, s: np.ndarray) -> np.ndarray:
        """Hashes in the global order, rare ones first; s is sorted by hash, which breaks ties."""
        return s[np.argsort(self.order[(s >> U64(64 - CELL_BITS)).astype(np.int64)], kind="stable")]

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The rarest shingles of a set, in the global order: those among which its partners' first LEAST common ones are."""
        n = len(s)
        return self.ordered(s)[: n - -(-self.percent * n // 100) + LEAST]

    def index(self, batches):
        """Payloads by range of shingle hash: the prefix entries of each class."""
        for names, values, offsets in portions(batches):
            n = np.diff(offsets)
            parts = [self.prefix(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            size = np.array([len(p) for p in parts], np.int64)
            token = np.concatenate([np.empty(0, U64), *parts])
            order = np.argsort(token, kind="stable")
            token = token[order]
            who, pos, many = np.repeat(names, size)[order], ranges(np.zeros(len(parts), np.int64), size)[order], np.repeat(n, size)[order]
            where = range_of(token, self.n_ranges, 64)
            start, length = runs(where)
            data = [pack(token[(s := slice(a, a + k))]) + who[s].tobytes() + many[s].astype("<u4").tobytes() + pos[s].astype("<u4").tobytes() for a, k in zip(start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(where[start], pa.int64()), pa.array(data, pa.binary())], ["range", "data"])

    def lists(self, t: pa.Table) -> pa.Table:
        """Lists with two classes or more, and the star pairs in them."""
        out = [pa.table({c: pa.array([], k) for c, k in zip(_COLUMNS, _TYPES)})]
        token, who, n, pos = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, "<u4")], [np.empty(0, "<u4")]
        for r in t.column("data").to_pylist():
            h, rest = unpack(r)
            m = len(h)
            token.append(h)
            who.append(np.frombuffer(rest, np.int64, m))
            n.append(np.frombuffer(rest, "<u4", m, 8 * m))
            pos.append(np.frombuffer(rest, "<u4", m, 12 * m))
        token, who, n, pos = (np.concatenate(x) for x in (token, who, n, pos))
        # lists of one entry first go without sorting by all keys
        order = np.argsort(token, kind="stable")
        h = token[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:]
        keep = order[same]
        token, who, n, pos = token[keep], who[keep], n[keep].astype(np.int64), pos[keep].astype(np.int64)
        order = np.lexsort([who, n, token])
        token, who, n, pos = token[order], who[order], n[order], pos[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
        token, who, n, pos = token[once], who[once], n[once], pos[once]
        start, length = runs(token)
        big = np.repeat(length > 1, length)
        token, who, n, pos = token[big], who[big], n[big], pos[big]
        if len(token):
            # pairs that can't be linked over their list make no list
            start, length = runs(token)
            two = start[length == 2]
            most = self.most(n, pos)
            never = two[(n[two + 1] > most[two]) | (n[two] > most[two + 1])]
            keep = np.ones(len(token), bool)
            keep[never] = keep[never + 1] = False
            token, who, n, pos = token[keep], who[keep], n[keep], pos[keep]
        if len(token):
            out.append(_table(LIST, token=token.view(np.int64), digest=who, n=n.astype(np.int32), pos=pos.astype(np.int32)))
            a, b = self.stars(token, who, n, pos)
            pair, times = np.unique(np.stack([who[a], who[b], self.least(n[a], n[b])]), axis=1, return_counts=True)
            if pair.shape[1]:
                out.append(_table(STAR, digest=pair[0], other=pair[1], n=times.astype(np.int32), pos=pair[2].astype(np.int32)))
        return pa.concat_tables(out)

    def most(self, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The largest size of a partner that an entry of this size and position can link to over this shingle."""
        by_size = 100 * n // self.percent
        by_position = (100 + self.percent) * (n - np.maximum(pos - (LEAST - 1), 0)) // self.percent - n
        return np.minimum(by_size, by_position)

    def least(self, n1, n2):
        """In how many lists linked sets of these sizes meet at least."""
        return np.minimum(LEAST, need(n1, n2, self.percent))

    def stars(self, token, who, n, pos) -> tuple[np.ndarray, np.ndarray]:
        """Leader and member entries: in each list the entry that has the fewest rarer shingles leads all within its reach in size, then the next of the rest."""
        start, length = runs(token)
        leaders, members = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        most, reach = self.most(n, pos), 100 * n // self.percent
        rank = np.empty(len(who), np.int64)
        rank[np.lexsort([mix64(who.view(U64)), pos])] = np.arange(len(who))
        for a, k in zip(start.tolist(), length.tolist()):
            left = np.arange(a, a + k)
            while len(left) > 1:
                i = left[rank[left].argmin()]
                near = (n[left] <= reach[i]) & (n[i] <= reach[left])
                m = left[near & (left != i)]
                m = m[(n[m] <= most[i]) & (n[i] <= most[m])]
                leaders.append(np.full(len(m), i))
                members.append(m)
                left = left[~near]
        return np.concatenate(leaders), np.concatenate(members)

    def groups(self, t: pa.Table):
        """The lists with several labels and several leaders: columns sorted by list, leader and label, and for each list where its (leader, label) groups start and end."""
        cols = {c: t.column(c).to_numpy() for c in ("token", "digest", "n", "pos", "label", "leader", "d", *SKETCH)}
        order = np.lexsort([cols["n"], cols["label"], cols["leader"], cols["token"]])
        cols = {c: v[order].astype(np.int64) for c, v in cols.items()}
        cols["sketch"] = np.stack([cols.pop(c) for c in SKETCH], axis=1)
        start, length = runs(cols["token"])
        out = []
        for a, k in zip(start.tolist(), length.tolist()):
            label, leader = cols["label"][a : a + k], cols["leader"][a : a + k]
            if leader[0] != leader[-1] and (label != label[0]).any():
                edge = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (leader[1:] != leader[:-1])]))
                out.append((a + edge, a + np.append(edge[1:], k)))
        return cols, out

    def meeting(self, first, stop, cols, most):
        """For each group of a list the later groups, of another label and leader, that it can meet within the bounds of size and position."""
        label, leader = cols["label"][first], cols["leader"][first]
        low, high = cols["n"][first], cols["n"][stop - 1]  # sorted by size within a group
        top = np.maximum.reduceat(most[first[0] : stop[-1]], first - first[0])
        last = np.searchsorted(leader, leader, "right")  # groups of one leader stand together
        for k, a in enumerate(last.tolist()):
            j = a + np.flatnonzero((label[a:] != label[k]) & (low[a:] <= top[k]) & (low[k] <= top[a:]))
            if len(j):
                yield k, j, high

    def near(self, cols, i: int, others: np.ndarray) -> np.ndarray:
        """Whether the sketches allow a link between entry i and each of others."""
        apart = np.bitwise_count(cols["sketch"][others].view(U64) ^ cols["sketch"][i].view(U64)).sum(1, dtype=np.int64)
        return apart <= self.allowed(cols["n"][i], cols["n"][others])

    def leaders(self, t: pa.Table) -> pa.Table:
        """Pairs of leaders whose stars meet in a list within the bounds, under different labels; and the lists (token) in which any do."""
        cols, lists = self.groups(t)
        leader, most = cols["leader"], self.most(cols["n"], cols["pos"])
        found, open_ = [np.empty((2, 0), np.int64)], []
        for first, stop in lists:
            before = len(found)
            star = (stop - first > 1) | (cols["digest"][first] != leader[first])
            for k, j, _ in self.meeting(first, stop, cols, most):
                if not star[k]:  # two classes without members are held to their sketches at once
                    j = j[star[j] | self.near(cols, first[k], first[j])]
                    if not len(j):
                        continue
                # leaders of stars are always compared: their answer rules out pairs of members
                other = np.unique(np.concatenate([leader[first[j]], *[leader[first[j]][star[j] | star[k]]] * (LEAST - 1)]), return_counts=True)
                other = np.repeat(other[0], np.minimum(other[1], LEAST))
                found.append(np.stack([np.full(len(other), leader[first[k]]), other]))
            if len(found) > before:
                open_.append(int(cols["token"][first[0]]))
        pair = np.concatenate(found, axis=1)
        pair, times = np.unique(np.stack([pair.min(0), pair.max(0)]), axis=1, return_counts=True)
        none, own = pa.nulls(len(open_), pa.int64()), pa.array([t.column("range")[0].as_py()], pa.int64())
        pairs = pa.table({"range": pa.repeat(own[0], pair.shape[1]), "token": pa.nulls(pair.shape[1], pa.int64()), "a": pair[0], "b": pair[1], "times": times})
        return pa.concat_tables([pairs, pa.table({"range": pa.repeat(own[0], len(open_)), "token": pa.array(open_, pa.int64()), "a": none, "b": none, "times": none})])

    def crossed(self, t: pa.Table, known: pa.Table) -> pa.Table:
        """Pairs of different labels and leaders that a list, its bounds and the leaders' answers allow: in how many lists, and in how many they have to be."""
        if not t.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "least", "times")})
        cols, lists = self.groups(t)
        n, leader, d, who = (cols[c] for c in ("n", "leader", "d", "digest"))
        most = self.most(n, cols["pos"])
        apart = dict(zip(zip(known.column("a").to_pylist(), known.column("b").to_pylist()), known.column("d").to_pylist()))
        found = [np.empty((3, 0), np.int64)]
        for first, stop in lists:
            near = np.maximum.reduceat(d[first[0] : stop[-1]], first - first[0])
            for k, j, big in self.meeting(first, stop, cols, most):
                x = int(leader[first[k]])
                gap = np.array([apart.get((x, y) if x < y else (y, x), 0) for y in leader[first[j]].tolist()], np.int64)
                ok = gap - near[k] - near[j] <= self.allowed_within(big[k], big[j])
                j, gap = j[ok], np.repeat(gap[ok], stop[j[ok]] - first[j[ok]])
                if not len(j):
                    continue
                other = ranges(first[j], stop[j] - first[j])
                for i in range(int(first[k]), int(stop[k])):
                    pick = (n[other] <= most[i]) & (n[i] <= most[other]) & (gap - d[i] - d[other] <= self.allowed(n[i], n[other]))
                    at = other[pick]
                    at = at[self.near(cols, i, at)]
                    if len(at):
                        found.append(np.stack([np.minimum(who[i], who[at]), np.maximum(who[i], who[at]), self.least(n[i], n[at])]))
        pair, times = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
        return pa.table({"a": pair[0], "b": pair[1], "least": pair[2], "times": times})

    def differences(self, batches):
        """Entries of the difference lists: for each anchored class the prefix of its difference that a link to a class of another label has to share a part of.

        An unlinked class differs from the anchor by more than r * (n + n_leader), r = (100 - percent) / (100 + percent); so with any y of the
        anchor's classes, y linked or not, it has to share more than (d(y) - r * (n(y) - n_leader)) / 2.
        """
        p = self.percent
        for batch in batches:
            values, offsets = flat(batch.column("delta"))
            n, n_leader, d = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "n_leader", "d"))
            linked = d <= self.allowed(n, n_leader)
            least = np.where(linked, ((100 + p) * d - (100 - p) * (n - n_leader)) // (2 * (100 + p)) + 1, d - (100 - p) * n // p)
            size = np.clip(d - np.maximum(least, 1) + 1, 0, d)
            at, own = ranges(offsets[:-1], size), np.repeat(np.arange(len(n)), size)
            token, pos = values[at], at - offsets[own]
            cols = {c: batch.column(c).to_numpy()[own] for c in ("leader", "digest", "n", "d", "label")}
            yield pa.RecordBatch.from_pydict(cols | {"token": token.view(np.int64), "pos": pos, "linked": linked[own]})

    def within(self, t: pa.Table) -> pa.Table:
        """Pairs of one anchor and different labels whose differences can share enough; those of two linked classes never are."""
        cols = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "token", "digest", "n", "d", "label", "pos", "linked")}
        order = np.lexsort([cols["linked"], cols["token"], cols["leader"]])
        leader, token, who, n, d, label, pos, linked = (cols[c][order] for c in cols)
        first = np.flatnonzero(np.concatenate([[True], (leader[1:] != leader[:-1]) | (token[1:] != token[:-1])]))
        found = [np.empty((2, 0), np.int64)]
        for a, b in zip(first.tolist(), np.append(first[1:], len(leader)).tolist()):
            for i in range(a, min(b - 1, a + int((~linked[a:b]).sum()))):  # the unlinked ones come first
                y = np.arange(i + 1, b)
                y = y[(label[y] != label[i]) & (self.percent * n[y] <= 100 * n[i]) & (self.percent * n[i] <= 100 * n[y])]
                share = -(-(d[i] + d[y] - self.allowed(n[i], n[y])) // 2)
                y = y[share <= np.minimum(d[i] - pos[i], d[y] - pos[y])]
                if len(y):
                    found.append(np.stack([np.full(len(y), who[i]), who[y]]))
        pair = np.concatenate(found, axis=1)
        pair = np.unique(np.stack([pair.min(0), pair.max(0)]), axis=1)
        return pa.table({"a": pair[0], "b": pair[1]})

    def ship(self, t: pa.Table, asked: pa.Table) -> pa.Table:
        """The sets that other parts ask for, once each."""
        place = {d: i for i, d in enumerate(t.column("digest").to_pylist())}
        at = pa.array([place[a] for a in asked.column("a").to_pylist()], pa.int64())
        return pa.table({"part": asked.column("to"), "a": asked.column("a"), "data": t.column("data").take(at)})

    def compared(self, t: pa.Table, asked: pa.Table, told: bool) -> pa.Table:
        """Both sizes and the overlap of each pair (a: a set sent here; b: a set of this part); if told, also what b adds to a, then what it lacks, each in the global order, unless that is more than a set."""
        (left, at), (right, bt) = flat(asked.column("data")), flat(t.column("data"))
        a, b = asked.column("a").to_pylist(), asked.column("b").to_pylist()
        sent = {x: i for i, (x, y) in enumerate(zip(a, b)) if y is None}
        own = {d: i for i, d in enumerate(t.column("digest").to_pylist())}
        rows, delta = [], []
        for x, y in zip(a, b):
            if y is None:
                continue
            i, j = sent[x], own[y]
            s, r = left[at[i] : at[i + 1]], right[bt[j] : bt[j + 1]]
            place = np.minimum(np.searchsorted(s, r), len(s) - 1)
            hit = s[place] == r
            overlap = int(hit.sum())
            rows.append((x, y, len(s), len(r), overlap))
            if told:
                near = len(s) + len(r) - 2 * overlap <= min(len(s), len(r))
                lacks = np.ones(len(s), bool)
                lacks[place[hit]] = False
                delta.append(self.ordered(r[~hit]).tobytes() + self.ordered(s[lacks]).tobytes() if near else None)
        cols = list(zip(*rows)) or [[]] * 5
        out = {c: pa.array(list(v), pa.int64()) for c, v in zip(("a", "b", "n_a", "n_b", "overlap"), cols)}
        return pa.table(out | ({"delta": pa.array(delta, pa.binary())} if told else {}))

    def derived(self, t: pa.Table, known: pa.Table) -> pa.Table:
        """All pairs of classes that a list, its bounds and the leaders' answers allow, and whether these answers alone link them."""
        parts = [np.empty((3, 0), np.int64)]
        if t.num_rows:
            n, leader, d, who, token = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "leader", "d", "digest", "token"))
            most = self.most(n, t.column("pos").to_numpy().astype(np.int64))
            apart = dict(zip(zip(known.column("a").to_pylist(), known.column("b").to_pylist()), known.column("d").to_pylist()))
            order = np.argsort(token, kind="stable")
            start, length = runs(token[order])
            ready = 0
            for a, k in zip(start.tolist(), length.tolist()):
                row = order[a : a + k]
                for i in range(k - 1):
                    x, y = row[i], row[i + 1 :]
                    y = y[(n[y] <= most[x]) & (n[x] <= most[y])]
                    if not len(y):
                        continue
                    lead, which = np.unique(leader[y], return_inverse=True)
                    own = int(leader[x])
                    gap = np.array([0 if m == own else apart.get((min(own, m), max(own, m)), -1) for m in lead.tolist()], np.int64)[which]
                    told, most_apart = gap >= 0, self.allowed(n[x], n[y])
                    least = np.where(told, np.maximum(np.maximum(gap - d[x] - d[y], d[x] - gap - d[y]), d[y] - gap - d[x]), 0)
                    sure, maybe = told & (gap + d[x] + d[y] <= most_apart), least <= most_apart
                    parts.append(np.stack([np.minimum(who[x], who[y]), np.maximum(who[x], who[y]), sure])[:, maybe])
                    ready += int(maybe.sum())
                    if ready > PAIRS:  # pairs that meet in several lists are dropped as they come
                        parts = [np.unique(np.concatenate(parts, axis=1), axis=1)]
                        ready = 0
        pair = np.unique(np.concatenate(parts, axis=1), axis=1)
        return pa.table({"a": pair[0], "b": pair[1], "sure": pair[2]})

    def allowed(self, n1, n2):
        """How many shingles linked sets of these sizes may not share."""
        return n1 + n2 - 2 * need(n1, n2, self.percent)

    def allowed_within(self, n1, n2):
        """A bound of allowed() for sets of at most these sizes; allowed() itself falls and rises from size to size."""
        return (100 - self.percent) * (n1 + n2) // (100 + self.percent)


_COLUMNS = ("kind", "token", "digest", "n", "pos", "other")
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())


def _table(kind: int, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    columns = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.table({c: pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_COLUMNS, _TYPES)})


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(sorted_values)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if n else np.empty(0, np.int64)
    return start, np.diff(np.append(start, n))


class Result:
    """members (doc_id, n, digest), links (a, b: linked classes; all of them, once and a < b, if complete, else a part that spans the components), classes (digest, component_id, label)."""

    def __init__(self, members: DataFrame, links: DataFrame, classes: DataFrame):
        self.members, self.links, self.classes = members, links, classes


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, complete: bool = False) -> Result:
    with few_rows(docs.sparkSession, 500), scratch(docs.sparkSession):
        return _joined(docs, shingle, percent, complete)


def _joined(docs: DataFrame, shingle: int, percent: int, complete: bool) -> Result:
    spark = docs.sparkSession
    sets = written(documents(docs).mapInArrow(lambda batches: coded(batches, shingle), SETS), "sets", "none")
    members, whole = written(sets.select("doc_id", "n", "digest"), "kept-members"), sets.where("data IS NOT NULL")
    sets, classes = whole.select("digest", "n", "data"), whole.groupBy("digest").agg(F.first("n").cast("int").alias("n"), *[F.first(c).alias(c) for c in SKETCH])
    counts = sketch(sets.select("digest", "data"), lambda batch: ((values >> U64(64 - CELL_BITS)).astype(np.int64) for _, values, _ in portions([batch])), 1 << CELL_BITS, 2**31 - 1)
    order = spark.sparkContext.broadcast(np.minimum(8 * np.log2(1.0 + counts), 65535).astype(np.uint16))
    entries = sets.agg(F.sum(F.lit(LEAST) + F.col("n") * (100 - percent) / 100)).first()[0] or 0
    n_ranges = max(1, min(slots(spark), 4096), -(-int(entries) // ENTRIES))

    def make() -> Join:
        return Join(percent, n_ranges, order.value)

    payload = sets.select("digest", "data").mapInArrow(lambda batches: make().index(batches), "range long, data binary")
    index = written(payload.groupBy("range").applyInArrow(lambda t: make().lists(t), INDEX), "index")
    sketches = written(classes, "classes")
    lists = index.where(F.col("kind") == LIST).select("token", "digest", "n", "pos")
    enough = lambda pairs: pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("least").alias("least")).where("times >= least").select("a", "b")
    stars = enough(index.where(F.col("kind") == STAR).select(F.col("digest").alias("a"), F.col("other").alias("b"), F.col("n").alias("times"), F.col("pos").alias("least")))
    side = lambda c: sketches.select(F.col("digest").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(k).alias(f"{k}_{c}") for k in SKETCH])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH])
    stars = stars.join(side("a"), "a").join(side("b"), "b").where(apart <= F.greatest(F.lit(LOOSE), (F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))).select("a", "b")

    def tested(pairs: DataFrame, what: str, told: bool = False) -> DataFrame:
        """The pairs (a, b) with both sizes and their overlap (ANSWER), and their difference if told."""
        pairs = written(pairs.select("a", "b"), "asked")
        cell = lambda column: (column.to_numpy().view(U64) >> U64(64 - FILTER_BITS)).astype(np.int64)
        has = spark.sparkContext.broadcast(marked(pairs, lambda batch: [cell(batch.column("a")), cell(batch.column("b"))], FILTER_BITS))
        have = sets.select("digest", "data").mapInArrow(lambda batches: (b.filter(pa.array(occurs(has.value, cell(b.column("digest"))))) for b in batches), "digest long, data binary")
        have = written(have.groupBy("digest").agg(F.first("data").alias("data")), "have", "none")
        n_parts = max(slots(spark), -(-(have.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // PART_BYTES))
        part = lambda c: F.pmod(F.col(c), F.lit(n_parts).cast("long"))
        have = have.withColumn("part", part("digest"))
        wanted = pairs.select(part("a").alias("part"), "a", part("b").alias("to")).distinct()
        sent = have.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(lambda t, q: make().ship(t, q), "part long, a long, data binary")
        asked = sent.select("part", "a", F.lit(None).cast("long").alias("b"), "data").unionAll(pairs.select(part("b").alias("part"), "a", "b", F.lit(None).cast("binary").alias("data")))
        return written(have.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda t, q: make().compared(t, q, told), ANSWER + (", delta binary" if told else "")), what)

    linked = F.col("overlap") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    differ = (F.col("n_a") + F.col("n_b") - 2 * F.col("overlap")).alias("d")
    first = tested(stars, "stars", told=True)
    label = written(components(first.where(linked)), "labels")
    # each class is anchored to the leader with the most members
    near = first.where("delta IS NOT NULL").select(F.col("a").alias("leader"), F.col("b").alias("digest"), differ)
    sizes = near.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    star = near.join(sizes, "leader").groupBy("digest").agg(F.max(F.struct("size", -F.col("d"), "leader")).alias("s")).select("digest", "s.leader")
    star = written(star.join(near, ["digest", "leader"]), "anchors")

    def labelled(now: DataFrame, lists: DataFrame) -> DataFrame:
        out = lists.join(sketches.drop("n"), "digest").join(now.withColumnRenamed("vertex", "digest"), "digest", "left").join(star, "digest", "left")
        return out.select("token", "digest", "n", "pos", *SKETCH, F.coalesce("label", "digest").alias("label"), F.coalesce("leader", "digest").alias("leader"), F.coalesce("d", F.lit(0)).alias("d"), F.pmod(F.xxhash64("token"), F.lit(n_ranges)).alias("range"))

    met = written(labelled(label, lists).groupBy("range").applyInArrow(lambda t: make().leaders(t), MET), "met")
    cells = lambda column: (mix64(column.to_numpy().view(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)
    open_ = spark.sparkContext.broadcast(marked(met.where("token IS NOT NULL").select("token"), lambda batch: [cells(batch.column("token"))], FILTER_BITS))
    met, still = met.where("token IS NULL"), lists.mapInArrow(lambda batches: (b.filter(pa.array(occurs(open_.value, cells(b.column("token"))))) for b in batches), "token long, digest long, n int, pos int")
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_a", "n_b", "overlap")
    second = tested(enough(met.withColumn("least", F.lit(LEAST))).join(known.select("a", "b"), ["a", "b"], "left_anti"), "leaders")
    answers = known.unionAll(second.select(known.columns)).select("a", "b", differ).distinct()
    told = met.join(answers, ["a", "b"]).select("range", "a", "b", "d")
    cross = labelled(label, still).groupBy("range").cogroup(told.groupBy("range")).applyInArrow(lambda t, k: make().crossed(t, k), "a long, b long, least long, times long")
    # classes of one anchor, by their differences to it
    delta = star.join(first.select(F.col("a").alias("leader"), F.col("b").alias("digest"), F.col("n_a").alias("n_leader"), F.col("n_b").alias("n"), "delta"), ["leader", "digest"])
    delta = delta.join(label.withColumnRenamed("vertex", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    several = delta.groupBy("leader").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("leader")
    delta = delta.join(several, "leader", "left_semi")
    shared = delta.mapInArrow(lambda batches: make().differences(batches), "leader long, digest long, n long, d long, label long, token long, pos long, linked boolean")
    shared = shared.withColumn("range", F.pmod(F.xxhash64("leader", "token"), F.lit(n_ranges)))
    inside = shared.groupBy("range").applyInArrow(lambda t: make().within(t), "a long, b long")
    third = second.where(linked).select("a", "b").unionAll(tested(enough(cross).unionAll(inside).distinct().join(answers.select("a", "b"), ["a", "b"], "left_anti"), "rest").where(linked).select("a", "b"))
    links = first.where(linked).select("a", "b").unionAll(third)
    if complete:
        # leaders of stars that meet in a list, now of the same component too
        own = lambda: labelled(label, lists).withColumn("label", F.col("leader"))
        near = written(own().groupBy("range").applyInArrow(lambda t: make().leaders(t), MET), "met").where("token IS NULL")
        more = tested(enough(near.withColumn("least", F.lit(LEAST))).join(answers.select("a", "b"), ["a", "b"], "left_anti"), "leaders")
        answers = answers.unionAll(more.select("a", "b", differ)).distinct()
        told = near.join(answers, ["a", "b"]).select("range", "a", "b", "d")
        pairs = own().groupBy("range").cogroup(told.groupBy("range")).applyInArrow(lambda t, k: make().derived(t, k), "a long, b long, sure long")
        pairs = written(pairs.groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")
        links = pairs.where("sure = 1").select("a", "b").unionAll(tested(pairs.where("sure = 0").select("a", "b"), "links").where(linked).select("a", "b"))
    final = written(components(label.select(F.col("vertex").alias("a"), F.col("label").alias("b")).unionAll(third)), "labels")
    classes = members.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least")).join(final.withColumnRenamed("vertex", "digest"), "digest", "left").select("digest", "least", F.coalesce("label", "digest").alias("label"))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    return Result(members, written(links, "kept-links"), written(classes.join(named, "label").select("digest", "component_id", "label"), "kept-classes"))


def linked_pairs(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All pairs a < b of different doc_ids whose texts reach the threshold, equal texts among them: as many rows as the answer has."""
    found = joined(docs, shingle, percent, complete=True)
    named = found.members.where("n > 0 and doc_id is not null").select("doc_id", "digest").distinct()
    links = found.links.unionAll(found.links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(named.select(F.col("digest").alias("a"), F.col("digest").alias("b")).distinct())
    left, right = named.select(F.col("doc_id").alias("x"), F.col("digest").alias("a")), named.select(F.col("doc_id").alias("y"), F.col("digest").alias("b"))
    return left.join(links, "a").join(right, "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own at most)."""
    found = joined(docs, shingle, percent)
    return found.members.join(found.classes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _small(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it has been counted to be small: else texts would be shuffled to drop some of them."""
    ids = written(ids, "kept-ids")
    return F.broadcast(ids) if ids.count() <= FEW else ids


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row (the smallest doc_id, once) of each group of near duplicates; rows with null doc_id stay.
    Rows that share a doc_id are told apart by their texts."""
    found = joined(docs, shingle, percent)
    members = found.members.join(found.classes, "digest", "left")
    gone = _small(members.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    twice = _small(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id"))
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").join(twice, "doc_id", "left_anti").select(docs.columns)
    again = docs.join(twice, "doc_id").select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))

    def digests(batches):
        for batch in batches:
            name = [digest(s) if len(s) else 0 for _, sets in shingle_sets(batch.column("text"), shingle) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), batch.column("row")], ["digest", "row"])

    again = again.mapInArrow(digests, StructType([StructField("digest", LongType()), again.schema["row"]])).join(found.classes, "digest", "left")
    again = again.where(F.coalesce("component_id", "row.doc_id") == F.col("row.doc_id"))
    plain = F.struct(*[F.col("row").getField(c) for c in ["text", *[c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]]])
    again = again.groupBy(F.col("row.doc_id").alias("doc_id"), "label").agg(F.min_by("row", plain).alias("row"))
    return kept.unionAll(again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
