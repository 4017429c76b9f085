"""Byte strings that repeat anywhere in the corpus, by a hash-compared suffix sort.

A string of `length` bytes counts as repeated if it starts in two places. Its place is found by
its anchor: of the length - gram + 1 grams in it, the first of least hash. Equal strings
have equal anchors, and a text has about one anchor in every half length, so only those suffixes are sorted.
Around an anchor lie the bytes that a string with this anchor can reach (its context). Anchors
meet by gram hash. If a whole context stands in two places, all strings in it repeat.
Otherwise the contexts of a gram are compared: their right and (reversed) left parts are
sorted by mergesort whose comparisons find the common extension by binary search over
prefix polynomial hashes; common extensions of neighbours are then verified byte by byte. From its neighbours
in both orders a context gets the union of its repeated strings, one interval around the
anchor. Where the best right and the best left neighbour differ and neither proves that
interval, the group's strings are compared one by one, by hash and then byte by byte.

Equality of whole contexts is that of their 128-bit blake2b digests, and of the gram's 64-bit hash besides. The polynomials run over hashes of eight
bytes at each place, not over the bytes: sums over bytes cancel on patterns of two letters. Each batch of texts sends
a context once however often it occurs; grams with more than `CROWD` distinct contexts are not gathered in one task: their
strings are compared by two independent 64-bit hashes, dealt out over all ranges.

Defined results: a null or empty text has no bytes; texts below `length` bytes lose nothing; rows repeated whole are
two places; texts are cut between bytes, not characters, in the digest; a text of any length is one task's work, a piece at a time;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import PAYLOAD, batched, bits, pack, parted, placed, range_count, unbits, unpack
from .runtime import documents
from .text import U64, Chunk, chunks, covered, joined, libc_trim, mix64, ranges

LENGTH, GRAM = 400, 64
#: Distinct contexts of one gram that one task compares at most.
CROWD = 1024
#: Bytes of contexts that are compared at a time, unless one gram has more.
BLOCK = 1 << 19
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FULL, CONTEXT, STRINGS = 1, 2, 4
_BASE = 0xA24BAED4963EE407
_PIECE, _BITS = 1 << 17, 24
_CHUNK = 1 << 18
_COUNT = struct.Struct("<Q")
_BIT = U64(1) << np.arange(1, 64, dtype=U64)
_SALTS = 0, 0x5851F42D4C957F2D


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1024, 1 << (n - 1).bit_length()), base & (2**64 - 1), U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[:-8] = data
    return np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(data),), (1,))


def rolling(data: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all strings of n bytes (n >= 8), by joining hashes of 8, 16, 32, ... bytes; len(data) - n + 1 of them."""
    if len(data) < n:
        return np.empty(0, U64)
    out, wide = eights(data)[: len(data) - 7] ^ U64(salt), 8
    while 2 * wide <= n:
        out = joined(out[:-wide], out[wide:])
        wide *= 2
    return mix64(joined(out[: len(data) - n + 1], out[n - wide :]))


class Hashed:
    """Prefix polynomial hashes over the hash of eight bytes at each place; codes and common extensions of substrings."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data, self.eight, self.total = data, eights(data), np.empty(n + 1, U64)
        self.total[0] = 0
        np.cumsum(mix64(self.eight) * powers(_BASE, n), out=self.total[1:])
        self.back = powers(pow(_BASE, -1, 2**64), n + 1)

    def code(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the eight bytes at each place of [start, stop)."""
        return (self.total[stop] - self.total[start]) * self.back[start]

    def common(self, a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
        """Longest common extension from a and b: binary search over hashes for the places whose eight bytes agree, then the last bytes."""
        most = np.minimum(a_stop - a, b_stop - b)
        low, high = np.zeros(len(a), np.int64), np.maximum(most - 8, -1) + 1
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            same = self.code(a[open_], a[open_] + mid) == self.code(b[open_], b[open_] + mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        last = len(self.data) - 1
        more = self.eight[np.minimum(a + low, last)] ^ self.eight[np.minimum(b + low, last)]
        more &= ~more + U64(1)  # the lowest bit that differs
        agree = np.searchsorted(_BIT, more, "right") // 8
        agree[more == 0] = 8
        return np.minimum(low + agree, most)

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n, but where the bytes differ earlier (a hash collision), that place."""
        at = ranges(np.zeros(len(n), np.int64), n)
        own = np.repeat(np.arange(len(n)), n)
        bad = np.flatnonzero(self.data[a[own] + at] != self.data[b[own] + at])
        n = n.copy()
        np.minimum.at(n, own[bad], at[bad])
        return n


def suffix_sort(h: Hashed, start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Indexes of the suffixes [start, stop), group by group (ascending, as they come), each group in lexicographic order; by mergesort."""
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else order
    size = np.diff(np.append(first, n))
    base, last = np.repeat(first, size), np.repeat(first + size, size)
    width = 1
    while n and width < size.max():
        at = np.arange(n)
        left = base + (at - base) // (2 * width) * 2 * width
        middle, right = np.minimum(left + width, last), np.minimum(left + 2 * width, last)
        second = at >= middle
        low, high = np.where(second, left, middle), np.where(second, middle, right)
        origin = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            x, y = order[open_], order[mid]
            before = below(h, start, stop, y, x) | (second[open_] & ~below(h, start, stop, x, y))
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        place = np.where(second, left + (at - middle), at) + (low - origin)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def below(h: Hashed, start, stop, x, y) -> np.ndarray:
    """Whether suffix x comes strictly before suffix y."""
    n = h.common(start[x], stop[x], start[y], stop[y])
    x_end, y_end = start[x] + n >= stop[x], start[y] + n >= stop[y]
    last = len(h.data) - 1
    return ~y_end & (x_end | (h.data[np.minimum(start[x] + n, last)] < h.data[np.minimum(start[y] + n, last)]))


class Anchors:
    """Anchors of a chunk of texts: place, reach to the left and right, hash of the gram, and the two halves of the context's digest."""

    def __init__(self, chunk: Chunk, length: int, gram: int):
        self.chunk = chunk
        n, wide = len(chunk.data), length - gram + 1
        size = np.diff(chunk.offsets)
        places, grams = [np.empty(0, np.int64)], [np.empty(0, U64)]
        if n >= length:
            ok = np.zeros(n - length + 1, bool)
            ok[ranges(chunk.offsets[:-1], np.maximum(size - length + 1, 0))] = True
            for a in range(0, n - length + 1, _PIECE):
                b = min(a + _PIECE + wide - 1, n - gram + 1)
                code = rolling(chunk.data[a : b + gram - 1], gram)
                v = (code & ~U64((1 << _BITS) - 1)) | np.arange(b - a, dtype=U64)
                step = 1
                while 2 * step <= wide:
                    v = np.minimum(v[:-step], v[step:])
                    step *= 2
                if wide > step:
                    v = np.minimum(v[: len(v) - (wide - step)], v[wide - step :])
                v = v[: len(ok) - a]
                v = v[ok[a : a + len(v)]]
                v = v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
                at = (v & U64((1 << _BITS) - 1)).astype(np.int64)
                places.append(a + at)
                grams.append(code[at])
        self.place, first = np.unique(np.concatenate(places), return_index=True)
        text = np.searchsorted(chunk.offsets, self.place, "right") - 1
        self.left = np.minimum(self.place - chunk.offsets[text], length - gram)
        self.right = np.minimum(chunk.offsets[text + 1] - self.place, length)
        # hashed anew: anchors are least hashes, which would all fall into the first ranges
        self.gram = mix64(np.concatenate(grams)[first] ^ U64(_SALTS[1]))
        raw, blake = memoryview(np.ascontiguousarray(chunk.data)), hashlib.blake2b
        sums = [blake(raw[a:b], digest_size=16, salt=c.to_bytes(4, "little")).digest() for a, b, c in zip((self.place - self.left).tolist(), (self.place + self.right).tolist(), self.left.tolist())]
        self.context, self.check = np.frombuffer(b"".join(sums), U64).reshape(-1, 2).T.copy()


class Plan:
    def __init__(self, length: int, gram: int, n_ranges: int, crowd: int):
        self.length, self.gram, self.n_ranges, self.crowd = length, gram, n_ranges, crowd

    def anchors(self, column):
        for chunk in chunks(column, _CHUNK):
            yield Anchors(chunk, self.length, self.gram)

    def known(self, anchors: list[Anchors]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of a batch by gram and digest, and whether they occur more than once."""
        both = np.concatenate([np.empty((3, 0), U64), *[np.stack([a.gram, a.context, a.check]) for a in anchors]], axis=1)
        both = both[:, np.lexsort([both[2], both[1], both[0]])]
        first = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)]) if both.shape[1] else np.empty(0, bool)
        starts = np.flatnonzero(first)
        return *both[:, starts], np.diff(np.append(starts, both.shape[1])) > 1

    def rows(self, ranges_, batch, data) -> pa.Table:
        return pa.table({"range": pa.array(ranges_, pa.int32()), "batch": pa.array([batch] * len(data) if np.isscalar(batch) else batch, pa.int64()), "data": pa.array(data, pa.binary())})

    def announce(self, t: pa.Table) -> pa.Table:
        gram, context, check, twice = self.known(list(self.anchors(t.column("text"))))
        full, at = parted(gram, self.n_ranges, 64)
        data = [_COUNT.pack(b - a) + gram[a:b].tobytes() + context[a:b].tobytes() + check[a:b].tobytes() + bits(twice[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return self.rows(full, t.column("batch")[0].as_py(), data)

    def meet(self, t: pa.Table) -> pa.Table:
        """What each batch has to do with each of its contexts."""
        raw = t.column("data").to_pylist()
        n = [_COUNT.unpack_from(r)[0] for r in raw]
        gram, context, check = (np.concatenate([np.frombuffer(r, U64, k, 8 + 8 * i * k) for r, k in zip(raw, n)]) for i in range(3))
        count = 1 + np.concatenate([unbits(r, k, 8 + 24 * k) for r, k in zip(raw, n)]).astype(np.int64)
        order = np.lexsort([np.arange(len(gram)), check, context, gram])
        g, c, e = gram[order], context[order], check[order]
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_c = new_g | np.concatenate([[True], (c[1:] != c[:-1]) | (e[1:] != e[:-1])])
        cls, grp = np.cumsum(new_c) - 1, np.cumsum(new_g) - 1
        full = np.bincount(cls, count[order]) > 1
        kinds = np.bincount(grp[new_c])
        open_ = np.bincount(grp[new_c], ~full) > 0  # some context in the group is not yet decided
        compare = (kinds > 1) & open_
        code = np.where(full[cls], FULL, 0)
        send = np.where(kinds[grp] > self.crowd, STRINGS, CONTEXT)
        code |= np.where(compare[grp] & new_c, send, 0)  # the first batch speaks for a context
        crowd = compare[grp] & (kinds[grp] > self.crowd)
        code |= np.where(crowd & ~full[cls], STRINGS, 0)
        out = np.empty(len(code), np.uint8)
        out[order] = code
        parts = np.split(out, np.cumsum(n)[:-1])
        keep = [bool(p.any()) for p in parts]
        return pa.table({"batch": t.column("batch"), "range": t.column("range"), "data": pa.array([p.tobytes() for p in parts], pa.binary())}).filter(pa.array(keep))

    def send(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """To the ranges: contexts to compare (kind 1), hashes of strings (kind 2); to the batch itself: its decided contexts (kind 0)."""
        if not docs.num_rows or not answers.num_rows:
            return self.rows([], 0, [])
        libc_trim()(0)
        anchors = list(self.anchors(docs.column("text")))
        gram, context, _, _ = self.known(anchors)
        code = np.zeros(len(gram), np.uint8)
        for at, raw in zip(placed(gram, answers.column("range").to_pylist(), self.n_ranges, 64), answers.column("data").to_pylist()):
            code[at] = np.frombuffer(raw, np.uint8)
        order = np.argsort(context, kind="stable")
        context, code = context[order], code[order]
        batch = docs.column("batch")[0].as_py()
        where, data, seen, strings = [], [], set(), [np.empty((2, 0), U64)]
        for a in anchors:
            own = code[np.searchsorted(context, a.context)] if len(a.context) else np.empty(0, np.uint8)
            pick = np.flatnonzero(own & CONTEXT)
            pick = pick[np.unique(a.context[pick], return_index=True)[1]]
            pick = np.array([i for i in pick if int(a.context[i]) not in seen], np.int64)
            seen.update(a.context[pick].tolist())
            pick = pick[np.argsort(a.gram[pick], kind="stable")]
            full, at = parted(a.gram[pick], self.n_ranges, 64)
            for k, x, y in zip(full.tolist(), at[:-1].tolist(), at[1:].tolist()):
                i = pick[x:y]
                body = a.chunk.data[ranges(a.place[i] - a.left[i], a.left[i] + a.right[i])]
                where.append(k)
                data.append(b"\1" + _COUNT.pack(len(i)) + a.gram[i].tobytes() + a.context[i].tobytes() + a.left[i].astype("<u2").tobytes() + a.right[i].astype("<u2").tobytes() + ((own[i] & FULL) > 0).tobytes() + body.tobytes())
            strings.append(a_strings(a, np.flatnonzero(own & STRINGS), self.length)[0])
        found, twice = distinct_pairs(np.concatenate(strings, axis=1))
        full, at = parted(found[0], self.n_ranges, 64)
        for k, x, y in zip(full.tolist(), at[:-1].tolist(), at[1:].tolist()):
            where.append(k)
            data.append(b"\2" + _COUNT.pack(y - x) + found[0, x:y].tobytes() + found[1, x:y].tobytes() + bits(twice[x:y]))
        full = context[(code & FULL) > 0]
        hot = context[(code & STRINGS) > 0]
        if len(full) or len(hot):
            where.append(batch % self.n_ranges)
            data.append(b"\0" + pack(np.unique(full)) + pack(np.unique(hot)))
        return self.rows(where, batch, data)

    def compare(self, t: pa.Table) -> pa.Table:
        batch, raw = t.column("batch").to_pylist(), t.column("data").to_pylist()
        out_batch, out = [], []
        libc_trim()(0)  # what earlier groups have freed
        some = [i for i, r in enumerate(raw) if r[0] == 1]
        if some:
            for i, reply in zip(some, self._contexts([raw[i] for i in some])):
                out_batch.append(batch[i])
                out.append(b"\1" + reply)
        some = [i for i, r in enumerate(raw) if r[0] == 2]
        if some:
            n = [_COUNT.unpack_from(raw[i], 1)[0] for i in some]
            codes = np.stack([np.concatenate([np.frombuffer(raw[i], U64, k, 9 + 8 * half * k) for i, k in zip(some, n)]) for half in (0, 1)])
            times = 1 + np.concatenate([unbits(raw[i], k, 9 + 16 * k) for i, k in zip(some, n)]).astype(np.int64)
            order = np.lexsort([codes[1], codes[0]])
            first = np.concatenate([[True], (codes[:, order][:, 1:] != codes[:, order][:, :-1]).any(0)])
            hit = np.bincount(np.cumsum(first) - 1, times[order]) > 1
            flag = np.empty(len(order), bool)
            flag[order] = hit[np.cumsum(first) - 1]
            for i, a, b in zip(some, np.cumsum([0, *n]).tolist(), np.cumsum(n).tolist()):
                out_batch.append(batch[i])
                out.append(b"\2" + codes[:, a:b][:, flag[a:b]].tobytes())
        for i, r in enumerate(raw):
            if r[0] == 0:
                out_batch.append(batch[i])
                out.append(r)
        return pa.table({"batch": pa.array(out_batch, pa.int64()), "data": pa.array(out, pa.binary())})

    def _contexts(self, raw: list[bytes]) -> list[bytes]:
        """For each payload the contexts with a repeated string, and how far the repeated strings reach to the left and right."""
        n = np.array([_COUNT.unpack_from(r, 1)[0] for r in raw])
        take = lambda kind, wide, at: np.concatenate([np.frombuffer(r, kind, k, 9 + at * k) for r, k in zip(raw, n)])  # noqa: E731, ARG005
        gram, context = take(U64, 8, 0), take(U64, 8, 8)
        left, right = take("<u2", 2, 16).astype(np.int64), take("<u2", 2, 18).astype(np.int64)
        done = take(bool, 1, 20)
        data = np.concatenate([np.frombuffer(r, np.uint8, -1, 9 + 21 * k) for r, k in zip(raw, n)])
        size = left + right
        begin = np.cumsum(size) - size
        order = np.argsort(gram, kind="stable")
        left_, right_ = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        # whole grams, about BLOCK bytes of context at a time: the hashes of a byte take many times its space
        new = np.concatenate([[True], gram[order][1:] != gram[order][:-1]])
        group, first = np.cumsum(new), np.flatnonzero(new)
        before = np.concatenate([[0], np.cumsum(size[order])])
        i = 0
        while i < len(order):
            j = int(np.searchsorted(before, before[i] + BLOCK, "right")) - 1
            k = int(np.searchsorted(first, j, "right")) - 1
            j = len(order) if j >= len(order) else int(first[k]) if first[k] > i else int(np.append(first, len(order))[k + 1])
            at = order[i:j]
            own = data[ranges(begin[at], size[at])]
            left_[at], right_[at] = reach(own, np.cumsum(size[at]) - size[at], left[at], right[at], group[i:j], self.length)
            i = j
        left_[done] = right_[done] = 0  # their batches know already
        out = []
        for a, b in zip(np.cumsum(n) - n, np.cumsum(n)):
            k = a + np.flatnonzero(right_[a:b] > 0)
            k = k[np.argsort(context[k], kind="stable")]
            out.append(_COUNT.pack(len(k)) + context[k].tobytes() + left_[k].astype("<u2").tobytes() + right_[k].astype("<u2").tobytes())
        return out

    def removed(self, docs: pa.Table, answers: pa.Table):
        """(chunk, flags of the removed bytes) of a batch's texts."""
        full, hot, strings, some = [np.empty(0, U64)], [np.empty(0, U64)], [np.empty((2, 0), U64)], [(np.empty(0, U64), np.empty(0, "<u2"), np.empty(0, "<u2"))]
        for raw in answers.column("data").to_pylist():
            if raw[0] == 0:
                a, rest = unpack(raw[1:])
                full.append(a)
                hot.append(unpack(rest)[0])
            elif raw[0] == 1:
                k = _COUNT.unpack_from(raw, 1)[0]
                some.append((np.frombuffer(raw, U64, k, 9), np.frombuffer(raw, "<u2", k, 9 + 8 * k), np.frombuffer(raw, "<u2", k, 9 + 10 * k)))
            else:
                strings.append(np.frombuffer(raw, U64, -1, 1).reshape(2, -1))
        full, hot = (np.unique(np.concatenate(x)) for x in (full, hot))
        strings = distinct_pairs(np.concatenate(strings, axis=1))[0]
        context, lo, hi = (np.concatenate([x[i] for x in some]) for i in range(3))
        order = np.argsort(context, kind="stable")
        context, lo, hi = context[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
        for a in self.anchors(docs.column("text")):
            begin, size = [], []
            i = np.flatnonzero(isin(full, a.context))
            begin.append(a.place[i] - a.left[i])
            size.append(a.left[i] + a.right[i])
            if len(context):
                at = np.searchsorted(context, a.context)
                at = np.minimum(at, len(context) - 1)
                i = np.flatnonzero(context[at] == a.context)
                begin.append(a.place[i] - lo[at[i]])
                size.append(lo[at[i]] + hi[at[i]])
            if strings.shape[1]:
                code, start = a_strings(a, np.flatnonzero(isin(hot, a.context)), self.length)
                start = start[pairs_in(strings, code)]
                begin.append(start)
                size.append(np.full(len(start), self.length))
            yield a.chunk, covered(np.concatenate(begin), np.concatenate(size), len(a.chunk.data))


def isin(sorted_values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(of), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, of), len(sorted_values) - 1)] == of


def distinct_pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of two rows of codes, sorted, and whether each occurs more than once."""
    codes = codes[:, np.lexsort([codes[1], codes[0]])]
    start = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(0)])) if codes.shape[1] else np.empty(0, np.int64)
    return codes[:, start], np.diff(np.append(start, codes.shape[1])) > 1


def pairs_in(sorted_codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which columns of `of` are among the distinct sorted columns."""
    both = np.concatenate([sorted_codes, of], axis=1)
    order = np.lexsort([both[1], both[0]])
    new = np.concatenate([[True], (both[:, order][:, 1:] != both[:, order][:, :-1]).any(0)])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    known = np.zeros(int(new.sum()), bool)
    known[which[: sorted_codes.shape[1]]] = True
    return known[which[sorted_codes.shape[1] :]]


def a_strings(a: Anchors, pick: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes and the places of all strings of the length in the contexts of the picked anchors; each place once."""
    least = np.maximum(length - a.right[pick], 0)
    start = np.unique(ranges(a.place[pick] - a.left[pick], np.maximum(a.left[pick] - least + 1, 0)))
    return np.stack([rolling(a.chunk.data, length, salt)[start] if len(start) else np.empty(0, U64) for salt in _SALTS]), start


def reach(data: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (the anchor stands `left` bytes after `begin`), group by group: how far the strings of `length` bytes that another context of the group shares reach to the left and right of the anchor; 0, 0 if there are none."""
    n = len(begin)
    size = left + right
    turned = np.repeat(begin + left - 1, left) - ranges(np.zeros(n, np.int64), left)
    h = Hashed(np.concatenate([data, data[turned]]))
    at_right, right_stop = begin + left, begin + size
    at_left = len(data) + np.cumsum(left) - left
    left_stop = at_left + left
    first = np.concatenate([[True], group[1:] != group[:-1]])
    lo, hi, most = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    partners = []
    for start, stop in ((at_right, right_stop), (at_left, left_stop)):
        order = suffix_sort(h, start, stop, group)
        x, y = order[:-1][~first[1:]], order[1:][~first[1:]]  # neighbours of one group
        both = h.verified(start[x], start[y], h.common(start[x], stop[x], start[y], stop[y]))
        best = np.zeros(n, np.int64)
        np.maximum.at(best, x, both)
        np.maximum.at(best, y, both)
        most.append(best)
        partners.append((x, y))
    for x, y in partners:
        r = h.verified(at_right[x], at_right[y], h.common(at_right[x], right_stop[x], at_right[y], right_stop[y]))
        l_ = h.verified(at_left[x], at_left[y], h.common(at_left[x], left_stop[x], at_left[y], left_stop[y]))
        ok = np.flatnonzero(l_ + r >= length)
        for side in (x, y):
            np.maximum.at(hi, side[ok], r[ok])
            np.maximum.at(lo, side[ok], l_[ok])
    unsure = (most[0] + most[1] >= length) & ((hi < most[0]) | (lo < most[1]))
    if unsure.any():
        want = np.flatnonzero(np.isin(group, np.unique(group[unsure])))
        least = np.maximum(length - right[want], 0)
        shift = ranges(least, np.maximum(left[want] - least + 1, 0))
        own = np.repeat(want, np.maximum(left[want] - least + 1, 0))
        start = at_right[own] - shift
        code = mix64(h.code(start, start + length - 7) + mix64((group[own] * 65536 + shift).astype(U64)))
        _, one, which, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        same = np.zeros(len(code), bool)  # byte by byte like the first of its hash
        for k in range(0, len(again), 4096):
            i = again[k : k + 4096]
            same[i] = h.verified(start[i], start[one[which[i]]], np.full(len(i), length)) == length
        pair = np.bincount(which[same], minlength=len(one)) > 1
        again = again[same[again] & pair[which[again]]]
        lo[want], hi[want] = 0, 0
        np.maximum.at(lo, own[again], shift[again])
        np.maximum.at(hi, own[again], length - shift[again])
    return lo, hi


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and the sha256 of what is left (RESULT)."""
    parts, _, n_bytes = batched(documents(docs))
    plan = Plan(length, gram, range_count(docs.sparkSession, n_bytes // 16), crowd)
    told = parts.groupBy("batch").applyInArrow(lambda t: plan.announce(t), PAYLOAD).groupBy("range").applyInArrow(lambda t: plan.meet(t), "batch long, range int, data binary")
    sent = parts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda t, a: plan.send(t, a), PAYLOAD)
    answers = sent.groupBy("range").applyInArrow(lambda t: plan.compare(t), "batch long, data binary")

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for chunk, gone in plan.removed(t, a):
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.offsets])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            edge = chunk.offsets[:-1]
            edge = edge[edge < len(gone)]
            opens[edge] = gone[edge]
            n_bytes.append(np.diff(chunk.offsets))
            n_removed.append(lost)
            n_spans.append(np.diff(np.concatenate([[0], np.cumsum(opens)])[chunk.offsets]))
            for i, x in enumerate(lost.tolist()):
                own = slice(chunk.offsets[i], chunk.offsets[i + 1])
                digests.append(hashlib.sha256((chunk.data[own][~gone[own]] if x else chunk.data[own]).tobytes()).hexdigest())
        none = [np.empty(0, np.int64)]
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": np.concatenate(n_bytes or none), "n_removed": np.concatenate(n_removed or none), "n_spans": np.concatenate(n_spans or none), "kept_sha256": pa.array(digests, pa.string())})

    return parts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, RESULT)
