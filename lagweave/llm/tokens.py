"""Token ids of whole texts with a file of the tokenizers library.

For word tokenizers (lower-casing, white space dropped, an end-of-word suffix) a text's ids are
those of its pre-tokens, end to end, and no pre-token crosses ASCII white space. Between white
space, a piece of ASCII letters, letters of Latin-1, digits and ASCII marks other than the
apostrophe falls into runs of letters, single digits and runs of marks; any other piece is
taken whole. Runs and pieces are found and hashed (64 bits) as arrays; each worker keeps the
bytes and ids of those it has met in flat arrays of bounded size, and only new ones reach the library,
many in one call, told apart by the suffix. A run takes kept ids only if its bytes are those kept; within a chunk of half a megabyte
runs of one hash count as equal (some 10^5 hashes of 64 bits: a chance of 3 in 10^10). Any other tokenizer file encodes texts one by one.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .text import LOWER, SPACED, Chunk, Words, chunks, owners, ranges, word_hashes

#: Runs kept by a worker.
KEPT = 1_000_000
#: The pre-token pattern that the split into runs holds for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OTHER, _LETTERS, _MARKS, _DIGIT = 0, 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARKS
_KIND[0x27] = _KIND[0x7C] = _OTHER  # the apostrophe opens pre-tokens of its own, the bar stands in special tokens
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTERS


class Encoder:
    """ids(chunk): the ids of its texts, end to end, and where each text's ids start."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_run = bool(suffix) and "Lowercase" in str(spec.get("normalizer")) and PATTERN in str(json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False)).replace("\\\\", "\\")
        self.by_run &= all("|" in t["content"] for t in spec.get("added_tokens") or ())
        if self.by_run:
            self.last = np.zeros(self.size(), bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place, self.length, self.store = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
        self.raw, self.raw_at, self.raw_size = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens, end to end, and how many each has; one by one if the ends don't come out even."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(texts) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        each = self._each(texts)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _keep(self, hashes: np.ndarray, raw: list[bytes], whole: np.ndarray) -> None:
        texts = [x.decode("utf-8", "replace") for x in raw]
        ids, counts = [self.store], []
        order = np.argsort(whole, kind="stable")
        single = int((~whole).sum())
        for i in range(0, single, 2048):
            a, b = self._runs([texts[k] for k in order[i : min(i + 2048, single)]])
            ids.append(a)
            counts.append(b)
        for x in self._each([texts[k] for k in order[single:]]):
            ids.append(x)
            counts.append(np.array([len(x)]))
        counts = np.concatenate(counts)
        place = len(self.store) + np.cumsum(counts) - counts
        self.store = np.concatenate(ids)
        both = np.concatenate([self.hashes, hashes[order]])
        sort = np.argsort(both, kind="stable")
        self.hashes, self.place, self.length = both[sort], np.concatenate([self.place, place])[sort], np.concatenate([self.length, counts])[sort]
        size = np.array([len(raw[k]) for k in order], np.int64)
        self.raw_at = np.concatenate([self.raw_at, len(self.raw) + np.cumsum(size) - size])[sort]
        self.raw_size = np.concatenate([self.raw_size, size])[sort]
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw[k] for k in order), np.uint8)])

    def _unlike(self, w: Words, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the runs `first` differ from the kept ones `at` that share their hashes."""
        size = w.end[first] - w.start[first]
        bad = size != self.raw_size[at]
        same = np.flatnonzero(~bad)
        here, there = ranges(w.start[first[same]], size[same]), ranges(self.raw_at[at[same]], size[same])
        differ = np.flatnonzero(w.data[here] != self.raw[there])
        bad[same[np.repeat(np.arange(len(same)), size[same])[differ]]] = True
        return np.flatnonzero(bad)

    def ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_run:
            each = self._each([chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])])
            return np.concatenate([np.empty(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        w, whole = runs(chunk)
        code, first, which = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, code)
        new = np.flatnonzero((at >= len(self.hashes)) | (self.hashes[np.minimum(at, len(self.hashes) - 1)] != code) if len(self.hashes) else np.ones(len(code), bool))
        if len(new):
            if len(self.hashes) + len(new) > KEPT:
                self._forget()
                new = np.arange(len(code))
            self._keep(code[new], [w.data[a:b].tobytes() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())], whole[first[new]])
            at = np.searchsorted(self.hashes, code)
        place, counts, store = self.place[at], self.length[at], self.store
        for k in self._unlike(w, first, at).tolist():  # another run has this hash
            ids = self._each([w.data[w.start[first[k]] : w.end[first[k]]].tobytes().decode("utf-8", "replace")])[0]
            place[k], counts[k], store = len(store), len(ids), np.concatenate([store, ids])
        place, counts = place[which], counts[which]
        return store[ranges(place, counts)], np.concatenate([[0], np.cumsum(counts)])[w.offsets]


def runs(chunk: Chunk) -> tuple[Words, np.ndarray]:
    """Runs and whole pieces of the texts, ASCII in lower case; flags of the whole pieces."""
    data = chunk.data
    n = len(data)
    kind = _KIND[data]
    two = np.flatnonzero(data[:-1] == 0xC3) if n else np.empty(0, np.int64)
    two = two[(data[two + 1] >= 0x80) & (data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = _LETTERS
    kind[two + 1] = _LETTERS
    inside = SPACED[data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    opens = inside & edge[:-1]
    opens[1:] |= inside[1:] & ~inside[:-1]
    piece = np.cumsum(opens) - 1
    n_pieces = int(piece[-1]) + 1 if n else 0
    odd = np.zeros(n_pieces, bool)
    odd[piece[np.flatnonzero(inside & (kind == _OTHER))]] = True
    change = opens.copy()
    change[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~(odd[piece[1:]] if n_pieces else False)
    start = np.flatnonzero(change)
    stop = np.zeros(n + 1, bool)
    stop[:-1] = change | ~inside
    stop |= edge
    bounds = np.flatnonzero(stop)
    end = bounds[np.searchsorted(bounds, start, "right")] if len(start) else start
    return Words(start, end, np.searchsorted(start, chunk.offsets), LOWER[data]), odd[piece[start]] if len(start) else np.empty(0, bool)


def encoded(column: pa.Array, path: str, end_id: int):
    """For chunks of whole texts: the first row, all ids with end_id after each text, and where each text's ids start."""
    encoder = Encoder.at(path)
    for chunk in chunks(column, 1 << 19):
        ids, offsets = encoder.ids(chunk)
        more = offsets + np.arange(len(offsets))
        out = np.full(int(more[-1]), end_id, "<u4")
        out[np.arange(len(ids)) + owners(offsets)] = ids
        yield chunk.first, out, more
