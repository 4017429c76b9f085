"""Exact top-k search by inner product with the threshold algorithm.

Components are integers: floor(scale * x). Queries and candidates are dealt into blocks by a hash of
their id, and each pair of blocks is one task's work: a stated query set against
all rows. In a block of candidates every dimension has a list of all of them sorted by
that component. A query reads its lists in parallel, from the top where its own component is
positive and from the bottom where it is negative, scores each new candidate in full
(random access), and after each step sums what one more candidate could reach at the current depths.
It stops when that bound is below its kth best score; an equal bound goes on, as
an unseen candidate of smaller id would win the tie.

So that the bound bites early, a block's candidates are grouped by likeness, and the heads of each group's lists are known: their sum bounds the group at
depth 0, and so does its ball, centre and radius. A query scores its most promising group first; a group whose bound is below the kth score then is never read. Vectors in clusters leave most groups
unread; vectors without structure leave none. When nearly all candidates have been met, the few others are scored directly. Each block of candidates gives at most k rows for a query; the best k of
all blocks are the result.

Defined results: vectors that are null or empty, hold a null or non-finite component, or have no id take no part;
vectors of another length never meet; rows with the query's id are its own and no candidates;
several rows of one id are several candidates, but one query (the vector that sorts first); fewer than k candidates
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SCALE = 20, 64
CANDIDATES, QUERIES = 8192, 1024
FIRST_DEPTH = 16
#: If a step down the lists reads so many times more entries than candidates are left, those are scored at once.
REREAD = 8
#: Candidates in a group, about, and rounds that form the groups.
GROUP, ROUNDS = 128, 4
RESULT = "query_id long, rank int, vec_id long, score long"


def scores_kind(v: np.ndarray, q: np.ndarray):
    """The fastest number kind in which inner products of v and q are exact."""
    bound = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def alike(vectors: np.ndarray) -> np.ndarray:
    """A group for each vector, by a few rounds of nearest centres that start from evenly spaced vectors."""
    n = len(vectors)
    k = -(-n // GROUP)
    if k < 2:
        return np.zeros(n, np.int64)
    x = vectors.astype(np.float32)
    centre = x[np.linspace(0, n - 1, k).astype(np.int64)]
    for _ in range(ROUNDS):
        label = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        sums, many = np.zeros_like(centre), np.bincount(label, minlength=k)
        np.add.at(sums, label, x)
        centre = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centre)
    return np.unique(label, return_inverse=True)[1]


class Lists:
    """The sorted lists of a block of candidates, and the heads of its groups' lists from above and below."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.up = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors, self.up.T, axis=0).T.copy()
        self.group = alike(self.vectors)
        by_group = np.argsort(self.group, kind="stable")
        start = np.searchsorted(self.group[by_group], np.arange(self.group.max(initial=-1) + 1))
        self.members = np.split(by_group, start[1:])
        self.high, self.low = (f.reduceat(self.vectors[by_group], start, axis=0) if len(start) else self.vectors for f in (np.maximum, np.minimum))
        self.centre = np.array([self.vectors[m].mean(0, dtype=float) if len(m) else np.zeros(self.vectors.shape[1]) for m in self.members])
        self.radius = np.array([np.sqrt(((self.vectors[m] - c) ** 2).sum(1, dtype=float).max(initial=0)) for m, c in zip(self.members, self.centre)]) * (1 + 1e-6) + 1e-6

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best candidates (ties: the smaller id), and how many candidates were scored."""
        n = len(self.ids)
        live = np.flatnonzero(query)
        if not len(live):
            at = np.flatnonzero(self.ids != own)[:k]
            return at, np.zeros(len(at), query.dtype), len(at)
        weight, down = query[live], query[live] > 0
        unseen = self.ids != own
        best, score = np.empty(0, np.int64), np.empty(0, query.dtype)
        scored = 0
        if len(self.members) > 1:
            wide = query.astype(float)
            ball = np.ceil(self.centre @ wide + self.radius * np.sqrt(wide @ wide) + 1)
            bound = np.minimum(self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0), ball)
            first = self.members[int(bound.argmax())]
            best = first[unseen[first]]
            unseen[best] = False
            score, scored = self.vectors[best] @ query, len(best)
            order = np.lexsort([best, -score])[:k]
            best, score = best[order], score[order]
            if len(best) == k:
                unseen &= (bound >= score[-1])[self.group]
        depth, step, left = 0, FIRST_DEPTH, int(unseen.sum())
        while depth < n and left:
            stop = min(n, depth + step)
            if REREAD * left < step * len(live):  # the lists would mostly repeat: score what is left
                stop, new = n, np.flatnonzero(unseen)
            else:
                met = np.concatenate([self.up[live[down], n - stop : n - depth].ravel(), self.up[live[~down], depth:stop].ravel()])
                fresh = np.zeros(n, bool)
                fresh[met] = True
                fresh &= unseen
                new = np.flatnonzero(fresh)
                unseen[new] = False
            left -= len(new)
            scored += len(new)
            if len(new):
                got = self.vectors[new] @ query
                if len(best) == k:
                    ok = got >= score[-1]
                    new, got = new[ok], got[ok]
                best, score = np.concatenate([best, new]), np.concatenate([score, got])
                if len(best) > 8 * k:
                    ok = score >= np.partition(score, len(score) - k)[len(score) - k]
                    best, score = best[ok], score[ok]
                order = np.lexsort([best, -score])[:k]
                best, score = best[order], score[order]
            depth, step = stop, 2 * step
            edge = np.where(down, self.values[live, n - stop], self.values[live, stop - 1])
            if len(best) == k and edge @ weight < score[-1]:
                break
        return best, score, scored


def searched(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best k of a block of candidates for each query of a block."""
    out = {"query_id": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0, np.int64)]}
    if queries.num_rows and candidates.num_rows:
        q, c = matrix(queries), matrix(candidates)
        kind = scores_kind(c, q)
        lists, q = Lists(candidates.column("vec_id").to_numpy(), c.astype(kind)), q.astype(kind)
        for name, vector in zip(queries.column("vec_id").to_pylist(), q):
            at, score, _ = lists.top(vector, name, k)
            out["query_id"].append(np.full(len(at), name, np.int64))
            out["vec_id"].append(lists.ids[at])
            out["score"].append(score.astype(np.int64))
    return pa.table({n: np.concatenate(v) for n, v in out.items()})


def matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([x.flatten() for x in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each row of vectors (vec_id, embedding) that is_query picks: its k best other rows (RESULT)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False)))
    whole = whole.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"), is_query.alias("asks"))
    n, n_asking = whole.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    n_blocks, n_query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_asking // QUERIES))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    candidates = whole.select("vec_id", "v", F.size("v").alias("dim"), deal(n_blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1))).alias("query_block"))
    queries = whole.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", F.size("v").alias("dim"), deal(n_query_blocks).alias("query_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1))).alias("block"))
    cell = ("dim", "block", "query_block")
    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(lambda q, c: searched(q, c, k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
