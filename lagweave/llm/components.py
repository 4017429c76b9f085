"""Connected components of a large graph: contraction within tasks, then alternating large-star and small-star steps.

Each task first joins the edges it holds by union-find and gives every vertex a link to the least one it found; edges are dealt out so that a task has a
bounded number. What spans tasks is settled by star steps, which aggregate minima per vertex, never neighbour lists,
so a vertex with many neighbours is no unbounded group. Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Edges that a task joins at a time.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) for all vertices of edges (a, b): label is the least vertex that can be reached."""
    now = written(_directed(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))), "edges")
    many = now.count()
    now = written(_directed(now.repartition(max(1, -(-many // EDGES)), F.xxhash64("v")).mapInArrow(_contracted, "u long, v long")), "edges")
    state = _state(now) if many > EDGES else None
    while many > EDGES:  # up to so many, one task has joined them all
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _directed(large.unionAll(least.select("u", F.col("m").alias("v"))))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = written(_directed(small.unionAll(down.select("u", F.col("m").alias("v")))), "edges")
        after = _state(fresh)
        now = fresh
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())


def _contracted(batches):
    """Star edges (vertex, least vertex) of the components of a task's edges, EDGES at a time."""
    held, rows = [], 0  # a task that was dealt more than EDGES gives stars of each portion

    def stars():
        u, v = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1))
        names, code = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = code[: len(u)], code[len(u) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[a], label[b])
            fresh = label.copy()
            np.minimum.at(fresh, label[a], low)
            np.minimum.at(fresh, label[b], low)
            while (fresh[fresh] != fresh).any():
                fresh = fresh[fresh]
            fresh = fresh[label]
            if (fresh == label).all():
                break
            label = fresh
        moved = label != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[moved], pa.int64()), pa.array(names[label[moved]], pa.int64())], ["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= EDGES:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller vertex."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return tuple(row)
