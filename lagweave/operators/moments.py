"""Moment matrices: all first and second moments of an embedding in one pass.

Every task adds up its rows with numpy and gives one row for each entry; the entries of all tasks are
summed by key. Linear tests, regressions and their model scores need nothing else, so
thousands of tests cost one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import Node, column


@dataclass
class Moments:
    """Rows, means and centred second moments (population covariance) of some nodes."""

    n: int
    nodes: list[Node]
    mean: np.ndarray
    cov: np.ndarray

    def at(self, nodes: list[Node]) -> np.ndarray:
        return np.array([self.nodes.index(n) for n in nodes], np.int64)

    def part(self, nodes: list[Node]) -> np.ndarray:
        i = self.at(nodes)
        return self.cov[np.ix_(i, i)]


def moments(df: DataFrame, nodes: list[Node], keys: list[str] | None = None) -> dict[tuple, Moments]:
    """Moments of the node columns for each value of keys; rows with a NULL in any node are left out."""
    keys = keys or []
    names = [column(n) for n in nodes]
    df = df.select(*[F.col(k).cast("string").alias(k) for k in keys], *names).dropna(subset=names)
    k = len(nodes)
    shift = np.array(df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).first(), float)

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) - shift
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for v, rows in by_key(batch, keys):
                y = x[rows]
                total[v] = total.get(v, 0) + y.T @ y
        yield packed(total, keys)

    parts = df.mapInArrow(add, packed_schema(keys))
    done = {v: unpacked(n, nodes, m, shift) for v, n, m in summed(parts, keys, k + 1)}
    if not keys and not done:
        done[()] = Moments(0, list(nodes), shift, np.zeros((k, k)))
    return done


def by_key(batch: pa.RecordBatch, keys: list[str]):
    """(values of the keys, their rows), each combination once."""
    if not keys:
        if len(batch):
            yield (), slice(None)
        return
    code = np.zeros(len(batch), np.int64)
    values = []
    for c in keys:
        coded = batch.column(c).dictionary_encode()
        code = code * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        values.append(coded)
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]])) if len(code) else []
    for a, b in zip(start, np.append(start[1:], len(code)) if len(code) else []):
        i = int(order[a])
        yield tuple(v.dictionary[v.indices[i].as_py()].as_py() for v in values), order[a:b]


def packed_schema(keys: list[str]) -> str:
    return "".join(f"{c} string, " for c in keys) + "sums binary"


def packed(total: dict[tuple, np.ndarray], keys: list[str]) -> pa.RecordBatch:
    """One row for each key: the upper triangle of its sums of products."""
    return pa.RecordBatch.from_arrays(
        [*(pa.array([v[n] for v in total], pa.string()) for n in range(len(keys))), pa.array([m[np.triu_indices(len(m))].tobytes() for m in total.values()], pa.binary())], [*keys, "sums"]
    )


def summed(parts: DataFrame, keys: list[str], width: int):
    """(key, rows, centred products as a full matrix) of packed sums: added in groups, then by key; one packed matrix for each key comes back."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(width * (width + 1) // 2)
        for raw in t.column("sums"):
            total += np.frombuffer(raw.as_py())
        return pa.table({c: t.column(c).slice(0, 1) for c in keys} | {"sums": pa.array([total.tobytes()], pa.binary())})

    parts = parts.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(32)))
    for by in ([*keys, "deal"], [*keys, "one"]):
        parts = parts.withColumn("one", F.lit(0)).groupBy(*by).applyInArrow(add, packed_schema(keys)).withColumn("deal", F.lit(0))
    i, j = np.triu_indices(width)
    for r in parts.drop("deal").collect():
        m = np.zeros((width, width))
        m[i, j] = m[j, i] = np.frombuffer(r["sums"])
        if m[0, 0]:
            yield tuple(r[c] for c in keys), m[0, 0], m


def unpacked(n: float, nodes: list[Node], m: np.ndarray, shift: np.ndarray) -> Moments:
    mean = m[0, 1:] / n
    return Moments(round(n), list(nodes), mean + shift, m[1:, 1:] / n - np.outer(mean, mean))


def numbered(df: DataFrame, block: int = 1 << 16) -> DataFrame:
    """df (dataset, t, ...) with `pos`, the row's place in its dataset's order of t, from 0: rows are counted by blocks of times, so that a long series is no single task."""
    from pyspark.sql import Window

    df = df.withColumn("block", F.floor(F.col("t") / block))
    counts = df.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("dataset").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("dataset", "block", before.alias("before"))  # a row for each block
    place = F.row_number().over(Window.partitionBy("dataset", "block").orderBy("t")) - 1
    starts = starts.toDF("of", "block_", "before")
    df = df.withColumn("place", place)
    return df.join(starts, (F.col("dataset") == F.col("of")) & (F.col("block") == F.col("block_"))).drop("of", "block_").withColumn("pos", F.col("place") + F.col("before")).drop("place", "before", "block")


def resampled_moments(df: DataFrame, nodes: list[Node], samples: int, block: int, seed: int = 0, chunk: int = 1 << 13) -> dict[str, Moments]:
    """Moments of block-bootstrap samples of df's rows, by sample number. Rows are not copied: each chunk of them gets the draws that touch it, and
    a sample's sums are those of the chunk's rows, weighted by how often they were drawn."""
    names = [column(n) for n in nodes]
    rows = numbered(df.select("dataset", "t", *names).dropna(subset=names))
    shift = np.array(df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).first(), float)
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("size"))
    draws = sizes.select("dataset", "size", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("run")).select("dataset", "size", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1)).alias("b"))
    draws = draws.select(F.col("dataset").alias("of"), F.col("run").cast("long").alias("run"), F.pmod(F.xxhash64(F.lit(seed), "run", "b", "dataset"), F.greatest(F.lit(1), F.col("size") - block)).alias("start"), F.least(F.lit(block), F.col("size") - F.col("b") * block).cast("long").alias("many"))
    chunk = max(chunk, block)
    first, last = F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("many") - 1) / chunk)
    draws = draws.withColumn("chunk", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / chunk))

    def add(t: pa.Table, d: pa.Table) -> pa.Table:
        total: dict[tuple, np.ndarray] = {}
        if t.num_rows and d.num_rows:
            pos = t.column("pos").to_numpy()
            base = int(t.column("chunk")[0].as_py()) * chunk
            x = np.ones((chunk, len(names) + 1))
            here = np.zeros(chunk)
            here[pos - base] = 1
            x[pos - base, 1:] = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) - shift
            run = d.column("run").to_numpy()
            start = np.clip(d.column("start").to_numpy() - base, 0, chunk)
            stop = np.clip(d.column("start").to_numpy() + d.column("many").to_numpy() - base, 0, chunk)
            order = np.argsort(run, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]]))
            for a, b in zip(edge, np.append(edge[1:], len(run))):
                own = order[a:b]
                w = np.cumsum(np.bincount(start[own], minlength=chunk + 1) - np.bincount(stop[own], minlength=chunk + 1))[:chunk] * here
                total[(str(run[own[0]]),)] = (x * w[:, None]).T @ x
        return pa.Table.from_batches([packed(total, ["run"])])

    parts = rows.groupBy("dataset", "chunk").cogroup(draws.groupBy("of", "chunk")).applyInArrow(add, packed_schema(["run"]))
    return {v[0]: unpacked(n, nodes, m, shift) for v, n, m in summed(parts, ["run"], len(names) + 1)}
