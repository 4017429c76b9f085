"""Lag embedding: one row for each anchor time, one column for each (variable, lag) node.

Series are cut into blocks of times; each block also gets the last max_lag rows of the block
before it, so that lags are window functions within (dataset, block): one long series is work for many tasks, and no lag needs a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.sources.panel import Panel

BLOCK = 1 << 16
CUT_OFFS = ("2xtau_max", "max_lag", "tau_max", "max_lag_or_tau_max", "2xtau_max_future")
Node = tuple[int, int]


def column(node: Node) -> str:
    """Name of a node's column: variable and lag."""
    return f"x{node[0]}_{-node[1]}"


def mask_column(node: Node) -> str:
    return f"w{node[0]}_{-node[1]}"


def lagged(panel: Panel, nodes: Iterable[Node], first: int, masks: bool = False, block: int = BLOCK) -> DataFrame:
    """Columns dataset, t, shared and one for each node, for the times from `first` on; NULL where a value is missing or out of range."""
    nodes = sorted(set(nodes))
    deep = max([first, *(-lag for _, lag in nodes)], default=0)
    block = max(block, deep + 1)
    df = panel.with_shared_time()
    if not any(lag for _, lag in nodes):  # nothing to look back to
        columns = [F.col(f"v{v}").alias(column((v, 0))) for v, _ in nodes]
        if masks and panel.masked:
            columns += [F.coalesce(F.col(f"m{v}"), F.lit(True)).alias(mask_column((v, 0))) for v, _ in nodes]
        return _anchored(panel, df.where(F.col("t") >= first).select("dataset", "t", "shared", *columns))
    own = F.floor(F.col("t") / block)
    at = F.when(F.col("t") % block >= block - deep, F.array(own, own + 1)).otherwise(F.array(own)) if deep else F.array(own)
    df = df.withColumn("block", F.explode(at))
    w = Window.partitionBy("dataset", "block").orderBy("t")

    def back(name: str, k: int) -> Column:
        if not k:
            return F.col(name)
        return F.lag(name, k).over(w)

    columns = [back(f"v{v}", -lag).alias(column((v, lag))) for v, lag in nodes]
    if masks and panel.masked:
        columns += [F.coalesce(back(f"m{v}", -lag), F.lit(True)).alias(mask_column((v, lag))) for v, lag in nodes]
    out = df.select("dataset", "t", "shared", (F.col("block") == own).alias("own"), *columns).where(F.col("own") & (F.col("t") >= first)).drop("own")
    return _anchored(panel, out)


def _anchored(panel: Panel, df: DataFrame) -> DataFrame:
    """Only the reference points, if the panel has some; Spark decides by their number how to join."""
    if panel.anchors is None:
        return df
    return df.join(df.sparkSession.createDataFrame([(int(a),) for a in panel.anchors], "shared long"), "shared", "left_semi")


@dataclass
class Sample:
    """A sample's rows: columns dataset, t and one for each node; nodes by role."""

    df: DataFrame
    x: list[Node]
    y: list[Node]
    z: list[Node]
    extra: list[Node]

    @property
    def nodes(self) -> list[Node]:
        return [*self.x, *self.y, *self.z, *self.extra]


def roles(panel: Panel, x, y, z=(), extra=()) -> tuple[list[Node], list[Node], list[Node], list[Node]]:
    """Expanded nodes by role, each once, kept in the first role that names it."""
    out, seen = [], set()
    for part in (x, y):
        nodes = list(dict.fromkeys(n for node in part for n in panel.expanded(node)))
        out.append(nodes)
    seen = {*out[0], *out[1]}
    for part in (z, extra):
        nodes = [n for n in dict.fromkeys(n for node in part for n in panel.expanded(node)) if n not in seen]
        seen |= set(nodes)
        out.append(nodes)
    return tuple(out)


def first_time(cut_off: str, deepest: int, tau_max: int) -> int:
    if cut_off not in CUT_OFFS:
        raise ValueError(f"cut_off is one of {CUT_OFFS}")
    return {"2xtau_max": 2 * tau_max, "tau_max": tau_max, "max_lag_or_tau_max": max(deepest, tau_max)}.get(cut_off, deepest)


def sample(panel: Panel, x, y, z=(), extra=(), tau_max: int = 0, cut_off: str = "2xtau_max", mask_type: str | None = None, spread_missing: bool = False) -> Sample:
    """The sample of a conditional-independence question: rows without missing values, and unmasked in the roles that mask_type names.

    With spread_missing a row with a missing value also drops the next max_lag rows of its dataset.
    """
    x, y, z, extra = roles(panel, x, y, z, extra)
    nodes = [*x, *y, *z, *extra]
    deepest = max(-lag for _, lag in nodes)
    if cut_off in ("2xtau_max", "tau_max") and deepest > first_time(cut_off, deepest, tau_max):
        raise ValueError("a lag goes beyond the cut-off")
    first = first_time(cut_off, deepest, tau_max)
    df = lagged(panel, nodes, first, masks=mask_type is not None)
    if cut_off == "2xtau_max_future":
        last = Window.partitionBy("dataset")
        df = df.withColumn("last", F.max("t").over(last)).where(F.col("t") <= F.col("last") - max(0, 2 * tau_max - deepest)).drop("last")
    missing = F.lit(False)
    for n in nodes:
        missing = missing | F.col(column(n)).isNull()
    if spread_missing:
        near = Window.partitionBy("dataset").orderBy("t").rowsBetween(-deepest, 0)
        df = df.withColumn("gone", F.max(missing.cast("int")).over(near)).where("gone = 0").drop("gone")
    else:
        df = df.where(~missing)
    if mask_type is not None and panel.masked:
        if not set(mask_type) <= set("xyz"):
            raise ValueError("mask_type holds the letters x, y and z")
        for role, part in (("x", x), ("y", y), ("z", z)):
            if role in mask_type:
                for n in part:
                    df = df.where(~F.col(mask_column(n)))
    return Sample(df.select("dataset", "t", *[column(n) for n in nodes]), x, y, z, extra)
