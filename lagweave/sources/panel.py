"""Time-indexed panels: several datasets of the same variables, with masks and missing values.

A panel is one wide DataFrame: dataset STRING, t BIGINT (0, 1, ... within a dataset), v0..vN-1 DOUBLE
(NULL: missing), and, if there is a mask, m0..mN-1 BOOLEAN (true: masked).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Panel:
    df: DataFrame
    names: list[str]
    masked: bool = False
    vectors: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    offsets: dict[str, int] = field(default_factory=dict)
    anchors: list[int] | None = None
    #: Variables whose values are categories; tests for mixed data ask for them.
    discrete: frozenset[int] = frozenset()

    @property
    def n(self) -> int:
        return len(self.names)

    @classmethod
    def from_spark(
        cls,
        df: DataFrame,
        time: str,
        variables: Sequence[str],
        dataset: str | None = None,
        masks: Sequence[str] | None = None,
        missing_flag: float | None = None,
        gapless: bool = False,
        vectors: dict[int, list[tuple[int, int]]] | None = None,
        offsets: dict[str, int] | None = None,
        anchors: Sequence[int] | None = None,
        discrete: Sequence[str] = (),
    ) -> Panel:
        """Rows of df as a panel. With gapless, `time` already counts 0, 1, ... in each dataset and no sort is needed; else rows are numbered in its order."""
        key = F.col(dataset).cast("string") if dataset else F.lit("0")
        t = F.col(time).cast("long") if gapless else (F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1).cast("long")
        value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float(missing_flag))) if missing_flag is not None else F.col(c).cast("double")
        columns = [key.alias("dataset"), t.alias("t"), *(value(c).alias(f"v{i}") for i, c in enumerate(variables))]
        if masks:
            if len(masks) != len(variables):
                raise ValueError("one mask column for each variable")
            columns += [F.coalesce(F.col(c).cast("int") != 0, F.lit(False)).alias(f"m{i}") for i, c in enumerate(masks)]
        offsets = dict(offsets or {})
        if offsets and (min(offsets.values()) < 0 or 0 not in offsets.values()):
            raise ValueError("time offsets are not negative, and one of them is 0")
        return cls(df.select(*columns), list(variables), bool(masks), dict(vectors or {}), offsets, sorted(set(anchors)) if anchors is not None else None, frozenset(list(variables).index(c) for c in discrete))

    @classmethod
    def from_arrays(cls, spark: SparkSession, data: np.ndarray | dict[str, np.ndarray], mask: np.ndarray | dict | None = None, names: Sequence[str] | None = None, missing_flag: float | None = None) -> Panel:
        """Small arrays (time, variable), one or by dataset, as a panel; NaN is not allowed, use missing_flag."""
        sets = data if isinstance(data, dict) else {"0": data}
        masks = mask if isinstance(mask, dict) else ({"0": mask} if mask is not None else None)
        width = {x.shape[1] for x in sets.values()}
        if len(width) != 1:
            raise ValueError("all datasets have the same variables")
        n, rows = width.pop(), []
        for key, x in sets.items():
            if np.isnan(x).any():
                raise ValueError("NaN in data; give missing values as missing_flag")
            m = masks[key] if masks else None
            if m is not None and (m.shape != x.shape or not np.isin(m, (0, 1)).all()):
                raise ValueError("a mask has the data's shape and holds 0 and 1")
            for t in range(len(x)):
                rows.append((str(key), t, *map(float, x[t]), *(map(bool, m[t]) if m is not None else ())))
        schema = "dataset string, t long, " + ", ".join(f"v{i} double" for i in range(n)) + ("".join(f", m{i} boolean" for i in range(n)) if masks else "")
        df = spark.createDataFrame(rows, schema)
        if missing_flag is not None:
            df = df.withColumns({f"v{i}": F.nullif(f"v{i}", F.lit(float(missing_flag))) for i in range(n)})
        return cls(df, [str(x) for x in (names or range(n))], bool(masks))

    def check(self) -> None:
        """Raises on NaN or infinite values; missing values are NULL."""
        bad = self.df.agg(*[F.count_if(F.isnan(f"v{i}") | (F.abs(f"v{i}") == float("inf"))).alias(f"v{i}") for i in range(self.n)]).first()
        if any(bad):
            raise ValueError(f"NaN or infinite values: {bad.asDict()}")

    def expanded(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        """A node's components: itself, or those of its vector variable, shifted."""
        var, lag = node
        if lag > 0:
            raise ValueError(f"lags are not positive: {node}")
        if var in self.vectors:
            return [(v, lag + k) for v, k in self.vectors[var]]
        if not 0 <= var < self.n:
            raise ValueError(f"no variable {var}")
        return [(var, lag)]

    def with_shared_time(self) -> DataFrame:
        """df with `shared`: the time on the axis that all datasets share."""
        if not self.offsets:
            return self.df.withColumn("shared", F.col("t"))
        table = F.create_map(*[F.lit(x) for kv in self.offsets.items() for x in kv])
        return self.df.withColumn("shared", F.col("t") + F.coalesce(table[F.col("dataset")], F.lit(0)))


def on_spine(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sums, a row for each whole number `at` (and by), with a row for every number from the least to the largest, counted by `t` from 0; rows without `at` are left out."""
    ends = sums.agg(F.min("at").cast("long").alias("first"), F.max("at").cast("long").alias("last")).where("first is not null")
    whole = ends.select("first", F.explode(F.sequence("first", "last")).alias("at"))
    if by:
        whole = sums.select(*by).distinct().crossJoin(F.broadcast(ends)).select(*by, "first", F.explode(F.sequence("first", "last")).alias("at"))  # ends is one row
    return whole.join(sums, [*by, "at"], "left").withColumn("t", F.col("at") - F.col("first")).drop("at", "first")


def event_days(spark: SparkSession, sf_dir: str) -> Panel:
    """Events of each type a day, from the first day to the last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = events.groupBy(F.unix_date(F.to_date("ts")).alias("at")).agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    df = on_spine(counts).select("t", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in kinds])
    return Panel.from_spark(df, "t", kinds, gapless=True)


def event_hours(spark: SparkSession, sf_dir: str) -> Panel:
    """Mean value of each event type an hour, NULL where there is none, from the first day's first hour to the last day's last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = ["click", "error", "purchase", "signup", "view"]
    means = events.groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("at")).agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])
    ends = means.agg(F.min("at").alias("first"), F.max("at").alias("last")).select(F.explode(F.array(F.floor(F.col("first") / 24) * 24, F.floor(F.col("last") / 24) * 24 + 23)).alias("at"))
    whole = means.join(ends, "at", "full")  # the ends of the first and last day, should they have no events
    return Panel.from_spark(on_spine(whole), "t", kinds, gapless=True)


def lineitem_days(spark: SparkSession, sf_dir: str) -> Panel:
    """Line items a ship day: quantity, revenue, and lines of each return flag; days without lines count 0."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = items.groupBy(F.unix_date(F.to_date("l_shipdate")).alias("at")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        *[F.count_if(F.col("l_returnflag") == f).cast("double").alias(f"flag_{f}") for f in "ANR"],
    )
    names = ["quantity", "revenue", "flag_A", "flag_N", "flag_R"]
    df = on_spine(sums).select("t", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    return Panel.from_spark(df, "t", names, gapless=True)


def order_weeks(spark: SparkSession, sf_dir: str) -> Panel:
    """Orders in every seven days from the first order on, by market segment (a dataset each): their number, price, and those of urgent priority; weeks without orders count 0."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    start = F.broadcast(orders.agg(F.min(F.to_date("o_orderdate")).alias("start")))  # one row
    week = F.floor(F.datediff(F.to_date("o_orderdate"), F.col("start")) / 7).alias("at")
    sums = orders.crossJoin(start).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), week).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("price"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent")
    )
    names = ["orders", "price", "urgent"]
    df = on_spine(sums, ["segment"]).select("segment", "t", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    return Panel.from_spark(df, "t", names, dataset="segment", gapless=True)
