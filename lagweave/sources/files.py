"""Readers and sinks beside tables: numeric text, arrays in files, null distributions, printed results. All go through Spark's readers, so any store will do."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import Panel


def read_text(spark: SparkSession, path: str, names: list[str], skip: int = 0, sep: str = r"\s+", missing_flag: float | None = None, first_column: int = 0) -> Panel:
    """Lines of numbers, one for each time, in the order of the file; the first `skip` lines and lines that begin with # are left out, columns before first_column too."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    lines = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")) if not skip else lines.orderBy("place").offset(skip).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split(F.trim("value"), sep)
    df = lines.select("place", *[cells[first_column + k].cast("double").alias(n) for k, n in enumerate(names)])
    return Panel.from_spark(df, "place", names, missing_flag=missing_flag)


def read_npy(spark: SparkSession, path: str, names: list[str] | None = None, missing_flag: float | None = None) -> Panel:
    """A (time, variable) array in numpy's file format, which has to fit the driver."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return Panel.from_arrays(spark, np.load(io.BytesIO(bytes(raw)), allow_pickle=False), names=names, missing_flag=missing_flag)


def write_null_distribution(spark: SparkSession, path: str, values: dict[int, np.ndarray]) -> None:
    """Null samples by sample size (and whatever else the key says), sorted, as a table (n, values)."""
    rows = [(int(n), [float(x) for x in np.sort(v)]) for n, v in values.items()]
    spark.createDataFrame(rows, "n long, values array<double>").write.mode("overwrite").parquet(path)


def read_null_distribution(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    return {r["n"]: np.array(r["values"]) for r in spark.read.parquet(path).collect()}


def described(panel: Panel) -> DataFrame:
    """(variable, n, missing, masked, mean, std, low, high) of each variable, in one pass."""
    parts = []
    for i in range(panel.n):
        c = F.col(f"v{i}")
        parts.append(
            F.struct(
                F.lit(panel.names[i]).alias("variable"),
                F.count(c).alias("n"),
                F.count_if(c.isNull()).alias("missing"),
                (F.count_if(F.col(f"m{i}")) if panel.masked else F.lit(0).cast("long")).alias("masked"),
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"),
                F.min(c).alias("low"),
                F.max(c).alias("high"),
            ).alias(f"s{i}")
        )
    return panel.df.agg(*parts).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(panel.n)])).alias("s")).select("s.*")


def printed(found, names: list[str] | None = None, alpha: float | None = None) -> str:
    """A discovery's links as text, variable by variable, strongest first."""
    n, out = len(found.graph), []
    name = lambda j: names[j] if names else str(j)
    for j in range(n):
        links = sorted(((abs(found.val[i, j, t]), i, t) for i, t in zip(*np.nonzero(found.graph[:, j] != ""))), reverse=True)
        links = [(i, t) for _, i, t in links if alpha is None or found.p[i, j, t] <= alpha]
        out.append(f"Variable {name(j)} has {len(links)} link(s):")
        for i, t in links:
            bounds = "" if getattr(found, "conf", None) is None else f" | interval ({found.conf[i, j, t, 0]:.3f}, {found.conf[i, j, t, 1]:.3f})"
            out.append(f"    ({name(int(i))} {-int(t):d}) {found.graph[i, j, t]}: p = {found.p[i, j, t]:.5f} | value = {found.val[i, j, t]:.3f}{bounds}")
    return "\n".join(out)
