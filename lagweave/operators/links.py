"""Operators on the links table (i, j, tau, val, p): correction, symmetry, graph marks, summaries, sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINKS = "i int, j int, tau int, val double, p double"


def to_links(spark: SparkSession, val: np.ndarray, p: np.ndarray, graph: np.ndarray | None = None) -> DataFrame:
    """Matrices (i, j, tau) as a table, without self links at lag 0."""
    rows = [(int(i), int(j), int(t), float(val[i, j, t]), float(p[i, j, t]), *([str(graph[i, j, t])] if graph is not None else ())) for i, j, t in np.ndindex(val.shape) if (i, t) != (j, 0)]
    return spark.createDataFrame(rows, LINKS + (", link string" if graph is not None else ""))


def fdr(links: DataFrame, by: list[str] | None = None, contemporaneous: bool = False) -> DataFrame:
    """links with q: Benjamini-Hochberg values over all links of a group; self links at lag 0, and lag 0 unless asked for, keep their p."""
    by = by or []
    counted = (F.col("tau") > 0) | (F.lit(contemporaneous) & (F.col("i") != F.col("j")))
    rank = Window.partitionBy(*by, "counted").orderBy("p", "i", "j", "tau")
    down = Window.partitionBy(*by, "counted").orderBy(F.desc("p"), F.desc("i"), F.desc("j"), F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = links.withColumn("counted", counted).withColumn("k", F.row_number().over(rank)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*by, "counted")))
    q = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("k")).over(down))
    return ranked.withColumn("q", F.when(F.col("counted"), q).otherwise(F.col("p"))).drop("counted", "k", "m")


def fdr_values(p: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The same on a matrix."""
    out = p.copy()
    x = p[counted]
    order = np.argsort(x, kind="stable")
    q = np.minimum.accumulate((x[order] * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1]
    y = np.empty(len(x))
    y[order] = np.minimum(q, 1)
    out[counted] = y
    return out


def symmetric(links: DataFrame) -> DataFrame:
    """At lag 0 both directions of a pair take the larger p and its value."""
    pair = Window.partitionBy(F.least("i", "j"), F.greatest("i", "j"), "tau", F.when(F.col("tau") > 0, F.struct("i", "j")))
    best = F.max(F.struct("p", F.abs("val").alias("a"), "i", "val")).over(pair)
    return links.withColumn("b", best).withColumn("val", F.when(F.col("tau") == 0, F.col("b.val")).otherwise(F.col("val"))).withColumn("p", F.when(F.col("tau") == 0, F.col("b.p")).otherwise(F.col("p"))).drop("b")


def marked(links: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    """links with `link`: '-->' for significant lagged links, at lag 0 'o-o' where both directions are, '-->' or '<--' where one is; '' else."""
    back = links.where("tau = 0").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("tau"), (F.col(p) <= alpha).alias("back"))
    here = F.col(p) <= alpha
    link = F.when((F.col("tau") > 0) & here, "-->").when((F.col("tau") == 0) & here & F.col("back"), "o-o").when((F.col("tau") == 0) & here, "-->").when((F.col("tau") == 0) & F.col("back"), "<--").otherwise("")
    return links.join(back, ["i", "j", "tau"], "left").withColumn("link", link).drop("back")


def parents(links: DataFrame, marks: tuple[str, ...] = ("-->",)) -> DataFrame:
    """j with its parents (i, tau), strongest first."""
    own = links.where(F.col("link").isin(*marks))
    return own.groupBy("j").agg(F.sort_array(F.collect_list(F.struct((-F.abs("val")).alias("s"), "tau", "i"))).alias("a")).select("j", F.transform("a", lambda x: F.struct(x["i"].alias("i"), x["tau"].alias("tau"))).alias("parents"))


def summary(runs: DataFrame, level: float = 0.9) -> DataFrame:
    """Of links of many runs (column run): how often each mark stands, the most frequent one (ties: no link, then conflict, then undirected), mean value and interval."""
    n = runs.groupBy("i", "j", "tau", "link").agg(F.count(F.lit(1)).alias("c"))
    order = F.when(F.col("link") == "", 0).when(F.col("link") == "x-x", 1).when(F.col("link") == "o-o", 2).otherwise(3)
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("i", "j", "tau").orderBy(F.desc("c"), order, "link"))).where("r = 1").select("i", "j", "tau", F.col("link"), F.col("c").alias("times"))
    low, high = (1 - level) / 2, (1 + level) / 2
    vals = runs.groupBy("i", "j", "tau").agg(F.count(F.lit(1)).alias("runs"), F.avg("val").alias("mean"), F.percentile("val", F.array(F.lit(low), F.lit(high))).alias("q"))
    return top.join(vals, ["i", "j", "tau"]).select("i", "j", "tau", "link", (F.col("times") / F.col("runs")).alias("frequency"), "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def write_csv(links: DataFrame, path: str, names: list[str] | None = None) -> None:
    """The present links as CSV; a link at lag 0 once."""
    spark = links.sparkSession
    out = links.where("link <> '' and (tau > 0 or i <= j)")
    if names:
        table = spark.createDataFrame(list(enumerate(names)), "k int, name string")
        out = out.join(F.broadcast(table.toDF("i", "ni")), "i").join(F.broadcast(table.toDF("j", "nj")), "j")
    else:
        out = out.withColumns({"ni": F.col("i"), "nj": F.col("j")})
    out.select(F.col("ni").alias("Variable i"), F.col("nj").alias("Variable j"), F.col("tau").alias("Time lag of i"), F.col("link").alias("Link type i --- j"), F.col("val").alias("Link value")).write.option("header", True).csv(path)
