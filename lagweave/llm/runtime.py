"""Where intermediate tables go, how large an input is, and input columns."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lagweave-")
    return _LOCAL[app]


_SCRATCH = threading.local()  # paths, a list for each open `scratch` of a thread
_LOCAL: dict[str, str] = {}


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, so that a lost executor costs one reread. Within `scratch`, tables that aren't named kept-... go at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagweave-{what}-{uuid.uuid4().hex}"
    if getattr(_SCRATCH, "open", None) and not what.startswith("kept-"):
        _SCRATCH.open[-1].append(path)
    df.write.option("compression", compression).option("parquet.block.size", 8 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written within are deleted at its end, be it by an error; nothing lazy that reads them may leave it."""
    _SCRATCH.open = [*getattr(_SCRATCH, "open", []), []]
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of any store that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def few_rows(spark: SparkSession, rows: int):
    """Within, jobs read Parquet and hand rows to Python workers that many at a time, or fewer if the session says so: rows that hold whole sets are large."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in old.items():
            spark.conf.set(k, str(min(rows, int(v)) if int(v) > 0 else rows))
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def volume(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and bytes of a text column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator works on, types fixed; others, and clashing names, stay outside."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
