import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lagweave.streaming.live_moments import add_moments, binned

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["i", "j", "tau", "link", "val", "p"] and got.count() == 95


@pytest.mark.parametrize("name", ["sample_missing_spread", "smooth_gaussian", "ordinal_patterns", "quantile_bins", "false_discovery_rate", "ancestors", "contingency_tests", "moment_matrix", "full_conditioning", "mediation", "weighted_partial_correlation", "multivariate_correlation", "low_pass", "correlation_given_dataset", "natural_effects_linear", "graph_facts"])
def test_against_sql(spark, name):
    import duckdb

    with duckdb.connect() as con:
        for t in ("nation", "events", "lineitem", "orders", "customer"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    want, got = (x.sort_values(order).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) and all((want[c] == got[c]).all() or np.allclose(want[c], got[c], atol=1e-6) for c in order)


def test_streaming(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = binned(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()
    store: dict = {}
    done = stream.writeStream.foreachBatch(lambda df, k: add_moments(store, df.select("value"), ["value"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination()
    r = events.agg(F.sum("value"), F.sum(F.col("value") ** 2)).first()
    assert np.isclose(store["value",], r[0]) and np.isclose(store["value", "value"], r[1])
