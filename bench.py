"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lagweave.operators.embedding import lagged
    from lagweave.operators.moments import moments
    from lagweave.plans.pcmci import Discovery
    from lagweave.queries import QUERIES
    from lagweave.sources.panel import lineitem_days

    def embedding_moments():
        nodes = [(v, -k) for v in range(5) for k in range(7)]
        moments(lagged(lineitem_days(spark, sf_dir), nodes, 6), nodes)

    def bootstrap_100():
        found = Discovery(lineitem_days(spark, sf_dir))
        found.summarised(found.bootstrap("run_pcmci", tau_max=2, samples=100, block=5, seed=1)).collect()

    jobs = {"embedding_moments": embedding_moments, "bootstrap_100": bootstrap_100}
    for name in ("panel_lineitem_days", "lagged_dependencies", "pcmci", "pcmci_plus", "contingency_tests", "sliding_windows", "cmi_nearest_neighbours", "ordinal_patterns", "smooth_gaussian", "mediation", "total_effect", "lpcmci", "jpcmci_plus", "full_conditioning", "uniform_transform", "low_pass"):
        jobs[name] = lambda f=QUERIES[name]: f(spark, sf_dir).collect()
    QUERIES["panel_lineitem_days"](spark, sf_dir).collect()  # starts the workers
    took = {}
    for name, job in jobs.items():
        began = time.perf_counter()
        job()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
