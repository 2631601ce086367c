"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tabulon.plans import catalog

#: The longest-running kinds of query; each result is counted through Spark's no-op sink, which reads every column.
HEADLINE = [
    "search_any_contains",
    "search_col_contains",
    "predicate_set_combined",
    "sort_numeric_asc",
    "page_n",
    "distinct_capped",
    "column_stats_numeric",
    "diff_entries",
    "overlay_resolve",
    "export_csv_lines",
    "dif_bulk_section",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    made, took = catalog.queries(), {}
    for name in HEADLINE:
        best = []
        for _ in range(RUNS):
            start = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        took[name] = round(min(best), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
