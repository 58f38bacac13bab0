"""Times the headline queries and prints one JSON line.

Each query runs over its whole tables and is written to the no-op sink, so that every
row and column is produced but nothing passes the driver. One unreported conversion
runs first, so that class loading and compilation of a fresh JVM are not charged to
whichever query happens to be the first.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from leafmill.catalog.queries import registered

HEADLINE = (
    "JOB0", "JOB1", "JOB2", "JOB3", "JOB4", "JOB5", "JOB6", "JOB7", "JOB8", "JOB9", "JOB10",
    "JOB12", "AGG4", "AGG10", "WIN1", "WIN2", "WIN5", "SC20", "SRT1", "SRT3", "FLT11",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        # the test tables are one split each; spread them over the cores
        .config("spark.leafmill.readPartitions", cpus)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="leafmill-bench-"))
    known = registered()

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("JOB2")
    names = only.split(",") if only else HEADLINE
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
