"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and threads. Every query runs to its last row without collecting it; one small run
before the clock starts takes JVM start-up out of the first number. A query's figure is
the median of three runs, fewer where they take long (``ENOUGH`` seconds together).
``full_report`` is the whole job: cohort, exposures and the four report tables, each
written.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from cohortlens.catalog import QUERIES, run
from cohortlens.plans import freeze_report
from cohortlens.session import build_session
from cohortlens.sources import clear_run, snapshot_folder, standin_tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ENOUGH = 3.0


def timed(job) -> float:
    """Median of up to three runs."""
    runs = []
    while len(runs) < 3 and sum(runs) < ENOUGH:
        begun = time.perf_counter()
        job()
        runs.append(time.perf_counter() - begun)
    return round(median(runs), 3)


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        settings={
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    finish = lambda df: df.write.format("noop").mode("overwrite").save()
    finish(run("cohort", spark, FOLDER))
    whole = lambda: freeze_report(spark, standin_tables(spark, FOLDER), snapshot_folder(spark, "bench"))
    seconds = {name: timed(lambda: finish(run(name, spark, FOLDER))) for name in QUERIES}
    seconds["full_report"] = timed(whole)
    clear_run(spark)
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
