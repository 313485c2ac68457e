"""Runs a job and writes its tables as Parquet: python -m orbweave.plans JOB INPUT OUTPUT [MANIFEST [MAX_FILES]]."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from orbweave.operators.features import session_bin_index
from orbweave.plans import jobs


def main(job: str, source: str, target: str, manifest: str = "", max_files: str = "") -> None:
    """``manifest`` (CSV with relative_path) and ``max_files`` restrict the logs of the job ``tables``."""
    spark = SparkSession.builder.appName(f"orbweave-{job}").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    if job == "tables":
        tables = jobs.build_tables(spark, source, manifest=spark.read.csv(manifest, header=True) if manifest else None, max_files=int(max_files) if max_files else None)
    elif job == "forecasts":
        tables = jobs.evaluate_forecasts(jobs.materialise(jobs.graph_table(spark.read.parquet(source)), "graph-table"))
    elif job == "robustness":
        tables = jobs.robustness_tables(session_bin_index(spark.read.parquet(source)))
    elif job == "ablation":
        tables = jobs.ablation_tables(session_bin_index(spark.read.parquet(source)))
    else:
        raise SystemExit(jobs.__doc__)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")


if __name__ == "__main__":
    main(*sys.argv[1:6]) if len(sys.argv) > 3 else print(jobs.__doc__)
