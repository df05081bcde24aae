"""A local session with the settings the tests and the bench use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, memory: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("stemma")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory or os.environ.get("BENCH_DRIVER_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
