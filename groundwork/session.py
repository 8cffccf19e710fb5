"""Session builder with the settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "groundwork", cores: str | None = None) -> SparkSession:
    """UTC, adaptive execution, as many shuffle partitions as cores in local mode."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
