"""Sessions for tests, benchmarks and scripts."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; a cluster without that path gets it by
    --py-files or an installation."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the caller brings a session of its own."""
    n = cores or os.cpu_count() or 4
    return reach(
        SparkSession.builder.master(f"local[{n}]")
        .appName("linkloom")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
