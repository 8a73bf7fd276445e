"""Session and row comparison for tests and tools."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("toposcope")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normalised_rows(columns: list[str], rows: list) -> list[tuple]:
    """Rows with columns in name order, sorted by their text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v: object) -> object:
        return float(v) if isinstance(v, float) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)
