"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, ANSI, adaptive execution."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
    } | more
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def pinned(spark: SparkSession) -> SparkSession:
    """The session with its time zone pinned to UTC: local times are always converted explicitly."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
