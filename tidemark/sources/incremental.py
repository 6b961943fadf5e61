"""Incremental merges: high-water marks, overlap, last copy kept, replacement by renaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.names import free_names
from tidemark.operators.series import keep_last


def since_marks(stored: DataFrame, arriving: DataFrame, key: str, ts: str, hours: int = 1) -> DataFrame:
    """Arriving rows from `hours` before the newest stored row of their key on; all rows of new keys."""
    (since,) = free_names(arriving.columns, "since")
    marks = stored.groupBy(key).agg(F.timestamp_add("HOUR", F.lit(-hours), F.max(ts)).alias(since))
    return arriving.join(marks, key, "left").filter(F.col(since).isNull() | (F.col(ts) >= F.col(since))).drop(since)


def unsettled(listing: DataFrame, stored: DataFrame, key: str, settled: Column) -> DataFrame:
    """Keys still to fetch: those that aren't both settled and stored."""
    return listing.filter(~settled).unionByName(listing.filter(settled).join(stored.select(key).distinct(), key, "left_anti"))


def merge(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both tables by name; of rows with equal keys the last by `order` stays."""
    return keep_last(stored.unionByName(arriving, allowMissingColumns=True), keys, [c.desc() for c in order])


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps the folders by two renames: readers never see half of a table, but between the renames
    they see none, and a store that renames by copying takes as long as the copy."""
    spark: SparkSession = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    existed = files.exists(at(path))
    if existed:
        files.rename(at(path), at(old))
    files.rename(at(fresh), at(path))
    if existed:
        files.delete(at(old), True)
