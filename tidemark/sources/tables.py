"""Scans, sinks, profiles and samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table with a declared schema; an empty frame where there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, low, high, n_distinct (exact) and share of nulls of numeric columns, in one pass over the table."""
    stats = lambda c: F.struct(F.lit(c).alias("name"), F.round(F.min(F.col(c).cast("double")), 4).alias("low"), F.round(F.max(F.col(c).cast("double")), 4).alias("high"), F.count_distinct(c).alias("n_distinct"), F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias("nulls"))
    return df.agg(F.array(*map(stats, columns)).alias("s")).select(F.inline("s"))


def seeded_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows that depend on the seed and the rows alone, whatever the partitions; this is a sampling operator."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_json_payload(df: DataFrame, path: str, key: str) -> None:
    """One JSON object a key with its rows in order; NaN becomes null."""
    clean = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias("rows")).write.mode("overwrite").json(path)


def csv_roundtrip(df: DataFrame) -> DataFrame:
    """df written as gzip CSV to the shared folder spark.checkpoint.dir and read with its own schema. Only where Spark runs in one
    process does a temporary folder of this machine stand in for it."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp()
    path = f"{root.rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(df, path, compress=True)
    return spark.read.schema(df.schema).option("header", True).csv(path)
