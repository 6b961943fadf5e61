"""Data-quality assertions in the plan: counted, or enforced so that a failing row stops whatever reads the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def broken(condition: Column) -> Column:
    """A condition that is false or null doesn't hold."""
    return ~F.coalesce(condition, F.lit(False))


def failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, failures): how many rows break each check, all in one pass."""
    counted = df.agg(*(F.count_if(broken(c)).alias(f"c{k}") for k, c in enumerate(checks.values())))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("failures")) for k, name in enumerate(checks)))))


def enforced(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df as it is, if every row passes; reading a row that doesn't is an error that names the check, so no table is written
    from it. Catalyst keeps such a filter, as it may raise."""
    message = F.coalesce(*(F.when(broken(c), F.lit(f"check failed: {name}")) for name, c in checks.items()))
    return df.filter(F.when(message.isNotNull(), F.raise_error(message).isNull()).otherwise(True))
