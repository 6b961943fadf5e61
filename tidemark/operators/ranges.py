"""Ranges of one ordered column, cut by how many rows they hold: what has no key is spread over them, and exact quantiles read
the rows of a few of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import IntegerType, StructField, StructType

from .names import free_names

ROWS, MOST = 1 << 20, 4096  # rows of a range, about; and ranges at most


def place_in(edges: Column, x: Column, most: int = MOST) -> Column:
    """How many of the ascending edges, `most` at most, are not above x, by bisection."""
    steps = F.array(*(F.lit(1 << k) for k in range(max(most, 1).bit_length() - 1, -1, -1)))
    held = lambda at, s: F.coalesce(F.get(edges, at + s - 1) <= x, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(held(at, s), at + s).otherwise(at))


def range_cuts(df: DataFrame, column: str, rows: int = ROWS) -> list[float]:
    """Ascending cuts of a numeric column into ranges of about `rows` rows, MOST at most; none for a table that is one range."""
    n = df.count()
    ranges = min(MOST, -(-n // rows))
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    return _cuts(df, column, shares, 100 * ranges)


def _cuts(df: DataFrame, column: str, shares: list[float], accuracy: int) -> list[float]:
    x = F.col(column).cast("double")
    found = df.filter(~F.isnan(x)).agg(F.percentile_approx(x, shares, accuracy).alias("cuts")).first().cuts
    return sorted(set(found or []))


def range_of(cuts: list[float]):
    """A bucket function for as-of joins: the range of a time column, given as a number."""
    return lambda x: place_in(F.array(*map(F.lit, cuts)).cast("array<double>"), x.cast("double"), len(cuts)) if cuts else F.lit(0)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """(by, n, q0, q1, …): exact quantiles of the non-null values with linear interpolation, for each group.

    A sketch cuts the whole column into `bins` ranges once, a job of its own; all values are counted by group and range, and only
    the ranges that hold a wanted rank are read again, each distinct value once. So a group's values never meet in one task. The
    cuts are constants: they're not carried by rows, and both readings use the same ones. Groups whose values are all null,
    and empty tables, give no rows; a null group is a group.
    """
    x, n, at, before, held, rank, share, start = free_names([*by, value], "x", "n", "at", "before", "held", "rank", "share", "start")
    rows = df.select(*by, F.col(value).cast("double").alias(x)).filter(F.col(x).isNotNull())
    if not by:
        (one,) = free_names([x], "one")
        return exact_quantiles(df.withColumn(one, F.lit(0)), [one], value, shares, bins).drop(one)
    cuts = _cuts(rows, x, [k / bins for k in range(1, bins)], 10 * bins)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.searchsorted(cuts, batch.column(len(by)).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32())], [*batch.schema.names, at])

    placed = rows.mapInArrow(place, StructType([*rows.schema.fields, StructField(at, IntegerType())]))
    counts = placed.groupBy(*by, at).agg(F.count("*").alias(held))
    upto = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # bins rows at most
    counts = counts.withColumn(before, F.coalesce(F.sum(held).over(upto), F.lit(0))).withColumn(n, F.sum(held).over(Window.partitionBy(*by)))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias(share), (F.lit(p) * (F.col(n) - 1)).alias(rank)) for i, p in enumerate(shares))))
    ranks = counts.select(*by, n, at, before, held, wanted.alias("w_")).select(*by, n, at, before, held, f"w_.{share}", f"w_.{rank}")
    ends = ranks.select(*by, n, at, before, held, share, rank, F.explode(F.array(F.floor(rank), F.ceil(rank))).alias(start)).distinct()
    ends = ends.filter((F.col(start) >= F.col(before)) & (F.col(start) < F.col(before) + F.col(held)))
    inside = placed.join(ends.select(*(F.col(c).alias(f"{c}_e") for c in by), F.col(at).alias("at_e")).distinct(), [*(F.col(c).eqNullSafe(F.col(f"{c}_e")) for c in by), F.col(at) == F.col("at_e")], "left_semi")
    values = inside.groupBy(*by, at, x).agg(F.count("*").alias("times_"))
    within = Window.partitionBy(*by, at).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select(*(F.col(c).alias(f"{c}_v") for c in by), F.col(at).alias("at_v"), x, "times_", F.coalesce(F.sum("times_").over(within), F.lit(0)).alias("less_"))
    found = ends.join(values, [*(F.col(c).eqNullSafe(F.col(f"{c}_v")) for c in by), F.col(at) == F.col("at_v")])
    found = found.filter((F.col(start) - F.col(before) >= F.col("less_")) & (F.col(start) - F.col(before) < F.col("less_") + F.col("times_")))
    low, high = (lambda i: F.max(F.when((F.col(share) == i) & (F.col(start) == F.floor(rank)), F.col(x)))), (lambda i: F.max(F.when((F.col(share) == i) & (F.col(start) == F.ceil(rank)), F.col(x))))
    part = lambda i, p: F.lit(p) * (F.col(n) - 1) - F.floor(F.lit(p) * (F.col(n) - 1))
    ends_of = found.groupBy(*by, n).agg(*(c for i in range(len(shares)) for c in (low(i).alias(f"low_{i}"), high(i).alias(f"high_{i}"))))
    return ends_of.select(*by, F.col(n).alias("n"), *((F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * part(i, p)).alias(f"q{i}") for i, p in enumerate(shares)))


def numbered(df: DataFrame, column: str, ties: list[str], rows: int = ROWS) -> DataFrame:
    """df with `place`, from 0, in the order of a numeric column and of `ties`, which make it total, and with the number of rows as
    `total`. Rows are numbered within ranges of about `rows` rows, to which the sizes of earlier ranges are added; nulls come
    first. Rows of one value are in one range."""
    cut, size = free_names(df.columns, "cut", "size")
    ranged = df.withColumn(cut, F.coalesce(range_of(range_cuts(df, column, rows))(F.col(column)), F.lit(0)))
    sizes = ranged.groupBy(cut).agg(F.count("*").alias(size))  # a row a range
    before = Window.orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(cut, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(size), F.sum(size).over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy(cut).orderBy(column, *ties)) - 1
    return ranged.withColumn("place", own).join(sizes, cut).withColumn("place", F.col("place") + F.col(size)).drop(cut, size)
