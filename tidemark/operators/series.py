"""Time series: grids, fills, durations, rolling statistics, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .names import free_names


def day_sequence(start: Column, stop: Column) -> Column:
    """Days from start to stop; none where stop comes first or either is null."""
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<date>"))


def forward_fill(x: str, window: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def backward_fill(x: str, window: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(window.rowsBetween(Window.currentRow, Window.unboundedFollowing))


def rolling_median(x: str, window: WindowSpec, n: int, least: int) -> Column:
    """Median of the non-null values of the last n rows; null with fewer than `least` of them."""
    held = F.array_sort(F.collect_list(x).over(window.rowsBetween(-(n - 1), Window.currentRow)))
    size = F.size(held)
    low, high = F.try_element_at(held, F.floor((size + 1) / 2).cast("int")), F.try_element_at(held, F.floor(size / 2 + 1).cast("int"))
    return F.when(size >= least, (low + high) / 2)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by `order`, which must be total for a stated result."""
    window = Window.partitionBy(*keys).orderBy(*order)
    (place,) = free_names(df.columns, "place")
    return df.withColumn(place, F.row_number().over(window)).filter(F.col(place) == 1).drop(place)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: that with the greatest `order`, columns that must be total for a stated result. An aggregation, so
    each task passes on one row of a key and a hot key's rows never meet. Rows that are null in `order` come before all others."""
    (row,) = free_names(df.columns, "row")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias(row)).select(f"{row}.*")


def durations(states: DataFrame, key: str, ts: str, end: Column, start: Column | None = None) -> DataFrame:
    """Adds `seconds` for which each state is in force: until the next of its key or `end`, clipped to `start` and `end`."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    since, until = free_names([*states.columns, "seconds"], "since", "until")
    rows = states.withColumn(until, F.least(F.coalesce(following, end), end)).withColumn(since, F.col(ts) if start is None else F.greatest(F.col(ts), start))
    return rows.filter(F.col(until) > F.col(since)).withColumn("seconds", (F.unix_micros(until) - F.unix_micros(since)) / 1e6).drop(since, until)


def drop_repeats(df: DataFrame, columns: list[str], order: str, by: list[str] = ()) -> DataFrame:
    """Drops rows whose columns all equal the row before; the first row, which has none before, is dropped as well."""
    window = Window.partitionBy(*by).orderBy(order)
    moved = sum((F.coalesce(F.abs(F.col(c) - F.lag(c).over(window)), F.lit(0.0)) for c in columns), F.lit(0.0))
    (changed,) = free_names(df.columns, "changed")
    return df.withColumn(changed, moved).filter(F.col(changed) != 0).drop(changed)
