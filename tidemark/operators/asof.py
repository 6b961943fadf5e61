"""As-of joins as a union and a window: linear after one sort, on the keys' own partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .names import free_names


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, *, strict: bool = False, how: str = "inner", bucket: Column | None = None, order: list[str] = ()) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time (strict: before).

    The latest row is taken whole: nulls inside it stay null. A right column named like a left one is an error; `by` names are
    shared. Rows with a null key or time match nothing. Of right rows at one time, the last by `order` wins. With how="left",
    rows without a match keep nulls. bucket: a function of a time column, such as its day; then windows run within (keys, bucket) and the last right
    row of earlier buckets is carried in, so one hot key is spread over its buckets.
    """
    names = _right_names(left, right, by)
    right = right.filter(_known([*by, right_on]))
    unmatched, left = left.filter(~_known([*by, left_on])), left.filter(_known([*by, left_on]))
    t, side, l, r, m, b, before_in = free_names(by, "t", "side", "l", "r", "m", "b", "before")
    empty_l = F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType)
    empty_r = F.lit(None).cast(right.select(F.struct(*names).alias("x")).schema["x"].dataType)
    tie = [F.col(c) for c in order]
    lefts = left.select(*by, F.col(left_on).alias(t), F.lit(0 if strict else 1).alias(side), F.struct(*left.columns).alias(l), empty_r.alias(r))
    rights = right.select(*by, F.col(right_on).alias(t), F.lit(1 if strict else 0).alias(side), empty_l.alias(l), F.struct(*names).alias(r))
    rows = lefts.unionByName(rights)
    at = [F.col(t), F.col(side), *(F.col(f"{r}.{c}") for c in order)] if tie else [F.col(t), F.col(side)]
    if bucket is None:
        window = Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(m, F.last(r, ignorenulls=True).over(window))
    else:
        rows = rows.withColumn(b, bucket(F.col(t)))
        window = Window.partitionBy(*by, b).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        newest = F.struct(t, *(F.col(f"{r}.{c}") for c in order))
        lasts = rows.groupBy(*by, b).agg(F.max_by(r, F.when(F.col(r).isNotNull(), newest)).alias(before_in))
        before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        carried = lasts.select(*by, b, F.last(before_in, ignorenulls=True).over(before).alias(before_in))
        rows = rows.withColumn(m, F.last(r, ignorenulls=True).over(window)).join(carried, [*by, b]).withColumn(m, F.coalesce(m, before_in))
    rows = rows.filter(f"{l} is not null")
    if how == "inner":
        rows = rows.filter(f"{m} is not null")
    found = rows.select(f"{l}.*", *(F.col(f"{m}.{c}").alias(c) for c in names))
    return found if how == "inner" else found.unionByName(unmatched, allowMissingColumns=True)


def _known(columns: list[str]) -> Column:
    return F.forall(F.array(*(F.col(c).isNotNull() for c in columns)), lambda x: x)


def _right_names(left: DataFrame, right: DataFrame, by: list[str]) -> list[str]:
    """The right columns that join the left ones."""
    names = [c for c in right.columns if c not in by]
    held = {c.lower() for c in left.columns}
    if clash := [c for c in names if c.lower() in held]:
        raise ValueError(f"rename the right columns {clash}: the left side has them too")
    return names


def asof_small(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, *, forward: bool = False, strict: bool = False, how: str = "inner") -> DataFrame:
    """The same by an equi-join and max_by (min_by for the next row after), for a left side of a few rows a key. Rows with a
    null key or time match nothing here either."""
    compare = {(False, False): "<=", (False, True): "<", (True, False): ">=", (True, True): ">"}[forward, strict]
    names = _right_names(left, right, by)
    row, m = free_names([*left.columns, *right.columns], "row", "m")
    tagged = left.withColumn(row, F.monotonically_increasing_id())
    inside = F.expr(f"{right_on} {compare} {left_on}")
    joined = tagged.join(right, by, "left") if by else tagged.join(right, F.lit(True), "left")
    pick = F.min_by if forward else F.max_by
    found = joined.groupBy(row, *left.columns).agg(pick(F.when(inside, F.struct(*names)), F.when(inside, F.col(right_on))).alias(m))
    if how == "inner":
        found = found.filter(f"{m} is not null")
    return found.select(*left.columns, *(F.col(f"{m}.{c}").alias(c) for c in names))


def asof_nearest(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance_days: int) -> DataFrame:
    """Each left row (of date left_on) with the right row nearest in days, the earlier of equals, within the tolerance.

    Days are equi-joined after spreading each right row over the days it may serve, so no pair beyond the tolerance is made.
    """
    row, day, m = free_names([*left.columns, *right.columns], "row", "day", "m")
    tagged = left.withColumn(row, F.monotonically_increasing_id())
    spread = right.withColumn(day, F.explode(F.sequence(F.date_sub(right_on, tolerance_days), F.date_add(right_on, tolerance_days))))
    gap = F.abs(F.datediff(right_on, left_on))
    found = tagged.join(spread, F.col(day) == F.col(left_on)).groupBy(row, *left.columns).agg(F.min_by(F.struct(*right.columns), F.struct(gap, F.col(right_on))).alias(m))
    return found.select(*left.columns, *(F.col(f"{m}.{c}").alias(c) for c in right.columns))
