"""Scalar functions of the domain, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

ET = "America/New_York"


def local_date(ts: Column, zone: str = ET) -> Column:
    """Calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_instant(day: Column, hour: int | Column, zone: str = ET) -> Column:
    """UTC instant of an hour of a local day."""
    hour = F.lit(hour) if isinstance(hour, int) else hour
    return F.to_utc_timestamp(F.timestamp_add("HOUR", hour, day.cast("timestamp")), zone)


def edges(step: float) -> list[float]:
    """Bin edges: multiples of the step, with 1 cent and 99 cents as edges of their own."""
    n = round(1 / step)
    return sorted({round(k * step, 9) for k in range(n + 1)} | {0.01, 0.99, 1.0})


def bin_floor(p: Column, step: float) -> Column:
    """Lower edge of the bin of a probability; the last bin holds 1."""
    inner = edges(step)[:-1]
    at = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= F.round(p, 9)))
    return F.when(p.isNotNull() & (at > 0), F.try_element_at(F.array(*map(F.lit, inner)), at))


def bin_label(low: Column, step: float) -> Column:
    all_edges = edges(step)
    upper = F.create_map(*[x for a, b in zip(all_edges, all_edges[1:]) for x in (F.lit(f"{a:.4f}"), F.lit(b))])  # noqa: B905, RUF007
    return F.format_string("[%.2f, %.2f)", low, F.try_element_at(upper, F.format_string("%.4f", low)))


def cut(x: Column, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed intervals; at or below the first bound or above the last: null."""
    out = F.when(x <= bounds[0], None)
    for b, label in zip(bounds[1:], labels, strict=True):
        out = out.when(x <= b, label)
    return out


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within bounds; null stays null, though least and greatest skip nulls."""
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column) -> Column:
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def chi2_tail_even(w: Column, df: int) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom, in closed form."""
    half = w / 2
    return F.exp(-half) * sum((F.pow(half, F.lit(k)) / math.factorial(k) for k in range(df // 2)), F.lit(0.0))


def bucket_probability(x: Column, low: Column, high: Column) -> Column:
    """Mass of a value split over its two nearest whole steps that falls into [low, high]."""
    floor = F.floor(x)
    fraction = x - floor
    return F.when(floor.between(low, high), 1 - fraction).otherwise(0.0) + F.when((floor + 1).between(low, high), fraction).otherwise(0.0)


def isotonic_decreasing(points: Column) -> Column:
    """Weighted non-increasing least-squares fit of an array of {x, p, w} in order, by pooling: one fold of 2n steps over a stack
    of blocks, each of which merges the last two blocks if they rise, and else takes the next point."""
    n = F.size(points)
    block = lambda s, w, k: F.struct(s.alias("s"), w.alias("w"), k.alias("k"))
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<s:double,w:double,k:int>>").alias("blocks"))

    def step(acc: Column, _: Column) -> Column:
        blocks, i = acc["blocks"], acc["i"]
        held = F.size(blocks)
        last, above = F.get(blocks, held - 1), F.get(blocks, held - 2)
        rises = F.coalesce((held > 1) & (above["s"] / above["w"] < last["s"] / last["w"]), F.lit(False))
        merged = F.concat(F.slice(blocks, 1, F.greatest(held - 2, F.lit(0))), F.array(block(above["s"] + last["s"], above["w"] + last["w"], above["k"] + last["k"])))
        point = F.get(points, i)
        pushed = F.concat(blocks, F.array(block(point["p"].cast("double") * point["w"], point["w"].cast("double"), F.lit(1))))
        more = F.struct((i + 1).alias("i"), pushed.alias("blocks"))
        return F.when(rises, F.struct(i.alias("i"), merged.alias("blocks"))).when(i < n, more).otherwise(acc)

    pooled = F.aggregate(F.sequence(F.lit(1), 2 * F.greatest(n, F.lit(1))), start, step, lambda acc: acc["blocks"])
    return F.flatten(F.transform(pooled, lambda b: F.array_repeat(b["s"] / b["w"], b["k"])))


#: A rational approximation of the complementary error function, right to 1.2e-7 of its value everywhere.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    t = 1 / (1 + F.abs(x) / 2)
    power = F.lit(0.0)
    for c in reversed(_ERFC):
        power = power * t + c
    upper = t * F.exp(power - x * x)
    return F.when(x >= 0, upper).otherwise(2 - upper)


def erfc_sql(x: str) -> str:
    power = "0.0"
    for c in reversed(_ERFC):
        power = f"({power} * t + {c})"
    return f"(SELECT CASE WHEN x >= 0 THEN u ELSE 2 - u END FROM (SELECT x, t * exp({power} - x * x) AS u FROM (SELECT x, 1 / (1 + abs(x) / 2) AS t FROM (SELECT {x} AS x))))"


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a z statistic."""
    return erfc(F.abs(z) / math.sqrt(2))


def one_sided_p(z: Column) -> Column:
    """Chance of a larger z."""
    return erfc(z / math.sqrt(2)) / 2
