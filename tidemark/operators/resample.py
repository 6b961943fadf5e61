"""Cluster bootstrap over tables: multiplicities from counters, totals of every draw by one aggregation.

Draw d of a group of G clusters takes G of them with replacement: its pick number i is the cluster whose number is the hash of
(seed, d, i) modulo G. So a draw needs no state, any executor can make it again, and SQL gives the same draws.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .names import free_names

DRAWS, SEED = 999, 0


def pick(seed: int, draw: Column, place: Column, clusters: Column) -> Column:
    """The first 32 bits of an md5, modulo the number of clusters."""
    text = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % clusters


def pick_sql(seed: int, draw: str, place: str, clusters: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {draw} || ':' || {place}), 1, 8))::BIGINT % {clusters}"


def multiplicities(clusters: int, draws: int = DRAWS, seed: int = SEED) -> np.ndarray:
    """The same picks in numpy: how often each draw has each cluster number."""
    out = np.zeros((draws, clusters), np.int64)
    for d in range(draws):
        for i in range(clusters):
            out[d, int(hashlib.md5(f"{seed}:{d}:{i}".encode()).hexdigest()[:8], 16) % clusters] += 1
    return out


def numbered_clusters(sums: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """sums, a row for each cluster, with its number from 0 within its group and how many the group has."""
    number, held = free_names(sums.columns, "number", "held")
    whole = Window.partitionBy(*by)
    return sums.withColumn(number, F.row_number().over(whole.orderBy(cluster)).cast("long") - 1).withColumn(held, F.count("*").over(whole))


def draw_totals(sums: DataFrame, by: list[str], cluster: str, columns: list[str], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, draw, columns): the columns' totals over each draw's clusters. sums has a row for each cluster of each group.

    Groups and clusters may be null-free keys of any type; an empty table gives no rows. Work is draws times clusters.
    """
    rows = numbered_clusters(sums.select(*by, cluster, *columns), by, cluster)
    number, held = rows.columns[-2:]
    draw, of = free_names(rows.columns, "draw", "of")
    picks = rows.select(*by, number, held, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias(draw))
    picks = picks.withColumn(of, pick(seed, F.col(draw), F.col(number), F.col(held))).groupBy(*by, draw, of).agg(F.count("*").alias(held))
    taken = picks.join(rows.drop(held).withColumnRenamed(number, of), [*by, of])
    return taken.groupBy(*by, draw).agg(*(F.sum(F.col(held) * F.col(c)).alias(c) for c in columns)).withColumnRenamed(draw, "draw")


def draw_totals_sql(table: str, by: str, cluster: str, columns: list[str], draws: int = DRAWS, seed: int = SEED) -> str:
    """The same as a query on `table`, for a single column in `by`."""
    sums = ", ".join(f"sum(times * {c}) AS {c}" for c in columns)
    return f"""(WITH nc AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {cluster}) - 1 AS number, count(*) OVER (PARTITION BY {by}) AS held FROM {table}),
      pk AS (SELECT {by}, draw, {pick_sql(seed, "draw", "number", "held")} AS number, count(*) AS times FROM nc, range({draws}) t(draw) GROUP BY ALL) SELECT {by}, draw, {sums} FROM pk JOIN nc USING ({by}, number) GROUP BY ALL)"""


def interval(column: str) -> list[Column]:
    """The 2.5 and 97.5 percentiles of a column of draws."""
    return [F.percentile(column, F.lit(p)) for p in (0.025, 0.975)]
