"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers and equal ones are grouped, so Lloyd's rounds read each distinct vector once, with its
multiplicity as its weight. A round sums weight times component by cluster in whole numbers inside every task, then by
one small shuffle; only K rows of sums reach the driver, and every floor is exact. The assignment of the distinct vectors
is joined back to all vec_ids at the end: vectors that very many rows share through a broadcast table of bounded size, the
others by a shuffle, so no group of copies meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Quantised components are held within these bounds (values beyond two million), so that a squared distance is a long.
LARGEST = 1 << 27
#: A vector is hot if more than one row in HOT has it, so there are fewer than HOT hot vectors, whatever the table.
HOT = 1000
ROWS = 4096  # vectors whose distances a task holds at once


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors with exactly dim components, none of them null, NaN or infinite: floor(scale * x)."""
    x = F.col("embedding")
    whole = (F.size(x) == dim) & F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    step = lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), v * scale))))).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("embedding", step).alias("q"))


def first_centroids(rows: DataFrame, k: int = K) -> np.ndarray:
    """The k kept vectors whose ids have the smallest hashes, in that order; of rows with one id the smaller vector first."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.filter("vec_id is not null").select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r.q for r in found], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number, the smaller one of a tie, and its squared distance; whole numbers throughout."""
    cluster, distance = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for at in range(0, len(q), ROWS):
        part = q[at : at + ROWS]
        d = np.stack([((part - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        cluster[at : at + ROWS] = d.argmin(axis=1)
        distance[at : at + ROWS] = d.min(axis=1)
    return cluster, distance


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _sums(distinct: DataFrame, centroids: Broadcast, k: int, dim: int) -> DataFrame:
    """(cluster, weight, sums) of every non-empty cluster: rows and component sums, each vector times its multiplicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            q, m = _matrix(batch.column(0)), batch.column(1).to_numpy()
            cluster, _ = nearest(q, centroids.value)
            np.add.at(weight, cluster, m)
            np.add.at(sums, cluster, q * m[:, None])
        held = np.flatnonzero(weight)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(weight[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "weight", "sums"])

    parts = distinct.mapInArrow(run, "cluster int, weight long, sums array<long>")
    flat = parts.select("cluster", "weight", F.posexplode("sums").alias("place", "value"))
    summed = flat.groupBy("cluster", "place").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    return summed.groupBy("cluster").agg(F.first("weight").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s.value).alias("sums"))


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after some rounds over (q, m): the exact floor of each cluster's mean; empty clusters keep theirs."""
    context = distinct.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(centroids)  # k vectors
        centroids = centroids.copy()
        for r in _sums(distinct, shared, *centroids.shape).collect():  # k rows
            centroids[r.cluster] = [s // r.weight for s in r.sums]
    return centroids


def _assigned(distinct: DataFrame, centroids: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(0)), centroids.value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance)], ["q", "m", "cluster", "distance"])

    return distinct.mapInArrow(run, "q array<int>, m long, cluster int, distance long")


def _by_cluster(values: list, kind: str) -> Column:
    """A column that looks the row's cluster up in k values."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of (vec_id, embedding).

    Rows whose vector is null, of another length, or holds a null, NaN or infinite component are not kept. Repeated rows
    count, and come back, as often as they stand there. A row without vec_id belongs to a cluster and weighs in its mean, but
    can't start one. Components beyond LARGEST count as LARGEST. Fewer than k kept ids give fewer centroids; an empty
    table, or one with no id at all, gives no rows. An inertia that is no long is null. Other columns do no harm.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, dim, scale)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    distinct = stored(rows.groupBy("q").agg(F.count("*").alias("m")), "distinct")
    final = lloyd(distinct, centroids, rounds)
    assigned = stored(_assigned(distinct, spark.sparkContext.broadcast(final)), "assigned")
    own = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("m")).alias("d"), F.sum("m").alias("n")).collect()}  # k rows
    fits = lambda n: int(n) if n < 1 << 63 else None
    inertias = [fits(own[c].d) if c in own else 0 for c in range(len(final))]
    total = fits(sum(r.d for r in own.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]

    often = F.col("m") * HOT > sum(r.n for r in own.values())
    hot = assigned.filter(often).select("q", "cluster", "distance")  # fewer than HOT rows
    cold = assigned.filter(~often).select("q", "cluster", "distance")
    named = rows.join(F.broadcast(hot), "q").unionByName(rows.join(F.broadcast(hot.select("q")), "q", "left_anti").join(cold, "q"))
    return named.select("vec_id", "cluster", "distance", _by_cluster(inertias, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), _by_cluster(digests, "string").alias("centroid_sha256"))
