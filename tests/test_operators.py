"""Null, tie and boundary rules of the operators, against brute force."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidemark.functions import domain as D, stats
from tidemark.operators import series as S
from tidemark.operators.asof import asof_join, asof_nearest, asof_small
from tidemark.sources import incremental


def asof_brute(left, right, strict):
    out = []
    for k, t, i in left:
        fit = [r for r in right if r[0] == k and (r[1] < t if strict else r[1] <= t)]
        out.append((i, max(fit, key=lambda r: (r[1], r[2]))[2] if fit else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 7)])
def test_asof_equals_brute_force(spark, strict, bucket):
    rnd = random.Random(4)
    left = [(rnd.randrange(4), rnd.randrange(40), i) for i in range(80)]
    right = [(rnd.randrange(4), rnd.randrange(40), 1000 + i) for i in range(60)]
    l, r = spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, rt long, j long")
    got = asof_join(l, r, ["k"], "t", "rt", strict=strict, how="left", bucket=bucket, order=["j"])
    assert sorted((x.i, x.j) for x in got.collect()) == asof_brute(left, right, strict)


def test_asof_takes_the_latest_row_with_its_nulls(spark):
    l = spark.createDataFrame([(1, 10)], "k int, t int")
    r = spark.createDataFrame([(1, 5, 0.5), (1, 9, None)], "k int, rt int, bid double")
    for join in (asof_join, asof_small):
        assert join(l, r, ["k"], "t", "rt").collect()[0].bid is None


def test_nearest_prefers_the_earlier_of_equals_and_keeps_the_tolerance(spark):
    l = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 2, 1),)], "d date")
    r = spark.createDataFrame([(date(2024, 1, 8), "a"), (date(2024, 1, 12), "b")], "rd date, x string")
    assert [x.x for x in asof_nearest(l, r, "d", "rd", 3).collect()] == ["a"]


def test_empty_range_has_no_days(spark):
    df = spark.createDataFrame([(date(2024, 1, 3), date(2024, 1, 1)), (None, date(2024, 1, 1))], "a date, b date")
    assert [x.n for x in df.select(F.size(S.day_sequence(F.col("a"), F.col("b"))).alias("n")).collect()] == [0, 0]


def test_local_instants_over_both_clock_changes(spark):
    df = spark.createDataFrame([(date(2024, 3, 9),), (date(2024, 3, 10),), (date(2024, 11, 3),), (date(2024, 11, 4),)], "d date")
    got = [x.t for x in df.select(F.date_format(D.local_instant(F.col("d"), 16), "MM-dd HH").alias("t")).collect()]
    assert got == ["03-09 21", "03-10 20", "11-03 21", "11-04 21"]


def test_durations_partition_the_window(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, t(1)), (1, t(4)), (1, t(9))], "k int, ts timestamp").withColumn("end", F.lit(t(12)))
    got = S.durations(df, "k", "ts", F.col("end"), F.lit(t(2)))
    assert got.agg(F.sum("seconds")).first()[0] == 10 * 3600


def test_rolling_median_needs_enough_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, 3.0)], "i int, x double")
    got = df.select("i", S.rolling_median("x", Window.orderBy("i"), 3, 2).alias("m")).orderBy("i").collect()
    assert [x.m for x in got] == [None, None, 3.0, 2.0]


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.009,), (0.01,), (0.3,), (0.99,), (1.0,), (None,)], "p double")
    got = [x.b for x in df.select(D.bin_floor(F.col("p"), 0.1).alias("b")).collect()]
    assert got == [0.0, 0.0, 0.01, 0.3, 0.99, 0.99, None]


def pava(p, w):
    blocks = []
    for x, y in zip(p, w, strict=True):
        blocks.append([x * y, y, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] < blocks[-1][0] / blocks[-1][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return [a / b for a, b, c in blocks for _ in range(c)]


def test_isotonic_equals_pooling(spark):
    rnd = random.Random(2)
    cases = [([rnd.random() for _ in range(n)], [rnd.uniform(0.2, 3) for _ in range(n)]) for n in (1, 2, 3, 5, 8)]
    for p, w in cases:
        df = spark.createDataFrame([([(float(i), a, b) for i, (a, b) in enumerate(zip(p, w, strict=True))],)], "pts array<struct<x:double,p:double,w:double>>")
        assert np.allclose(df.select(D.isotonic_decreasing(F.col("pts")).alias("f")).first().f, pava(p, w))


def test_repeats_and_the_first_row_are_dropped(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "i int, x double")
    assert [x.i for x in S.drop_repeats(df, ["x"], "i").collect()] == [3]


def test_incremental_merge_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, late int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, late int")
    once = incremental.merge(old, new, ["id"], [F.col("late")])
    twice = incremental.merge(once, new, ["id"], [F.col("late")])
    assert sorted(once.collect()) == sorted(twice.collect())
    incremental.replace_table(once, f"{tmp_path}/t")
    incremental.replace_table(twice.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_two_sided_p(spark):
    got = spark.createDataFrame([(1.959964,), (None,)], "z double").select(D.two_sided_p("z").alias("p")).collect()
    assert abs(got[0].p - 0.05) < 1e-6 and got[1].p is None


def test_chi2():
    assert abs(stats.chi2_tail_even(5.991465, 2) - 0.05) < 1e-6


def test_ols_cluster_equals_the_sandwich_by_hand():
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=(60, 1)), np.repeat(np.arange(12), 5)
    y = 1 + 2 * x[:, 0] + rng.normal(size=60)
    d = np.column_stack([np.ones(60), x])
    m = stats.Moments.of(d, y, g, 12)
    beta = m.solve()
    se = np.sqrt(np.diag(m.clustered(beta)))
    e, inv = y - d @ beta, np.linalg.inv(d.T @ d)
    meat = sum(np.outer(d[g == k].T @ e[g == k], d[g == k].T @ e[g == k]) for k in range(12))
    assert np.allclose(se, np.sqrt(np.diag(12 / 11 * 59 / 58 * inv @ meat @ inv)))


def test_predictive_lags_find_the_leading_series():
    rng = np.random.default_rng(6)
    lead = rng.normal(size=2000)
    y = np.concatenate([[0, 0], 0.5 * lead[:-2]]) + rng.normal(size=2000)
    lags = lambda x: np.column_stack([x[1:-1], x[:-2]])
    g = np.repeat(np.arange(50), 40)[2:]
    assert stats.predictive_lags(lags(y), lags(lead), y[2:], g)["p"] < 1e-6 < stats.predictive_lags(lags(lead), lags(y), lead[2:], g)["p"]


def test_callers_columns_of_any_name_stay(spark):
    left = spark.createDataFrame([(1, 5, 9, 9, 9)], "t long, at long, l long, m long, row long")
    right = spark.createDataFrame([(1, 4, 7), (1, 6, 8)], "t long, since long, side long")
    for strict in (False, True):
        assert asof_join(left, right, ["t"], "at", "since", strict=strict).collect() == [(1, 5, 9, 9, 9, 4, 7)]
    assert asof_join(left, right, ["t"], "at", "since", bucket=lambda c: F.floor(c / 3)).collect() == [(1, 5, 9, 9, 9, 4, 7)]
    assert asof_small(left, right, ["t"], "at", "since").collect() == [(1, 5, 9, 9, 9, 4, 7)]
    states = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "k long, place long, changed long")
    assert S.keep_last(states, ["k"], [F.col("place").desc()]).collect() == [(1, 6, 2)]
    assert S.drop_repeats(states, ["changed"], "place").collect() == [(1, 6, 2)]
