"""Resamples, regressions, windows, quantiles and checks against plain versions."""

import math
import random
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import domain as D
from tidemark.operators import checks, logit, ranges, resample
from tidemark.operators.asof import asof_join, asof_small
from tidemark.plans import ORACLES, QUERIES, meetings, selection


def test_erfc_is_right_to_seven_digits(spark):
    points = [-4.0, -1.0, -0.3, 0.0, 0.2, 1.5, 3.0, 6.0]
    got = [r.e for r in spark.createDataFrame([(x,) for x in points], "x double").select(D.erfc(F.col("x")).alias("e")).collect()]
    assert all(abs(g - math.erfc(x)) <= 1.3e-7 * math.erfc(x) for g, x in zip(got, points, strict=True))
    assert abs(duckdb.sql(f"SELECT {D.erfc_sql("1.5")}").fetchall()[0][0] - math.erfc(1.5)) < 1e-7


def test_draws_are_the_same_in_spark_numpy_and_sql(spark):
    sums = spark.createDataFrame([("a", k, float(k * k)) for k in range(7)] + [("b", 3, 1.0)], "g string, c int, x double")
    got = {(r.g, r.draw): r.x for r in resample.draw_totals(sums, ["g"], "c", ["x"], draws=40, seed=3).collect()}
    times = resample.multiplicities(7, 40, 3)
    assert [got["a", d] for d in range(40)] == (times @ np.arange(7.0) ** 2).tolist() and {got["b", d] for d in range(40)} == {1.0}
    con = duckdb.connect()
    con.execute("create table s as select * from (values ('a',0,0.0),('a',1,1.0),('a',2,4.0),('a',3,9.0),('a',4,16.0),('a',5,25.0),('a',6,36.0),('b',3,1.0)) t(g, c, x)")
    assert {(g, d): float(x) for g, d, x in con.execute("select * from " + resample.draw_totals_sql("s", "g", "c", ["x"], 40, 3)).fetchall()} == got
    assert resample.draw_totals(sums.limit(0), ["g"], "c", ["x"]).count() == 0


def logit_rows(spark, n=3000, clusters=60, seed=2, after=False):
    rng = np.random.default_rng(seed)
    z, g = rng.normal(size=n).round(3), np.arange(n) % clusters
    late = (g >= clusters // 2).astype(int)
    slope = np.where(late == 1, 0.2, 1.0) if after else 0.8
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * (not after) + slope * z)))).astype(float)
    rows = spark.createDataFrame([(1, int(c), float(t), float(x), int(a)) for c, t, x, a in zip(g, y, z, late, strict=True)], "h int, event long, y double, z double, after int")
    return rows.repartition(3), z, y, g


def plain_logit(z, y):
    x, beta = np.column_stack([np.ones(len(z)), z]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
    return beta


def test_logit_resamples_weigh_clusters_like_copies(spark):
    rows, z, y, g = logit_rows(spark)
    rows = rows.withColumn("one", F.lit(1.0))
    resamples = logit.Resamples.of(rows, "h", "event", 5, 0)
    beta, information = logit.fit(rows.join(resamples.numbers, ["h", "event"]), "h", ["one", "z"], "y", resamples)
    for d in range(6):
        copies = np.concatenate([np.flatnonzero(g == k) for k in range(60) for _ in range(int(resamples.times[1][d, k]))])
        assert np.allclose(beta[1][d], plain_logit(z[copies], y[copies]), atol=1e-8)
    found = logit.calibration(rows, "h", "event", 60).first()
    x, p = np.column_stack([np.ones(len(z)), z]), 1 / (1 + np.exp(-(beta[1][0, 0] + beta[1][0, 1] * z)))
    bread = np.linalg.inv((x.T * (p * (1 - p))) @ x)
    meat = sum(np.outer(u, u) for k in range(60) for u in [x[g == k].T @ (y - p)[g == k]])
    assert np.allclose([found.se_a, found.se_b], np.sqrt(np.diag(60 / 59 * bread @ meat @ bread)))
    assert found.boot_ok == 1 and found.b_low < found.b < found.b_high and 0 < found.p_joint < 1 and found.p_a < 0.01


def test_logit_without_a_finite_fit_and_clusters_in_both_regimes(spark):
    apart = spark.createDataFrame([(1, k, float(k > 2), float(k), 0) for k in range(6)], "h int, event long, y double, z double, after int")
    assert logit.calibration(apart, "h", "event", 3).first().a is None
    with pytest.raises(ValueError):
        logit.regimes(apart.unionByName(apart.withColumn("after", F.lit(1))), "h", "event", 3)
    assert logit.calibration(apart.limit(0), "h", "event", 3).count() == 0


def test_regimes_differ_where_the_slope_changes(spark):
    rows, *_ = logit_rows(spark, 4000, 80, 3, after=True)
    found = logit.regimes(rows, "h", "event", 120).first()
    assert found.b_high < 0 and found.joint_p < 0.05 and found.a_low < 0 < found.a_high


def panel(spark, seed=1, n=16):
    """Meetings of overlapping listings, some of which start out of turn."""
    rng, rows = np.random.default_rng(seed), []
    for e in range(1, n + 1):
        first = date(2020, 1, 1) + timedelta(days=12 * e - (40 if e == 9 else 0))
        for k in range(20):
            x = rng.normal(size=9).round(4)
            y = -0.6 * x[0] + 0.3 * x[3] + rng.normal(0, 0.3)
            rows.append((1, float(round(y, 4)), first + timedelta(days=k + 3), e, first + timedelta(days=k), 1.0, *map(float, x)))
    names = ", ".join(f"{f} double" for f in meetings.FEATURES)
    return rows, spark.createDataFrame(rows, f"h int, y double, due date, event long, day date, one double, {names}")


def plain_ridge(train, names, alpha):
    at = [6 + meetings.FEATURES.index(f) for f in names]
    x, y = np.array([[r[i] for i in at] for r in train]), np.array([r[1] for r in train])
    mean, scale = x.mean(0), x.std(0, ddof=1)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + np.diag([0.0 if f == selection.FREE else alpha for f in names]), z.T @ (y - y.mean()))
    return lambda rows: y.mean() + (np.array([[r[i] for i in at] for r in rows]) - mean) / scale @ beta


def test_expanding_windows_equal_plain_ones(spark):
    """Every fold's rows gathered anew; nothing whose target came to be known on the fold's first day or later is learned from."""
    rows, df = panel(spark)
    got = {(r.event, r.model): (r.alpha, np.array(r.beta)) for r in selection.fits(selection.windows(df)).collect()}
    events = sorted({r[3] for r in rows})
    start = {e: min(r[4] for r in rows if r[3] >= e) for e in events}  # a later meeting may start earlier
    tested = 0
    for m in events:
        train = [r for r in rows if r[3] < m and r[2] < start[m]]
        trained = sorted({r[3] for r in train})
        if len(trained) < selection.LEAST_MEETINGS:
            assert (m, "all") not in got
            continue
        last = trained[-selection.TUNED :]
        tune = [r for r in train if r[3] in last]
        inner = [r for r in rows if r[3] < last[0] and r[2] < start[last[0]]]
        test = [r for r in rows if r[3] == m]
        x = np.array([[1.0, *r[6:]] for r in test])
        for name in ("all", "without book", "without drift"):
            names = selection.SPECS[name]
            errors = [((np.array([r[1] for r in tune]) - plain_ridge(inner, names, a)(tune)) ** 2).sum() for a in selection.ALPHAS]
            alpha = selection.ALPHAS[int(np.argmin(errors))]
            assert got[m, name][0] == alpha and np.allclose(x @ got[m, name][1], plain_ridge(train, names, alpha)(test), atol=1e-5)
        assert np.allclose(x @ got[m, "ar1"][1], plain_ridge(train, [selection.FREE], 0.0)(test), atol=1e-5)
        tested += 1
    assert tested >= 5


def test_a_planted_leak_changes_nothing(spark):
    """Targets known only from a fold's first day on may be anything: fits of that fold stay the same."""
    rows, df = panel(spark, 2)
    start = min(r[4] for r in rows if r[3] >= 14)
    bent = df.withColumn("y", F.when((F.col("due") >= F.lit(start)) | (F.col("event") >= 14), F.lit(1000.0)).otherwise(F.col("y")))
    fit = lambda x: {r.model: (r.alpha, r.beta) for r in selection.fits(selection.windows(x).filter("event = 14")).collect()}
    assert fit(df) == fit(bent)


def test_quantiles_numbers_and_places(spark):
    rnd = random.Random(3)
    values = [("a", rnd.choice([rnd.random(), 0.5, 1e9 * rnd.random()])) for _ in range(700)] + [("b", 1.0), (None, 3.0), (None, 5.0), ("c", None)] + [("d", 7.0)] * 50
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(values)], "g string, v double, i long").repartition(3)
    got = {r.g: (r.n, r.q0, r.q1) for r in ranges.exact_quantiles(df, ["g"], "v", [0.1, 0.975], bins=8).collect()}
    for g in ("a", "b", None, "d"):
        own = [v for k, v in values if k == g]
        assert got[g][0] == len(own) and np.allclose(got[g][1:], np.percentile(own, [10, 97.5]))
    assert set(got) == {"a", "b", None, "d"} and ranges.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    assert abs(ranges.exact_quantiles(df.filter("g = 'a'"), [], "v", [0.5]).first().q0 - np.median([v for k, v in values if k == "a"])) < 1e-9
    whole = [r.i for r in ranges.numbered(df.filter("v is not null"), "v", ["i"], 100).orderBy("place").collect()]
    assert whole == [i for _, i in sorted((v, i) for i, (_, v) in enumerate(values) if v is not None)]
    edges = F.array(*map(F.lit, [1.0, 2.0, 2.0, 5.0]))
    places = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 4.9, 5.0, 9.0, None)], "x double").select(ranges.place_in(edges, F.col("x"), 9).alias("p")).collect()
    assert [r.p for r in places] == [0, 1, 3, 3, 4, 4, 0]


def test_quantiles_carry_no_edges_with_their_rows(spark):
    """A row that met its group's edges took 8 KB through the sort of the semi join."""
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), (F.hash("id") % 1000).cast("double").alias("v"))
    found = ranges.exact_quantiles(df, ["g"], "v", [0.025, 0.97])
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    values = df.toPandas()
    for r in found.collect():
        assert np.allclose((r.q0, r.q1), np.percentile(values.v[values.g == r.g], [2.5, 97]))


def test_fixed_steps_are_taken_though_they_run_away(spark):
    """Eight steps over separable outcomes end in a finite step; where one forecast bears all information there's no solution."""
    apart = [(1, z, float(z > 0.3)) for z in (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0)]
    df = spark.createDataFrame([*apart, (2, 1.0, 1.0), (2, 1.0, 0.0)] * 3, "h int, z double, y double")
    beta = logit.fixed_steps(df, "h", "z", "y", 8)
    a, b = 0.0, 1.0
    for _ in range(8):
        z, y = np.array([r[1] for r in apart]), np.array([r[2] for r in apart])
        c = 1 / (1 + np.exp(-(a + b * z)))
        x, w = np.column_stack([np.ones(8), z]), c * (1 - c)
        a, b = np.array([a, b]) + np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (y - c))
    assert np.allclose(beta[1], (a, b), rtol=1e-6) and b > 10 and np.isnan(beta[2]).all()
    assert logit.fixed_steps(df.limit(0), "h", "z", "y", 8) == {}


def test_checks_count_and_stop_a_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, p double")
    rules = {"known": F.col("p").isNotNull(), "below one": F.col("p") < 1}
    assert {r.name: r.failures for r in checks.failures(df, rules).collect()} == {"known": 1, "below one": 2}
    with pytest.raises(Exception, match="check failed: below one"):
        checks.enforced(df.filter("id < 3"), rules).select("id").write.parquet(f"{tmp_path}/t")
    assert checks.enforced(df.filter("id = 1"), rules).count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_joins_match_no_nulls(spark, how, strict):
    left = [(1, 1, 5), (2, None, 5), (3, 1, None), (4, 2, 9), (5, 3, 1)]
    right = [(1, 4, "a"), (1, None, "n"), (None, 1, "x"), (2, 9, "b"), (3, 2, "c"), (None, None, "y")]
    con = duckdb.connect()
    con.execute("create table l(i int, k int, t int)"), con.execute("create table r(k int, rt int, v text)")
    con.executemany("insert into l values (?, ?, ?)", left), con.executemany("insert into r values (?, ?, ?)", right)
    want = sorted(con.execute(f"select i, v from l asof {'left' if how == 'left' else ''} join r on l.k = r.k and l.t {'>' if strict else '>='} r.rt").fetchall(), key=repr)
    dl, dr = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, rt int, v string")
    forms = [asof_join(dl, dr, ["k"], "t", "rt", strict=strict, how=how), asof_join(dl, dr, ["k"], "t", "rt", strict=strict, how=how, bucket=lambda c: F.floor(c / 3)), asof_small(dl, dr, ["k"], "t", "rt", strict=strict, how=how)]
    for found in forms:
        assert sorted(((r.i, r.v) for r in found.collect()), key=repr) == want
    with pytest.raises(ValueError):
        asof_join(dl, dr.withColumnRenamed("v", "i"), ["k"], "t", "rt")


def test_isotonic_fit_of_two_hundred_strikes(spark):
    from tests.test_operators import pava

    rnd = random.Random(5)
    p, w = [rnd.random() * (1 - k / 300) for k in range(200)], [rnd.uniform(0.2, 3) for _ in range(200)]
    df = spark.createDataFrame([([(float(i), a, b) for i, (a, b) in enumerate(zip(p, w, strict=True))],), ([],)], "pts array<struct<x:double,p:double,w:double>>")
    fits = [r.f for r in df.select(D.isotonic_decreasing(F.col("pts")).alias("f")).collect()]
    assert np.allclose(fits[0], pava(p, w)) and fits[1] == []


class FewDays:
    """Meetings' tables by hand: a rate of 4 %, two meetings, and a strip that says where rates go."""

    def __init__(self, spark, sittings, day, strip):
        rates = [(day + timedelta(days=k), 0, 0, 4000, 4000 + strip) for k in range(-40, 1)]
        self.span = spark.createDataFrame([(rates[0][0], rates[-1][0])], "a date, b date")
        self.sittings = spark.createDataFrame([(n, d, 400) for n, d in enumerate(sittings)], "no long, d date, level int")
        days = spark.createDataFrame([(d, 0, m, e) for d, _, _, m, e in rates], "day date, k long, mid int, effr int")
        self.starting = days.withColumn("med", F.lit(0.0))
        self.every_day = days.select("day", "effr", "mid", F.lit(0.0).alias("med"))


def moves(spark, sittings, day=date(2021, 3, 10), strip=0):
    found = meetings.chained_moves(FewDays(spark, sittings, day, strip)).filter(F.col("t") == F.lit(day)).orderBy("meeting").collect()
    return [(r.meeting, r.method, r.before, r.after) for r in found]


def test_chained_moves_take_realised_days_month_ends_and_stop(spark):
    # k is 0, so every contract's rate is the overnight rate less 30: the month after (B) has it, and A un-blends its own month.
    rate = 4000 - 30
    assert moves(spark, [date(2021, 3, 20)]) == [(date(2021, 3, 20), "B", 4000.0, rate)]
    now = moves(spark, [date(2021, 3, 20), date(2021, 4, 15)])
    realised, days = 9 * 4000, 31
    own = (days * rate - realised - (20 - 9) * 4000) / (days - 20)
    assert now[0][1] == "A" and abs(now[0][3] - own) < 1e-9 and now[1][1] == "B" and now[1][2] == now[0][3]
    later = moves(spark, [date(2021, 4, 15), date(2021, 5, 5)])
    assert later[0][1] == "A" and abs(later[0][3] - (30 * rate - 15 * 4000) / 15) < 1e-9
    # On the last day of its month, with a meeting in the next: neither A nor B, so it and all later ones are left out.
    assert moves(spark, [date(2021, 3, 20), date(2021, 4, 30), date(2021, 5, 5), date(2021, 9, 1)]) == moves(spark, [date(2021, 3, 20), date(2021, 4, 30), date(2021, 5, 5)])
    assert len(moves(spark, [date(2021, 4, 30), date(2021, 5, 5)])) == 0 and len(moves(spark, [date(2021, 4, 30)])) == 1
    # Twelve months ahead there is no contract for the month after.
    assert moves(spark, [date(2022, 3, 5)])[0][1] == "A" and moves(spark, [date(2022, 3, 31)]) == []


def test_masses_halfway_between_millionths_round_up(spark, tmp_path):
    """Step 1 has one millionth less than the rounded mass of step 2, which lies a lost bit below its half."""
    rows = [(1, k, p / 10, 0.03) for k, p in ((1, 0.728174), (3, 0.184521))]
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_tax double")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    (r,) = QUERIES["point_forecasts"](spark, str(tmp_path)).collect()
    assert [(r["event"], r["mode"], r["median"])] == connection.execute(f"select event, mode, median from ({ORACLES['point_forecasts']})").fetchall()
    assert r["mode"] == 2


def test_the_curve_takes_the_steps_of_its_sql(spark, tmp_path):
    """Outcomes that the prices separate: the fit has no end, eight steps do."""
    rows = [(u, datetime(2024, 1, 1), u, "view", 20.0 + u % 7 * 5 + (37.0 if u % 3 == 0 else 0.0)) for u in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = sorted((r["h"], round(r["f"], 6), round(r["p"], 5)) for r in QUERIES["calibration_curve"](spark, str(tmp_path)).collect())
    assert found == sorted((h, round(f, 6), round(p, 5)) for h, f, p in connection.execute(f"select h, f, p from ({ORACLES['calibration_curve']})").fetchall())
    assert len(found) >= 99
