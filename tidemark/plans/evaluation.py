"""Lead-lag, event studies, regressions, tests and model evaluation over panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tidemark.functions import domain as D, stats
from tidemark.operators import logit, resample
from tidemark.operators.ranges import numbered

from .adapters import Views
from .basics import MONTHLY, by_day, monthly
from .panels import EOD, FORECAST_USES, FORECASTS, R, end_of_day, forecasts
from .registry import query

GAP = f"""{EOD}, gp AS (SELECT event, day, sum(mid * move_bps) / sum(mid) AS k, sum(spread * move_bps) / nullif(sum(spread), 0) AS f, count(*) AS n, avg(CAST(spread > 0.2 AS INTEGER)) <= 0.6 AS usable FROM eod JOIN contracts USING (ticker) GROUP BY event, day)"""
USES = "contracts quotes"


def event_days() -> WindowSpec:
    return Window.partitionBy("event").orderBy("day")


def gap_rows(v: Views) -> DataFrame:
    """(event, day, k, f, n, usable): two expected moves of each event and day."""
    rows = end_of_day(v).join(v.contracts.select("ticker", "event", "move_bps"), "ticker").groupBy("event", "day")
    weighted = lambda w: F.try_divide(F.sum(F.col(w) * F.col("move_bps")), F.sum(w))
    return rows.agg(weighted("mid").alias("k"), weighted("spread").alias("f"), F.count("*").alias("n"), (F.avg((F.col("spread") > 0.2).cast("int")) <= 0.6).alias("usable"))


@query("gap_panel", "D-31 A-21 A-14", f"WITH {GAP} SELECT event, strftime(day, '%Y-%m-%d') AS day, n, usable, round(k - f, 4) AS gap FROM gp", USES)
def gap_panel(v: Views) -> DataFrame:
    return gap_rows(v).select("event", F.col("day").cast("string").alias("day"), "n", "usable", R(F.col("k") - F.col("f"), 4).alias("gap"))


@query("matched_panel", "D-30 A-13", f"WITH {GAP}, b AS (SELECT CASE WHEN date_diff('day', day, DATE '2024-01-30') <= 7 THEN 'week' WHEN date_diff('day', day, DATE '2024-01-30') <= 14 THEN 'fortnight' ELSE 'month' END AS band, k, f FROM gp WHERE f IS NOT NULL) SELECT band, count(*) AS n, round(avg(k - f), 4) AS diff, round(avg(abs(k - f)), 4) AS abs_diff, round(corr(k, f), 5) AS cor FROM b GROUP BY band", USES)
def matched_panel(v: Views) -> DataFrame:
    out = F.datediff(F.lit("2024-01-30").cast("date"), "day")
    band = F.when(out <= 7, "week").when(out <= 14, "fortnight").otherwise("month")
    d = F.col("k") - F.col("f")
    return gap_rows(v).filter("f is not null").groupBy(band.alias("band")).agg(F.count("*").alias("n"), R(F.avg(d), 4).alias("diff"), R(F.avg(F.abs(d)), 4).alias("abs_diff"), R(F.corr("k", "f"), 5).alias("cor"))


@query("feature_table", "D-32 W-6 X-12 J-5", f"""WITH {GAP}, z AS (SELECT event, day, k, f, lead(k, 3) OVER w - k AS target, k - lag(k) OVER w AS last_change, (k - f) AS gap, date_diff('day', lag(day) OVER w, day) AS step FROM gp WINDOW w AS (PARTITION BY event ORDER BY day))
  SELECT event, strftime(day, '%Y-%m-%d') AS day, round(target, 4) AS target, round(last_change, 4) AS last_change, round(coalesce(exp(-step / 3.0), 0), 6) AS decay, round(gap * coalesce(exp(-step / 3.0), 0), 4) AS gap_decay FROM z""", USES)
def feature_table(v: Views) -> DataFrame:
    decay = F.coalesce(F.exp(-F.datediff("day", F.lag("day").over(event_days())) / 3.0), F.lit(0.0))
    rows = gap_rows(v).withColumn("decay", decay)
    return rows.select("event", F.col("day").cast("string").alias("day"), R(F.lead("k", 3).over(event_days()) - F.col("k"), 4).alias("target"), R(F.col("k") - F.lag("k").over(event_days()), 4).alias("last_change"), R("decay").alias("decay"), R((F.col("k") - F.col("f")) * F.col("decay"), 4).alias("gap_decay"))


CHANGES = f"{MONTHLY}, ch AS (SELECT month, day, x - lag(x) OVER w AS dx, n - lag(n) OVER w AS dn FROM m WINDOW w AS (ORDER BY day))"


def changes(v: Views) -> DataFrame:
    return monthly(v).select("month", "day", (F.col("x") - F.lag("x").over(by_day())).alias("dx"), (F.col("n") - F.lag("n").over(by_day())).alias("dn"))


@query("cross_correlation", "T-10 A-13", f"WITH {CHANGES}, l AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, dx, lead(dn, {k}) OVER (ORDER BY day) AS other FROM ch" if k >= 0 else f"SELECT {k} AS lag, dx, lag(dn, {-k}) OVER (ORDER BY day) AS other FROM ch" for k in range(-3, 4)) + ") SELECT lag, round(corr(dx, other), 6) AS cor FROM l GROUP BY lag", "daily")
def cross_correlation(v: Views) -> DataFrame:
    shifted = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("dn", k).over(by_day()).alias("other")) for k in range(-3, 4)])
    rows = changes(v).withColumn("s", shifted).select("dx", F.inline("s")).filter("dx is not null and other is not null")
    return rows.groupBy("lag").agg(R(F.corr("dx", "other")).alias("cor"))


@query("event_response", "T-9 O-5 W-12", f"""WITH {CHANGES}, r AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM ch WHERE dx IS NOT NULL), b AS (SELECT quantile_cont(abs(dx), 0.97) AS q FROM r), e AS (SELECT r.* FROM r, b WHERE abs(dx) >= q), s AS (SELECT avg(abs(dx)) AS scale FROM e),
  p AS (SELECT r.i - e.i AS step, avg(sign(e.dx) * r.dx) AS d, count(*) AS n FROM e JOIN r ON r.i BETWEEN e.i AND e.i + 5 GROUP BY 1) SELECT step, n, round(sum(d) OVER (ORDER BY step) / scale, 5) AS path FROM p, s""", "daily")
def event_response(v: Views) -> DataFrame:
    rows = changes(v).filter("dx is not null").withColumn("i", F.row_number().over(by_day()).cast("long"))
    bound = rows.agg(F.percentile(F.abs("dx"), F.lit(0.97)).alias("q"))
    events = rows.join(F.broadcast(bound), F.abs("dx") >= F.col("q"))
    scale = events.agg(F.avg(F.abs("dx")).alias("scale"))
    ahead = events.select(F.signum("dx").alias("sign"), F.col("i").alias("i0"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("step")).withColumn("i", F.col("i0") + F.col("step"))
    per = ahead.join(rows.select("i", "dx"), "i").groupBy(F.col("step").cast("long").alias("step")).agg(F.avg(F.col("sign") * F.col("dx")).alias("d"), F.count("*").alias("n"))
    path = F.sum("d").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # a row a step
    return per.crossJoin(F.broadcast(scale)).select("step", "n", R(path / F.col("scale"), 5).alias("path"))


@query("weekend_alignment", "T-11", "WITH t AS (SELECT * FROM daily WHERE isodow(day) <= 5), l AS (SELECT day, x, lead(day) OVER (ORDER BY day) AS monday, lead(x) OVER (ORDER BY day) AS mx FROM t) SELECT strftime(l.day, '%Y-%m-%d') AS friday, round(mx - l.x + 1e-7, 4) AS move, s.n AS sunday_n FROM l LEFT JOIN daily s ON s.day = l.day + 2 WHERE isodow(l.day) = 5 AND monday = l.day + 3", "daily")
def weekend_alignment(v: Views) -> DataFrame:
    """Friday, Sunday and Monday by keys of days, so no window spans the table."""
    d = v.daily
    monday, sunday = d.select(F.date_sub("day", 3).alias("day"), F.col("x").alias("mx")), d.select(F.date_sub("day", 2).alias("day"), F.col("n").alias("sunday_n"))
    return d.filter(F.weekday("day") == 4).join(monday, "day").join(sunday, "day", "left").select(F.col("day").cast("string").alias("friday"), R(F.col("mx") - F.col("x") + 1e-7, 4).alias("move"), "sunday_n")


@query("ols_slope", "M-5", f"WITH {FORECASTS} SELECT h, round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 6) AS intercept, count(*) AS n FROM forecasts GROUP BY h", FORECAST_USES)
def ols_slope(v: Views) -> DataFrame:
    return forecasts(v).groupBy("h").agg(R(F.regr_slope("y", "p")).alias("slope"), R(F.regr_intercept("y", "p")).alias("intercept"), F.count("*").alias("n"))


CLUSTERED = f"""{FORECASTS}, b AS (SELECT regr_slope(y, p) AS b1, regr_intercept(y, p) AS b0, count(*) AS n, sum(p) AS sx, sum(p * p) AS sxx FROM forecasts),
  s AS (SELECT event, sum(y - b0 - b1 * p) AS s0, sum(p * (y - b0 - b1 * p)) AS s1 FROM forecasts, b GROUP BY event), m AS (SELECT count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM s)"""


@query("ols_cluster", "M-6 A-20", f"WITH {CLUSTERED} SELECT round(b1, 6) AS slope, round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11)) / (n * sxx - sx * sx), 6) AS se, g FROM b, m", FORECAST_USES)
def ols_cluster(v: Views) -> DataFrame:
    """Clustered standard error of a slope from sums alone: X'X from one pass, score sums of each cluster from another."""
    rows = forecasts(v).select("event", "p", "y")
    b = rows.agg(F.regr_slope("y", "p").alias("b1"), F.regr_intercept("y", "p").alias("b0"), F.count("*").alias("n"), F.sum("p").alias("sx"), F.sum(F.col("p") * F.col("p")).alias("sxx"))
    e = F.col("y") - F.col("b0") - F.col("b1") * F.col("p")
    s = rows.crossJoin(F.broadcast(b)).groupBy("event").agg(F.sum(e).alias("s0"), F.sum(F.col("p") * e).alias("s1"))
    m = s.agg(F.count("*").alias("g"), F.sum(F.col("s0") * F.col("s0")).alias("m00"), F.sum(F.col("s0") * F.col("s1")).alias("m01"), F.sum(F.col("s1") * F.col("s1")).alias("m11"))
    meat = F.expr("g / (g - 1.0D) * (n - 1.0D) / (n - 2.0D) * (sx * sx * m00 - 2 * n * sx * m01 + 1.0D * n * n * m11)")
    return b.crossJoin(m).select(R("b1").alias("slope"), R(F.sqrt(meat) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("se"), "g")


CLOSING = " UNION ALL ".join(f"SELECT {h} AS h, k - f AS gap, lead(k, {h}) OVER (PARTITION BY event ORDER BY day) - k AS dk, lead(f, {h}) OVER (PARTITION BY event ORDER BY day) - f AS df FROM gp" for h in (1, 3, 5))


@query("closing_slopes", "M-9", f"WITH {GAP}, u AS ({CLOSING}), s AS (SELECT h, count(*) AS n, (count(*) * sum(dk * gap) - sum(dk) * sum(gap)) / (count(*) * sum(gap * gap) - pow(sum(gap), 2)) AS b, (count(*) * sum(df * gap) - sum(df) * sum(gap)) / (count(*) * sum(gap * gap) - pow(sum(gap), 2)) AS d FROM u WHERE dk IS NOT NULL AND df IS NOT NULL AND gap IS NOT NULL GROUP BY h) SELECT h, n, round(b, 5) AS b, round(d, 5) AS d, round(b / (b - d), 4) AS share FROM s", USES)
def closing_slopes(v: Views) -> DataFrame:
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), (F.lead("k", h).over(event_days()) - F.col("k")).alias("dk"), (F.lead("f", h).over(event_days()) - F.col("f")).alias("df")) for h in (1, 3, 5)])
    rows = gap_rows(v).withColumn("s", ahead).select((F.col("k") - F.col("f")).alias("gap"), F.inline("s")).na.drop()
    s = rows.groupBy("h").agg(F.count("*").alias("n"), F.regr_slope("dk", "gap").alias("b"), F.regr_slope("df", "gap").alias("d"))
    return s.select("h", "n", R("b", 5).alias("b"), R("d", 5).alias("d"), R(F.try_divide(F.col("b"), F.col("b") - F.col("d")), 4).alias("share"))


HOLM = f"WITH {FORECASTS}, s AS (SELECT h, avg(p - y) AS m, stddev_samp(p - y) / sqrt(count(*)) AS se FROM forecasts GROUP BY h), t AS (SELECT h, exp(-pow(m / se, 2) / 2) AS p FROM s), r AS (SELECT *, row_number() OVER (ORDER BY p, h) AS r, count(*) OVER () AS c FROM t) SELECT h, round(p, 6) AS p, round(least(max((c - r + 1) * p) OVER (ORDER BY r), 1), 6) AS adjusted FROM r"


@query("holm", "M-15 X-11", HOLM, FORECAST_USES)
def holm(v: Views) -> DataFrame:
    """Holm's step-down over the horizons' p-values (the chi-square tail with two degrees of freedom); a row a horizon."""
    s = forecasts(v).groupBy("h").agg(F.avg(F.col("p") - F.col("y")).alias("m"), (F.stddev_samp(F.col("p") - F.col("y")) / F.sqrt(F.count("*"))).alias("se"))
    t = s.select("h", D.chi2_tail_even(F.pow(F.col("m") / F.col("se"), F.lit(2)), 2).alias("p"))
    r = t.withColumn("r", F.row_number().over(Window.orderBy("p", "h"))).withColumn("c", F.count("*").over(Window.partitionBy()))
    adjusted = F.max((F.col("c") - F.col("r") + 1) * F.col("p")).over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return r.select("h", R("p").alias("p"), R(F.least(adjusted, F.lit(1.0))).alias("adjusted"))


@query("clark_west", "M-14", f"WITH {FORECASTS}, g AS (SELECT event, pow(y - 0.5, 2) - (pow(y - p, 2) - pow(0.5 - p, 2)) AS f, pow(y - 0.5, 2) AS e0, pow(y - p, 2) AS e1 FROM forecasts), a AS (SELECT avg(f) AS m, count(*) AS n, 1 - sum(e1) / sum(e0) AS r2 FROM g), s AS (SELECT sum(f - m) AS s FROM g, a GROUP BY event) SELECT round(m / (sqrt((SELECT sum(s * s) FROM s)) / n), 5) AS t, round(r2, 6) AS r2 FROM a", FORECAST_USES)
def clark_west(v: Views) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    rows = forecasts(v).select("event", ((y - 0.5) * (y - 0.5) - ((y - p) * (y - p) - (p - 0.5) * (p - 0.5))).alias("f"), ((y - 0.5) * (y - 0.5)).alias("e0"), D.brier(p, y).alias("e1"))
    a = rows.agg(F.avg("f").alias("m"), F.count("*").alias("n"), (1 - F.sum("e1") / F.sum("e0")).alias("r2"))
    s = rows.crossJoin(F.broadcast(a.select("m"))).groupBy("event").agg(F.sum(F.col("f") - F.col("m")).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return a.crossJoin(s).select(R(F.col("m") / (F.sqrt("ss") / F.col("n")), 5).alias("t"), R("r2").alias("r2"))


# Errors are summed as whole numbers of 1e-9, and events' means of 1e-12, so no sum depends on the order of its terms.
@query("accuracy_by_horizon", "M-18 A-16", f"WITH {FORECASTS}, e AS (SELECT event, h, CAST(round(CAST(sum(CAST(round(abs(p - y) * 1e9) AS BIGINT)) AS DOUBLE) / count(*) * 1e3) AS BIGINT) AS a FROM forecasts GROUP BY event, h) SELECT h, count(*) AS events, round(CAST(sum(a) AS DOUBLE) / (count(*) * 1e12), 6) AS mae, round(avg(a) / (stddev_samp(a) / sqrt(count(*))), 4) AS t FROM e GROUP BY h", FORECAST_USES)
def accuracy_by_horizon(v: Views) -> DataFrame:
    small = F.round(F.abs(F.col("p") - F.col("y")) * 1e9).cast("long")
    e = forecasts(v).groupBy("event", "h").agg(F.round(F.sum(small).cast("double") / F.count("*") * 1e3).cast("long").alias("a"))
    return e.groupBy("h").agg(F.count("*").alias("events"), R(F.sum("a").cast("double") / (F.count("*") * 1e12)).alias("mae"), R(F.avg("a") / (F.stddev_samp("a") / F.sqrt(F.count("*"))), 4).alias("t"))


ENCOMPASSING = """x AS (SELECT event, h, y - q AS e, p - q AS d FROM forecasts WHERE q IS NOT NULL), b AS (SELECT h, count(*) AS n, sum(d) AS sd, sum(d * d) AS sdd, regr_slope(e, d) AS b1, regr_intercept(e, d) AS b0 FROM x GROUP BY h),
  s AS (SELECT h, event, sum(e - b0 - b1 * d) AS s0, sum(d * (e - b0 - b1 * d)) AS s1 FROM x JOIN b USING (h) GROUP BY h, event), m AS (SELECT h, count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM s GROUP BY h)"""


@query("encompassing", "M-19 M-6", f"WITH {FORECASTS}, {ENCOMPASSING} SELECT h, n, round(b1, 5) AS slope, round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (sd * sd * m00 - 2 * n * sd * m01 + n * n * m11)) / (n * sdd - sd * sd), 5) AS se FROM b JOIN m USING (h) WHERE g > 1 AND n > 2", FORECAST_USES)
def encompassing(v: Views) -> DataFrame:
    """What the normalised forecast misses on what the quoted one says beyond it, for each horizon, clustered by event."""
    x = forecasts(v).filter("q is not null").select("h", "event", (F.col("y") - F.col("q")).alias("e"), (F.col("p") - F.col("q")).alias("d"))
    return encompassing_table(x)


def encompassing_table(x: DataFrame) -> DataFrame:
    """(h, n, slope, se) of e on d for each h, clustered by event."""
    b = x.groupBy("h").agg(F.count("*").alias("n"), F.sum("d").alias("sd"), F.sum(F.col("d") * F.col("d")).alias("sdd"), F.regr_slope("e", "d").alias("b1"), F.regr_intercept("e", "d").alias("b0"))
    rest = F.col("e") - F.col("b0") - F.col("b1") * F.col("d")
    s = x.join(b.select("h", "b0", "b1"), "h").groupBy("h", "event").agg(F.sum(rest).alias("s0"), F.sum(F.col("d") * rest).alias("s1"))
    product = lambda i, j: F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}{j}")
    m = s.groupBy("h").agg(F.count("*").alias("g"), product(0, 0), product(0, 1), product(1, 1))
    meat = F.expr("g / (g - 1.0D) * (n - 1.0D) / (n - 2.0D) * (sd * sd * m00 - 2 * n * sd * m01 + 1.0D * n * n * m11)")
    return b.join(m, "h").filter("g > 1 and n > 2").select("h", "n", R("b1", 5).alias("slope"), R(F.sqrt(meat) / (F.col("n") * F.col("sdd") - F.col("sd") * F.col("sd")), 5).alias("se"))


# Iterative and seeded statistics: draws are picked by hashes, which SQL picks as well.


def _per(rows: DataFrame, key: str, schema: str, solve) -> DataFrame:
    """solve(frame sorted) -> dict for each key; the frames are panels of a bounded number of rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = solve(frame)
        return pd.DataFrame([{key: frame[key].iloc[0], **found}])

    return rows.groupBy(key).applyInPandas(run, schema)


def _forecast_panel(v: Views) -> DataFrame:
    return forecasts(v).select("h", "event", "ticker", F.col("y").cast("double").alias("y"), D.clip(F.col("p"), 0.005, 0.995).alias("p"))


def _log_odds(v: Views) -> DataFrame:
    return _forecast_panel(v).select("h", "event", "y", D.logit(F.col("p")).alias("z"))


@query("logit_calibration", "M-1 M-2 M-3 X-11")
def logit_calibration(v: Views) -> DataFrame:
    return logit.calibration(_log_odds(v), "h", "event")


LOG_ODDS = f"""{FORECASTS}, lo AS (SELECT h, event, CAST(y AS DOUBLE) AS y, ln(least(greatest(p, 0.005), 0.995) / (1 - least(greatest(p, 0.005), 0.995))) AS z FROM forecasts),
  pr AS (SELECT *, 1 / (1 + exp(-z)) AS c FROM lo), sc AS (SELECT h, event, sum(y - c) AS s0, sum(z * (y - c)) AS s1, sum(c * (1 - c)) AS i00, sum(z * c * (1 - c)) AS i01, sum(z * z * c * (1 - c)) AS i11 FROM pr GROUP BY h, event)"""
LOGIT_SUMS = ["s0", "s1", "i00", "i01", "i11"]


_NEWTON = "".join(f""", i{k} AS (SELECT h, a, b, sum(y - c) AS s0, sum(z * (y - c)) AS s1, sum(c * (1 - c)) AS i0, sum(z * c * (1 - c)) AS i1, sum(z * z * c * (1 - c)) AS i2 FROM (SELECT lo.h, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS c FROM lo JOIN n{k} USING (h)) GROUP BY h, a, b),
  n{k + 1} AS (SELECT h, a + (i2 * s0 - i1 * s1) / (i0 * i2 - i1 * i1) AS a, b + (i0 * s1 - i1 * s0) / (i0 * i2 - i1 * i1) AS b FROM i{k})""" for k in range(8))


@query("calibration_curve", "M-21 M-1 X-9", f"""WITH {FORECASTS}, lo AS (SELECT h, CAST(y AS DOUBLE) AS y, ln(least(greatest(p, 0.005), 0.995) / (1 - least(greatest(p, 0.005), 0.995))) AS z FROM forecasts), n0 AS (SELECT DISTINCT h, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM lo){_NEWTON}
  SELECT h, i / 100.0 AS f, round(1 / (1 + exp(-(a + b * ln((i / 100.0) / (1 - i / 100.0))))), 5) AS p FROM n8, range(1, 100) t(i) WHERE isfinite(a) AND isfinite(b)""", FORECAST_USES)
def calibration_curve(v: Views) -> DataFrame:
    """The curve of each horizon's calibration regression on 99 points after eight Newton steps, as the SQL has it: where outcomes
    are separable, the steps run away and the curve is a step."""
    beta = logit.fixed_steps(_log_odds(v), "h", "z", "y", 8)
    fitted = v.spark.createDataFrame([(h, a, b) for h, (a, b) in beta.items() if np.isfinite([a, b]).all()], "h int, a double, b double")
    f = F.col("i") / 100.0
    points = fitted.select("h", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("i"))
    return points.select("h", f.alias("f"), R(1 / (1 + F.exp(-(F.col("a") + F.col("b") * D.logit(f)))), 5).alias("p"))


@query("logit_draw_sums", "M-1 M-2 M-3", f"""WITH {LOG_ODDS}, dr AS {resample.draw_totals_sql("sc", "h", "event", LOGIT_SUMS, 99)}
  SELECT h, CAST(draw AS INTEGER) + 1 AS draw, {", ".join(f"round({c}, 8) AS {c}" for c in LOGIT_SUMS)} FROM dr UNION ALL SELECT h, 0, {", ".join(f"round(sum({c}), 8) AS {c}" for c in LOGIT_SUMS)} FROM sc GROUP BY h""", FORECAST_USES)
def logit_draw_sums(v: Views) -> DataFrame:
    """Score and information of the sample (draw 0) and of 99 resamples where Newton starts, intercept 0 and slope 1."""
    rows = _log_odds(v).withColumn("one", F.lit(1.0))
    resamples = logit.Resamples.of(rows, "h", "event", 99, resample.SEED)
    start = {g: (np.arange(len(t)), np.tile([0.0, 1.0], (len(t), 1))) for g, t in resamples.times.items()}
    sums = logit.step_sums(rows.join(resamples.numbers, ["h", "event"]), "h", ["one", "z"], "y", resamples, start)
    wide = sums.groupBy("h", F.col("draw").cast("int").alias("draw")).pivot("term", list(range(5))).agg(F.first("value"))
    return wide.select("h", "draw", *(R(str(k), 8).alias(c) for k, c in enumerate(LOGIT_SUMS)))


@query("regime_test", "M-4")
def regime_test(v: Views) -> DataFrame:
    """Events numbered from 5 on count as after the change."""
    return logit.regimes(_log_odds(v).withColumn("after", (F.col("event") >= 5).cast("int")), "h", "event")


SLOPE_SUMS = ["n", "sx", "sy", "sxx", "sxy"]
_SLOPE = "((n * sxy - sx * sy) / (n * sxx - sx * sx))"


@query("cluster_bootstrap", "M-7 M-13", f"""WITH {FORECASTS}, cl AS (SELECT h, event, y, least(greatest(p, 0.005), 0.995) AS x FROM forecasts), sm AS (SELECT h, event, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, CAST(sum(y) AS DOUBLE) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM cl GROUP BY h, event),
  dr AS {resample.draw_totals_sql("sm", "h", "event", SLOPE_SUMS)}, pt AS (SELECT h, {", ".join(f"sum({c}) AS {c}" for c in SLOPE_SUMS)} FROM sm GROUP BY h), q AS (SELECT h, quantile_cont({_SLOPE}, 0.025) AS low, quantile_cont({_SLOPE}, 0.975) AS high FROM dr GROUP BY h)
  SELECT h, round({_SLOPE}, 5) AS slope, round(low, 5) AS low, round(high, 5) AS high FROM pt JOIN q USING (h)""", FORECAST_USES)
def cluster_bootstrap(v: Views) -> DataFrame:
    """Slope of the outcome on the forecast with a bootstrap over events, from each event's cross-products alone."""
    p, y = F.col("p"), F.col("y")
    sums = _forecast_panel(v).groupBy("h", "event").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("sx"), F.sum(y).alias("sy"), F.sum(p * p).alias("sxx"), F.sum(p * y).alias("sxy"))
    slope = F.expr(_SLOPE)
    point = sums.groupBy("h").agg(*(F.sum(c).alias(c) for c in SLOPE_SUMS)).select("h", R(slope, 5).alias("slope"))
    low, high = resample.interval("slope")
    return point.join(resample.draw_totals(sums, ["h"], "event", SLOPE_SUMS).withColumn("slope", slope).groupBy("h").agg(R(low, 5).alias("low"), R(high, 5).alias("high")), "h")


@query("meeting_boot", "M-18 X-11", f"""WITH {FORECASTS}, e AS (SELECT h, event, avg(abs(least(greatest(p, 0.005), 0.995) - y)) AS a, 1.0::DOUBLE AS n FROM forecasts GROUP BY h, event), dr AS {resample.draw_totals_sql("e", "h", "event", ["a", "n"])},
  q AS (SELECT h, quantile_cont(a / n, 0.025) AS low, quantile_cont(a / n, 0.975) AS high FROM dr GROUP BY h), m AS (SELECT h, avg(a) AS mean, avg(a) / (stddev_samp(a) / sqrt(count(*))) AS t FROM e GROUP BY h)
  SELECT h, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(t, 3) AS t, round({D.erfc_sql("abs(t) / sqrt(2)")}, 6) AS p FROM m JOIN q USING (h)""", FORECAST_USES)
def meeting_boot(v: Views) -> DataFrame:
    """Mean over events of their mean error, with its t, normal p and an interval over resampled events."""
    per = _forecast_panel(v).groupBy("h", "event").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("a"), F.lit(1.0).alias("n"))
    t = F.try_divide(F.avg("a"), F.stddev_samp("a") / F.sqrt(F.count("*")))
    point = per.groupBy("h").agg(R(F.avg("a")).alias("mean"), t.alias("t"))
    low, high = resample.interval("m")
    spread = resample.draw_totals(per, ["h"], "event", ["a", "n"]).withColumn("m", F.col("a") / F.col("n")).groupBy("h").agg(R(low).alias("low"), R(high).alias("high"))
    return point.join(spread, "h").select("h", "mean", "low", "high", R("t", 3).alias("t"), R(D.two_sided_p(F.col("t"))).alias("p"))


@query("granger", "M-17")
def granger(v: Views) -> DataFrame:
    """Both directions on changes, lags 1 and 2, clustered by month."""
    lagged = [F.lag(c, k).over(by_day()).alias(f"{c}{k}") for c in ("dx", "dn") for k in (1, 2)]
    rows = changes(v).select("month", "day", "dx", F.col("dn").cast("double").alias("dn")).select("*", *lagged).na.drop()
    both = rows.withColumn("direction", F.explode(F.array(F.lit("n to x"), F.lit("x to n"))))

    def solve(frame: pd.DataFrame) -> dict:
        frame = frame.sort_values("day")
        y, other = ("dx", "dn") if frame["direction"].iloc[0] == "n to x" else ("dn", "dx")
        return stats.predictive_lags(frame[[f"{y}1", f"{y}2"]].to_numpy(float), frame[[f"{other}1", f"{other}2"]].to_numpy(float), frame[y].to_numpy(float), frame["month"].to_numpy())

    return _per(both, "direction", "direction string, wald double, p double, sum_cross double, se double", solve)


TERCILES = f"""{ENCOMPASSING.replace("x AS (SELECT event, h, y - q AS e", "ranked AS (SELECT *, row_number() OVER (ORDER BY spread, ticker, h) AS r, count(*) OVER () AS c FROM forecasts WHERE q IS NOT NULL), x AS (SELECT event, CASE WHEN r <= c // 3 + CAST(c % 3 = 2 AS INTEGER) THEN 0 WHEN r <= c // 3 * 2 + CAST(c % 3 = 2 AS INTEGER) THEN 1 ELSE 2 END AS h, y - q AS e").replace("FROM forecasts WHERE q IS NOT NULL), b AS", "FROM ranked), b AS")}"""


@query("encompassing_by_tercile", "M-20 X-14 W-14", f"WITH {FORECASTS}, {TERCILES} SELECT h AS tercile, n, round(b1, 5) AS slope, round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (sd * sd * m00 - 2 * n * sd * m01 + n * n * m11)) / (n * sdd - sd * sd), 5) AS se FROM b JOIN m USING (h) WHERE g > 1 AND n > 2", FORECAST_USES)
def encompassing_by_tercile(v: Views) -> DataFrame:
    """The encompassing regression in each third of all forecasts by the width of their quote, ranked over the whole table."""
    rows = forecasts(v).filter("q is not null").select("event", "ticker", "h", "spread", (F.col("y") - F.col("q")).alias("e"), (F.col("p") - F.col("q")).alias("d"))
    ranked = numbered(rows, "spread", ["ticker", "h"])
    c, r = F.col("total"), F.col("place") + 1
    low = F.floor(c / 3) + (c % 3 == 2).cast("int")
    third = F.when(r <= low, 0).when(r <= low + F.floor(c / 3), 1).otherwise(2)
    return encompassing_table(ranked.select(third.alias("h"), "event", "e", "d")).withColumnRenamed("h", "tercile")
