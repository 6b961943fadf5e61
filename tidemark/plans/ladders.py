"""Strike ladders to distributions, and the rate-path operators on a futures-like curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tidemark.functions import domain as D

from .adapters import Views
from .basics import MONTHLY, monthly
from .panels import R
from .registry import query


def by_strike() -> WindowSpec:
    return Window.partitionBy("event").orderBy("strike")


FIT = """seg AS (SELECT x.event, x.strike AS a, y.strike AS b, sum(z.p * z.w) / sum(z.w) AS m FROM ladders x JOIN ladders y ON x.event = y.event AND y.strike >= x.strike JOIN ladders z ON z.event = x.event AND z.strike BETWEEN x.strike AND y.strike GROUP BY ALL),
  up AS (SELECT i.event, i.strike, s.a, max(m) AS m FROM ladders i JOIN seg s ON s.event = i.event AND s.a <= i.strike AND s.b >= i.strike GROUP BY ALL),
  fit AS (SELECT event, strike, min(m) AS fit FROM up GROUP BY event, strike)"""
BUCKETS = f"""{FIT}, edge AS (SELECT *, lead(strike) OVER w AS next_k, coalesce(lead(fit) OVER w, 0) AS hi, row_number() OVER w AS i, lag(strike) OVER w AS last_k FROM fit WINDOW w AS (PARTITION BY event ORDER BY strike)),
  buckets AS (SELECT event, strike AS low, coalesce(next_k, strike + 1) AS top, fit - hi AS mass FROM edge UNION ALL SELECT event, NULL, strike, 1 - fit FROM edge WHERE i = 1)"""


def fitted(v: Views) -> DataFrame:
    """(event, strike, fit): weighted non-increasing fit of every ladder, on its own small array."""
    points = F.array_sort(F.collect_list(F.struct(F.col("strike").alias("x"), "p", "w")))
    rows = v.ladders.groupBy("event").agg(points.alias("points"))
    fits = F.arrays_zip(F.transform("points", lambda s: s["x"]).alias("strike"), D.isotonic_decreasing(F.col("points")).alias("fit"))
    return rows.select("event", F.inline(fits))


def buckets(rows: DataFrame) -> DataFrame:
    """(event, low, top, mass): mass between neighbouring strikes, above the last, and at or below the first (low null)."""
    edge = rows.withColumn("next_k", F.lead("strike").over(by_strike())).withColumn("hi", F.coalesce(F.lead("fit").over(by_strike()), F.lit(0.0))).withColumn("i", F.row_number().over(by_strike()))
    up = edge.select("event", F.col("strike").alias("low"), F.coalesce("next_k", F.col("strike") + 1).alias("top"), (F.col("fit") - F.col("hi")).alias("mass"))
    return up.unionByName(edge.filter("i = 1").select("event", F.lit(None).cast("int").alias("low"), F.col("strike").alias("top"), (1 - F.col("fit")).alias("mass")))


@query("releases", "D-10 A-6", """WITH s AS (SELECT event, max(strike) FILTER (WHERE result = 'yes') AS y, min(strike) FILTER (WHERE result = 'no') AS n, count(*) AS k FROM ladders GROUP BY event)
  SELECT event, k, CASE WHEN y IS NOT NULL AND n IS NOT NULL THEN (y + n) / 2.0 WHEN y IS NOT NULL THEN y + 0.5 ELSE n - 0.5 END AS value FROM s""", "ladders")
def releases(v: Views) -> DataFrame:
    return bracket(v).select("event", "k", "value")


def bracket(v: Views) -> DataFrame:
    yes, no = F.max(F.when(F.col("result") == "yes", F.col("strike"))), F.min(F.when(F.col("result") == "no", F.col("strike")))
    rows = v.ladders.groupBy("event").agg(yes.alias("y"), no.alias("n"), F.count("*").alias("k"))
    return rows.withColumn("value", F.when(F.col("y").isNotNull() & F.col("n").isNotNull(), (F.col("y") + F.col("n")) / 2.0).when(F.col("y").isNotNull(), F.col("y") + 0.5).otherwise(F.col("n") - 0.5))


@query("ladder_violations", "W-2 D-9 A-8", "WITH d AS (SELECT event, p, lead(p) OVER (PARTITION BY event ORDER BY strike) AS q FROM ladders), e AS (SELECT event, bool_or(coalesce(q > p, false)) AS any_up, bool_or(coalesce(q > p + 0.02, false)) AS large FROM d GROUP BY event) SELECT event % 10 AS g, count(*) AS n, round(avg(any_up::INT), 6) AS any_share, round(avg(large::INT), 6) AS large_share FROM e GROUP BY 1", "ladders")
def ladder_violations(v: Views) -> DataFrame:
    rows = v.ladders.withColumn("q", F.lead("p").over(by_strike()))
    per = rows.groupBy("event").agg(F.bool_or(F.coalesce(F.col("q") > F.col("p"), F.lit(False))).alias("u"), F.bool_or(F.coalesce(F.col("q") > F.col("p") + 0.02, F.lit(False))).alias("l"))
    return per.groupBy((F.col("event") % 10).alias("g")).agg(F.count("*").alias("n"), R(F.avg(F.col("u").cast("int"))).alias("any_share"), R(F.avg(F.col("l").cast("int"))).alias("large_share"))


@query("isotonic_ladder", "D-11 A-24", f"WITH {FIT} SELECT event, strike, round(fit + 1e-9, 6) AS fit FROM fit", "ladders")
def isotonic_ladder(v: Views) -> DataFrame:
    return fitted(v).select("event", "strike", R(F.col("fit") + 1e-9).alias("fit"))


OUTWARD = """o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event) AS n, CASE WHEN lag(p) OVER w IS NULL THEN 1 - p ELSE lag(p) OVER w - p END AS b FROM ladders WINDOW w AS (PARTITION BY event ORDER BY strike)),
  a AS (SELECT event, i, round(b, 6) AS b FROM o UNION ALL SELECT event, n, round(p, 6) FROM o WHERE i = n - 1), j AS (SELECT event, arg_max(i, b * 1000000 - i * 0.01) AS j FROM a GROUP BY event),
  mo AS (SELECT o.event, o.strike, CASE WHEN i >= j THEN min(p) OVER (PARTITION BY o.event, i >= j ORDER BY i) ELSE max(p) OVER (PARTITION BY o.event, i >= j ORDER BY i DESC) END AS fit FROM o JOIN j USING (event))"""


def outward(v: Views) -> DataFrame:
    """Monotone from the modal bucket outward: running minima to its right, running maxima to its left."""
    o = v.ladders.withColumn("i", F.row_number().over(by_strike()) - 1).withColumn("b", F.round(F.coalesce(F.lag("p").over(by_strike()), F.lit(1.0)) - F.col("p"), 6)).withColumn("n", F.count("*").over(Window.partitionBy("event")))
    last = o.filter("i = n - 1").select("event", F.col("n").alias("i"), F.round("p", 6).alias("b"))
    mode = o.select("event", F.col("i").cast("long").alias("i"), "b").unionByName(last).groupBy("event").agg(F.max_by("i", F.col("b") * 1000000 - F.col("i") * 0.01).alias("j"))
    rows = o.join(mode, "event").withColumn("right", F.col("i") >= F.col("j"))
    w = Window.partitionBy("event", "right")
    low, high = F.min("p").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.max("p").over(w.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event", "strike", F.when(F.col("right"), low).otherwise(high).alias("fit"))


@query("mode_outward", "D-12 W-13", f"WITH {OUTWARD} SELECT event, strike, round(fit, 6) AS fit FROM mo", "ladders")
def mode_outward(v: Views) -> DataFrame:
    return outward(v).select("event", "strike", R("fit").alias("fit"))


STATS = """SELECT event, round(sum(CASE WHEN low IS NULL THEN top * mass ELSE (low + 1 + top) / 2.0 * mass END) + 1e-7, 5) AS mean, count(*) - 1 AS strikes, round(sum(CASE WHEN low IS NULL AND top > 1 THEN mass ELSE 0 END) + sum(CASE WHEN low = last THEN mass ELSE 0 END) + 1e-7, 5) AS tail,
  round(sum(CASE WHEN top - low > 2 THEN mass ELSE 0 END) + 1e-7, 5) AS gap FROM (SELECT *, max(low) OVER (PARTITION BY event) AS last FROM buckets) GROUP BY event"""


def ladder_summary(rows: DataFrame) -> DataFrame:
    b = buckets(rows).withColumn("last", F.max("low").over(Window.partitionBy("event")))
    part = lambda cond: F.sum(F.when(cond, F.col("mass")).otherwise(0.0))
    mean = F.sum(F.when(F.col("low").isNull(), F.col("top") * F.col("mass")).otherwise((F.col("low") + 1 + F.col("top")) / 2.0 * F.col("mass")))
    tail = part(F.col("low").isNull() & (F.col("top") > 1)) + part(F.col("low") == F.col("last"))
    return b.groupBy("event").agg(R(mean + 1e-7, 5).alias("mean"), (F.count("*") - 1).alias("strikes"), R(tail + 1e-7, 5).alias("tail"), R(part(F.col("top") - F.col("low") > 2) + 1e-7, 5).alias("gap"))


@query("ladder_distribution", "D-14 X-27", f"WITH {BUCKETS} {STATS}", "ladders")
def ladder_distribution(v: Views) -> DataFrame:
    return ladder_summary(fitted(v))


GRIDDED = f"""{BUCKETS}, grid AS (SELECT event, unnest(CASE WHEN low IS NULL THEN [top] ELSE range(low + 1, top + 1) END) AS step, mass / CASE WHEN low IS NULL THEN 1 ELSE top - low END AS m FROM buckets), dist AS (SELECT event, step, sum(m) AS m FROM grid GROUP BY event, step)"""


def gridded(rows: DataFrame) -> DataFrame:
    """(event, step, m): each bucket's mass spread evenly over the steps it spans."""
    b = buckets(rows)
    steps = F.when(F.col("low").isNull(), F.array("top")).otherwise(F.sequence(F.col("low") + 1, F.col("top")))
    return b.select("event", F.explode(steps).alias("step"), (F.col("mass") / F.size(steps)).alias("m")).groupBy("event", "step").agg(F.sum("m").alias("m"))


@query("regrid_distribution", "D-16 X-28", f"WITH {GRIDDED} SELECT event, step, round(m + 1e-9, 6) AS m FROM dist", "ladders")
def regrid_distribution(v: Views) -> DataFrame:
    return gridded(fitted(v)).select("event", "step", R(F.col("m") + 1e-9).alias("m"))


@query("point_forecasts", "D-17", f"WITH {GRIDDED}, c AS (SELECT *, sum(m) OVER (PARTITION BY event ORDER BY step) AS cdf FROM dist) SELECT event, arg_max(step, round(m, 6) * 1000000 - step * 0.001) AS mode, min(step) FILTER (WHERE cdf >= 0.5 - 1e-9) AS median FROM c GROUP BY event", "ladders")
def point_forecasts(v: Views) -> DataFrame:
    """Mode and median of every event. A mass halfway between two millionths rounds up, whatever bits its difference and its pooled
    sums have lost; the SQL's multiplication by a million takes up such bits, decimal rounding doesn't."""
    rows = gridded(fitted(v)).withColumn("cdf", F.sum("m").over(Window.partitionBy("event").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("event").agg(F.max_by("step", F.round(F.col("m") + 1e-12, 6) * 1000000 - F.col("step") * 0.001).alias("mode"), F.min(F.when(F.col("cdf") >= 0.5 - 1e-9, F.col("step"))).alias("median"))


MOMENTS = """r AS (SELECT event, strike, min(least(greatest(p, 0), 1)) OVER w AS s, lag(strike) OVER w AS k0, row_number() OVER w AS i, count(*) OVER (PARTITION BY event) AS n FROM ladders WINDOW w AS (PARTITION BY event ORDER BY strike)),
  x AS (SELECT event, CASE WHEN i = 1 THEN strike - 0.5 ELSE (k0 + strike) / 2.0 END AS val, coalesce(lag(s) OVER (PARTITION BY event ORDER BY strike), 1) - s AS mass FROM r UNION ALL SELECT event, strike + 0.5, s FROM r WHERE i = n),
  mom AS (SELECT event, sum(val * mass) AS mean, sqrt(greatest(sum(val * val * mass) - pow(sum(val * mass), 2), 0)) AS sd FROM x GROUP BY event)"""


def moments(v: Views) -> DataFrame:
    """(event, mean, sd) of each ladder's running-minimum survival curve."""
    r = v.ladders.withColumn("s", F.min(D.clip(F.col("p"), 0.0, 1.0)).over(by_strike().rowsBetween(Window.unboundedPreceding, 0))).withColumn("k0", F.lag("strike").over(by_strike())).withColumn("i", F.row_number().over(by_strike())).withColumn("n", F.count("*").over(Window.partitionBy("event")))
    inner = r.select("event", F.when(F.col("i") == 1, F.col("strike") - 0.5).otherwise((F.col("k0") + F.col("strike")) / 2.0).alias("val"), (F.coalesce(F.lag("s").over(by_strike()), F.lit(1.0)) - F.col("s")).alias("mass"))
    rows = inner.unionByName(r.filter("i = n").select("event", (F.col("strike") + 0.5).alias("val"), F.col("s").alias("mass"))).groupBy("event")
    mean = F.sum(F.col("val") * F.col("mass"))
    return rows.agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("val") * F.col("val") * F.col("mass")) - mean * mean, F.lit(0.0))).alias("sd"))


@query("ladder_moments", "D-13", f"WITH {MOMENTS} SELECT event, round(mean + 1e-8, 5) AS mean, round(sd, 4) AS sd FROM mom", "ladders")
def ladder_moments(v: Views) -> DataFrame:
    return moments(v).select("event", R(F.col("mean") + 1e-8, 5).alias("mean"), R("sd", 4).alias("sd"))


@query("macro_surprise", "D-33 X-13 D-10 A-9", f"""WITH {MOMENTS}, s AS (SELECT event, max(strike) FILTER (WHERE result = 'yes') AS y, min(strike) FILTER (WHERE result = 'no') AS n FROM ladders GROUP BY event),
  b AS (SELECT event, CASE WHEN y IS NOT NULL AND n IS NOT NULL THEN (y + n) / 2.0 WHEN y IS NOT NULL THEN y + 0.5 ELSE n - 0.5 END AS value FROM s) SELECT event, round((value - mean) / greatest(sd, 0.5) + 1e-8, 4) AS z FROM b JOIN mom USING (event)""", "ladders")
def macro_surprise(v: Views) -> DataFrame:
    rows = bracket(v).select("event", "value").join(moments(v), "event")
    return rows.select("event", R((F.col("value") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(0.5)) + 1e-8, 4).alias("z"))


@query("price_tiers", "D-15 F-12 X-6", "SELECT quote_id, round(CASE WHEN ask - bid BETWEEN 0 AND 0.2 THEN (bid + ask) / 2 WHEN ask - bid BETWEEN 0 AND 0.4 THEN least(greatest(mid * 0.9, bid), ask) END + 1e-9, 6) AS p, round(1 / (CASE WHEN bid IS NULL THEN 1 ELSE greatest(ask - bid, 0) END + 0.02), 6) AS w FROM quotes", "quotes")
def price_tiers(v: Views) -> DataFrame:
    gap = F.col("ask") - F.col("bid")
    last = F.least(F.greatest(F.col("mid") * 0.9, F.col("bid")), F.col("ask"))
    p = F.when(gap.between(0, 0.2), (F.col("bid") + F.col("ask")) / 2).when(gap.between(0, 0.4), last)
    return v.quotes.select("quote_id", R(p + 1e-9).alias("p"), R(1 / (F.coalesce(D.clip(gap, 0.0, 1e9), F.lit(1.0)) + 0.02)).alias("w"))


REALISED = "re AS (SELECT event, coalesce(max(strike) FILTER (WHERE result = 'yes') + 1, min(strike)) AS realised, min(strike) AS k0 FROM ladders GROUP BY event)"


def realised(v: Views) -> DataFrame:
    yes = F.max(F.when(F.col("result") == "yes", F.col("strike"))) + 1
    return v.ladders.groupBy("event").agg(F.coalesce(yes, F.min("strike")).alias("realised"), F.min("strike").alias("k0"))


@query("realized_target", "D-19 A-19 A-11", f"WITH {BUCKETS}, {REALISED}, s AS ({STATS}) SELECT event, realised, round((mean - realised) * 25 + 1e-7, 3) AS error_bp FROM re JOIN s USING (event)", "ladders")
def realized_target(v: Views) -> DataFrame:
    return realised(v).join(ladder_summary(fitted(v)), "event").select("event", "realised", R((F.col("mean") - F.col("realised")) * 25 + 1e-7, 3).alias("error_bp"))


@query("track_record", "D-18", f"WITH {GRIDDED}, {REALISED} SELECT event, realised, round(coalesce(sum(m) FILTER (WHERE CASE WHEN realised > k0 THEN step = realised ELSE step <= k0 END), 0) + 1e-9, 6) AS p FROM re JOIN dist USING (event) GROUP BY event, realised", "ladders")
def track_record(v: Views) -> DataFrame:
    hit = F.when(F.col("realised") > F.col("k0"), F.col("step") == F.col("realised")).otherwise(F.col("step") <= F.col("k0"))
    rows = realised(v).join(gridded(fitted(v)), "event").groupBy("event", "realised")
    return rows.agg(R(F.coalesce(F.sum(F.when(hit, F.col("m"))), F.lit(0.0)) + 1e-9).alias("p"))


@query("fold_outcomes", "D-23", f"WITH {GRIDDED}, t AS (SELECT step, sum(m) / (SELECT count(DISTINCT event) FROM dist) AS m FROM dist GROUP BY step), r AS (SELECT min(step) AS lo, max(step) AS hi FROM t WHERE m >= 0.05) SELECT event, least(greatest(step, lo), hi) AS outcome, CASE WHEN step < 4 THEN 'cut' WHEN step = 4 THEN 'hold' ELSE 'hike' END AS kind, round(sum(m) + 1e-9, 6) AS m FROM dist, r GROUP BY ALL", "ladders")
def fold_outcomes(v: Views) -> DataFrame:
    dist = gridded(fitted(v))
    total = dist.groupBy("step").agg(F.sum("m").alias("m")).crossJoin(F.broadcast(dist.agg(F.count_distinct("event").alias("n"))))
    bounds = total.filter("m / n >= 0.05").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    kind = F.when(F.col("step") < 4, "cut").when(F.col("step") == 4, "hold").otherwise("hike")
    rows = dist.crossJoin(F.broadcast(bounds)).withColumn("outcome", F.least(F.greatest("step", "lo"), F.col("hi")))
    return rows.groupBy("event", "outcome", kind.alias("kind")).agg(R(F.sum("m") + 1e-9).alias("m"))


@query("method_ablation", "D-24 J-18 A-16", f"""WITH {BUCKETS}, {OUTWARD}, {REALISED}, iso AS ({STATS}), edge2 AS (SELECT *, lead(strike) OVER w AS next_k, coalesce(lead(fit) OVER w, 0) AS hi, row_number() OVER w AS i FROM mo WINDOW w AS (PARTITION BY event ORDER BY strike)),
  b2 AS (SELECT event, strike AS low, coalesce(next_k, strike + 1) AS top, fit - hi AS mass FROM edge2 UNION ALL SELECT event, NULL, strike, 1 - fit FROM edge2 WHERE i = 1), out AS ({STATS.replace('FROM buckets)', 'FROM b2)')}),
  s AS (SELECT 'isotonic' AS method, event, mean FROM iso UNION ALL SELECT 'outward', event, mean FROM out) SELECT method, count(*) AS n, round(avg(abs(mean - realised)), 4) AS mae, round(avg(mean - realised), 4) AS bias FROM s JOIN re USING (event) GROUP BY method""", "ladders")
def method_ablation(v: Views) -> DataFrame:
    both = ladder_summary(fitted(v)).withColumn("method", F.lit("isotonic")).unionByName(ladder_summary(outward(v)).withColumn("method", F.lit("outward")))
    error = F.col("mean") - F.col("realised")
    return both.join(realised(v), "event").groupBy("method").agg(F.count("*").alias("n"), R(F.avg(F.abs(error)), 4).alias("mae"), R(F.avg(error), 4).alias("bias"))


@query("survey_bands", "D-25 J-6 X-5", """WITH f AS (SELECT day AS d, x FROM daily WHERE n % 3 = 0), s AS (SELECT day AS due, x AS survey FROM daily WHERE n % 5 = 0),
  m AS (SELECT due, survey, d, x, row_number() OVER (PARTITION BY due ORDER BY abs(d - due), d) AS k FROM s JOIN f ON abs(d - due) <= 3) SELECT CASE WHEN month(due) <= 4 THEN 'early' WHEN month(due) <= 8 THEN 'middle' ELSE 'late' END AS band, count(*) AS n, round(avg(abs(survey - x)), 2) AS mae, round(avg(CAST(survey = x AS INTEGER)), 6) AS exact FROM m WHERE k = 1 GROUP BY 1""", "daily")
def survey_bands(v: Views) -> DataFrame:
    from tidemark.operators.asof import asof_nearest

    rows = asof_nearest(v.daily.filter("n % 5 = 0").select(F.col("day").alias("due"), F.col("x").alias("survey")), v.daily.filter("n % 3 = 0").select(F.col("day").alias("d"), "x"), "due", "d", 3)
    band = D.cut(F.month("due"), [0, 4, 8, 12], ["early", "middle", "late"])
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), R(F.avg(F.abs(F.col("survey") - F.col("x"))), 2).alias("mae"), R(F.avg((F.col("survey") == F.col("x")).cast("int"))).alias("exact"))


@query("hairs", "D-21 A-24", f"WITH {MONTHLY} SELECT month, strftime(min(day), '%Y-%m-%d') AS first, string_agg(n, ',' ORDER BY day) AS path FROM m GROUP BY month", "daily")
def hairs(v: Views) -> DataFrame:
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda s: s["n"].cast("string")), ",")
    return monthly(v).groupBy("month").agg(F.min("day").cast("string").alias("first"), path.alias("path"))


CURVE_X = "cx AS (SELECT month, round(100 - price, 4) AS r, round(((100 - price) - lag(100 - price) OVER (ORDER BY month)) / 0.25, 4) AS x FROM curve)"


def curve_moves(v: Views) -> DataFrame:
    w = Window.orderBy("month")  # one row a month
    rate = 100 - F.col("price")
    return v.curve.select("month", R(rate, 4).alias("r"), R((rate - F.lag(rate).over(w)) / 0.25, 4).alias("x"))


@query("bucket_prob", "X-29", f"WITH {CURVE_X}, b AS (SELECT unnest([-99, -1, 0, 1, 2]) AS lo, unnest([-2, -1, 0, 1, 99]) AS hi) SELECT strftime(month, '%Y-%m') AS month, lo, round(CASE WHEN floor(x) BETWEEN lo AND hi THEN 1 - (x - floor(x)) ELSE 0 END + CASE WHEN floor(x) + 1 BETWEEN lo AND hi THEN x - floor(x) ELSE 0 END, 6) AS p FROM cx, b WHERE x IS NOT NULL", "curve")
def bucket_prob(v: Views) -> DataFrame:
    bands = F.inline(F.arrays_zip(F.array(*map(F.lit, (-99, -1, 0, 1, 2))).alias("lo"), F.array(*map(F.lit, (-2, -1, 0, 1, 99))).alias("hi")))
    rows = curve_moves(v).filter("x is not null").select("month", "x", bands)
    return rows.select(F.date_format("month", "yyyy-MM").alias("month"), "lo", R(D.bucket_probability(F.col("x"), F.col("lo"), F.col("hi"))).alias("p"))


@query("futures_lines", "D-29", f"WITH {CURVE_X}, b AS (SELECT unnest([-99, -1, 0, 1, 2]) AS lo, unnest([-2, -1, 0, 1, 99]) AS hi), p AS (SELECT month, lo, CASE WHEN floor(x) BETWEEN lo AND hi THEN 1 - (x - floor(x)) ELSE 0 END + CASE WHEN floor(x) + 1 BETWEEN lo AND hi THEN x - floor(x) ELSE 0 END AS p FROM cx, b WHERE x IS NOT NULL) SELECT strftime(month, '%Y-%m') AS month, round(sum(p), 6) AS total, count(*) FILTER (WHERE p > 0) AS live FROM p GROUP BY month", "curve")
def futures_lines(v: Views) -> DataFrame:
    rows = bucket_prob(v)
    return rows.groupBy("month").agg(R(F.sum("p")).alias("total"), F.count_if(F.col("p") > 0).alias("live"))


MEETING = "month(m) IN (1, 3, 5, 6, 7, 9, 11, 12)"
CHAIN = f"""g AS (SELECT a.month AS t, b.month AS m, date_diff('month', a.month, b.month) AS j, 100 - b.price AS r, 100 - c.price AS rn, 100 - a.price - 0.1 AS r0 FROM curve a JOIN curve b ON b.month >= a.month AND b.month <= a.month + INTERVAL 12 MONTH LEFT JOIN curve c ON c.month = CAST(b.month + INTERVAL 1 MONTH AS DATE)),
  h AS (SELECT t, m, j, r, r0, 5 + (month(m) * 7) % 20 AS d, day(last_day(m)) AS nd, CASE WHEN j < 12 AND month(m) NOT IN (4 + 8, 11, 5, 6, 12) THEN rn END AS rb, row_number() OVER (PARTITION BY t ORDER BY m) AS k FROM g WHERE {MEETING}),
  z(t, k, m, j, method, rbefore, rafter) AS (SELECT t, k, m, j, CASE WHEN rb IS NULL THEN 'A' ELSE 'B' END, r0, coalesce(rb, (nd * r - d * r0) / (nd - d)) FROM h WHERE k = 1
    UNION ALL SELECT h.t, h.k, h.m, h.j, CASE WHEN rb IS NULL THEN 'A' ELSE 'B' END, z.rafter, coalesce(rb, (nd * r - d * z.rafter) / (nd - d)) FROM z JOIN h ON h.t = z.t AND h.k = z.k + 1)"""


@query("implied_moves", "D-27", f"WITH RECURSIVE {CHAIN} SELECT strftime(t, '%Y-%m') AS t, strftime(m, '%Y-%m') AS meeting, CAST(j AS INTEGER) AS ahead, method, round((rafter - rbefore) / 0.25 + 1e-8, 5) AS x, round((rafter - first_value(rbefore) OVER (PARTITION BY t ORDER BY k)) / 0.25 + 1e-8, 5) AS cum FROM z", "curve")
def implied_moves(v: Views) -> DataFrame:
    """Chained moves at each meeting from each month's curve: a fold over the meetings in order, each from the last rate."""
    c = v.curve.select("month", (100 - F.col("price")).alias("r"))
    nxt = c.select(F.add_months("month", -1).alias("month"), F.col("r").alias("rn"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(12))).alias("j")
    grid = c.select(F.col("month").alias("t"), (F.col("r") - 0.1).alias("r0"), ahead).withColumn("month", F.expr("add_months(t, j)"))
    rows = grid.join(c, "month").join(nxt, "month", "left").filter(F.month("month").isin(1, 3, 5, 6, 7, 9, 11, 12))
    free = (F.col("j") < 12) & ~F.month("month").isin(12, 11, 5, 6)  # no meeting in the month after
    item = F.struct("month", "j", "r", F.when(free, F.col("rn")).alias("rb"), (F.lit(5) + (F.month("month") * 7) % 20).alias("d"), F.dayofmonth(F.last_day("month")).alias("nd"))
    per = rows.groupBy("t", "r0").agg(F.array_sort(F.collect_list(item)).alias("meetings"))
    kind = "array<struct<month:date,j:int,method:string,x:double,cum:double>>"
    start = F.struct(F.col("r0").alias("r"), F.lit(0.0).alias("cum"), F.array().cast(kind).alias("out"))

    def step(acc, m):
        after = F.coalesce(m["rb"], (m["nd"] * m["r"] - m["d"] * acc["r"]) / (m["nd"] - m["d"]))
        x = (after - acc["r"]) / 0.25
        row = F.struct(m["month"].alias("month"), m["j"].alias("j"), F.when(m["rb"].isNull(), "A").otherwise("B").alias("method"), x.alias("x"), (acc["cum"] + x).alias("cum"))
        return F.struct(after.alias("r"), (acc["cum"] + x).alias("cum"), F.concat(acc["out"], F.array(row)).alias("out"))

    out = per.select("t", F.inline(F.aggregate("meetings", start, step, lambda a: a["out"])))
    month = lambda c: F.date_format(c, "yyyy-MM")
    return out.select(month("t").alias("t"), month("month").alias("meeting"), F.col("j").alias("ahead"), "method", R(F.col("x") + 1e-8, 5).alias("x"), R(F.col("cum") + 1e-8, 5).alias("cum"))


CALENDAR = """cal AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', min(day)) AS DATE), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
  e AS (SELECT cal.day, CAST(date_trunc('month', cal.day) AS DATE) AS month, last_value(4 + (n % 10) / 100.0 IGNORE NULLS) OVER (ORDER BY cal.day) AS effr FROM cal LEFT JOIN daily USING (day)), f AS (SELECT *, coalesce(effr, 4.05) AS ef FROM e),
  c AS (SELECT day, month, ef, coalesce(sum(ef) OVER (PARTITION BY month ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS realised FROM f)"""


@query("next_meeting_move", "D-28 J-17 W-12 D-22", f"""WITH {CALENDAR}, mt AS (SELECT month, month + CAST(5 + (month(month) * 7) % 20 - 1 AS INTEGER) AS d FROM curve WHERE month(month) IN (1, 3, 5, 6, 7, 9, 11, 12)),
  n AS (SELECT c.*, d FROM c ASOF JOIN mt ON c.day < mt.d), k AS (SELECT n.*, CAST(date_trunc('month', d) AS DATE) AS own, 100 - a.price AS ra, 100 - o.price AS ro, month(d) IN (12, 11, 5, 6) AS busy FROM n LEFT JOIN curve a ON a.month = CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) LEFT JOIN curve o ON o.month = CAST(date_trunc('month', d) AS DATE)),
  v AS (SELECT *, CASE WHEN NOT busy AND ra IS NOT NULL THEN 'B' WHEN ro IS NOT NULL THEN 'A' END AS method, CASE WHEN month = own THEN day(day) - 1 ELSE 0 END AS nr, day(last_day(d)) AS nd FROM k)
  SELECT strftime(day, '%Y-%m-%d') AS day, strftime(d, '%Y-%m-%d') AS meeting, method, round((CASE method WHEN 'B' THEN ra ELSE (nd * ro - CASE WHEN nr > 0 THEN realised ELSE 0 END - (day(d) - nr) * ef) / (nd - day(d)) END - ef) * 100 + 1e-7, 4) AS bp FROM v WHERE method IS NOT NULL""", "daily curve")
def next_meeting_move(v: Views) -> DataFrame:
    """The move at the next meeting: from the month after, or un-blended from the meeting's own month with what is realised."""
    bounds = v.daily.agg(F.trunc(F.min("day"), "MM").alias("a"), F.max("day").alias("b"))
    cal = bounds.select(F.explode(F.sequence("a", "b")).alias("day")).join(v.daily.select("day", (F.lit(4.0) + (F.col("n") % 10) / 100.0).alias("e")), "day", "left").withColumn("month", F.trunc("day", "MM"))
    # A fill over a calendar of days: a row a day, whatever the size of the tables behind it.
    cal = cal.withColumn("ef", F.coalesce(F.last("e", True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), F.lit(4.05)))
    cal = cal.withColumn("realised", F.coalesce(F.sum("ef").over(Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    meetings = v.curve.filter(F.month("month").isin(1, 3, 5, 6, 7, 9, 11, 12)).select(F.expr("date_add(month, 4 + (month(month) * 7) % 20)").alias("d"))
    served = meetings.withColumn("last", F.lag("d").over(Window.orderBy("d"))).select("d", F.explode(F.sequence(F.coalesce("last", F.date_sub("d", 40)), F.date_sub("d", 1))).alias("day"))
    rows = cal.join(F.broadcast(served), "day").withColumn("own", F.trunc("d", "MM"))
    curve = lambda shift, name: v.curve.select(F.add_months("month", shift).alias("own"), (100 - F.col("price")).alias(name))
    rows = rows.join(F.broadcast(curve(-1, "ra")), "own", "left").join(F.broadcast(curve(0, "ro")), "own", "left")
    method = F.when(~F.month("d").isin(12, 11, 5, 6) & F.col("ra").isNotNull(), "B").when(F.col("ro").isNotNull(), "A")
    nr, nd, dd = F.when(F.col("month") == F.col("own"), F.dayofmonth("day") - 1).otherwise(0), F.dayofmonth(F.last_day("d")), F.dayofmonth("d")
    own = (nd * F.col("ro") - F.when(nr > 0, F.col("realised")).otherwise(0.0) - (dd - nr) * F.col("ef")) / (nd - dd)
    after = F.when(F.col("method") == "B", F.col("ra")).otherwise(own)
    rows = rows.withColumn("method", method).filter("method is not null")
    return rows.select(F.col("day").cast("string").alias("day"), F.col("d").cast("string").alias("meeting"), "method", R((after - F.col("ef")) * 100 + 1e-7, 4).alias("bp"))


@query("constant_horizon", "D-20 J-16", """WITH m AS (SELECT month AS meeting, price FROM curve WHERE month(month) % 2 = 1), r AS (SELECT c.month AS day, meeting, m.price, row_number() OVER (PARTITION BY c.month ORDER BY meeting) AS k FROM curve c JOIN m ON meeting > c.month)
  SELECT strftime(day, '%Y-%m') AS day, k, round((100 - price) * 100, 2) AS bp FROM r WHERE k IN (1, 3, 6)""", "curve")
def constant_horizon(v: Views) -> DataFrame:
    m = v.curve.filter(F.month("month") % 2 == 1).select(F.col("month").alias("meeting"), F.col("price").alias("mp"))
    ahead = m.withColumn("month", F.explode(F.sequence(F.add_months("meeting", -12), F.add_months("meeting", -1), F.expr("interval 1 month"))))
    rows = v.curve.select("month").join(ahead, "month").withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy("meeting")).cast("long"))
    return rows.filter(F.col("k").isin(1, 3, 6)).select(F.date_format("month", "yyyy-MM").alias("day"), "k", R((100 - F.col("mp")) * 100, 2).alias("bp"))
