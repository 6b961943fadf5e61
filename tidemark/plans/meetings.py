"""Policy meetings over the calendar of orders: target range, overnight rate, futures strip, starting rate and chained moves,
and the panel of two sources' expected moves before every meeting with its nine features.

All rates are whole thousandths of a percent until the last step, so sums by prefix differences are exact. Tables here have a
row for each calendar day, meeting or (meeting, day), however many orders stand behind them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import series as S

from .adapters import Views
from .basics import by_day
from .panels import R
from .registry import query

MONTHS = (1, 3, 5, 6, 7, 9, 11, 12)
WINDOW, LEAST = 10, 3  # rows and non-null rows of the spread's median
LISTED = 45  # days before a meeting in which it is quoted
HORIZONS = (1, 3, 5)
TAU = 5.0
STEP = 0.25
GROUPS = {
    "gap": "dynamics", "gap_chg_5": "dynamics", "gap_x_spread": "book", "gap_x_age": "book", "surprise_a": "news", "surprise_b": "news",
    "gap_x_news": "news", "drift": "news", "x_ff": "expectation",
}
FEATURES = list(GROUPS)
#: Predicted sign of each feature's coefficient; 0: none predicted.
SIGNS = {f: 0 if f in ("drift", "x_ff") else -1 for f in FEATURES}

# --- the same tables as SQL

SITTINGS = f"""span AS (SELECT min(day) AS a, max(day) AS b FROM daily),
  sittings AS (SELECT row_number() OVER (ORDER BY d) AS no, d, 400 + 25 * (CAST(pow(row_number() OVER (ORDER BY d), 2) AS BIGINT) % 6) AS level FROM (
    SELECT CASE WHEN month(m) = 6 AND year(m) % 2 = 0 THEN last_day(m) ELSE m + CAST(4 + (month(m) * 7) % 20 AS INTEGER) END AS d
    FROM (SELECT CAST(unnest(generate_series(date_trunc('month', a), b + INTERVAL 13 MONTH, INTERVAL 1 MONTH)) AS DATE) AS m FROM span) WHERE month(m) IN {MONTHS}))"""
RATES = f"""{SITTINGS}, rates AS (SELECT r.day, r.k, r.n, coalesce(c.level, 400) * 10 - 125 AS mid, coalesce(p.level, 400) * 10 - 125 + (r.k % 41 - 20) AS effr, coalesce(c.level, 400) AS upper
    FROM (SELECT day, n, CAST(floor(x * 100) AS BIGINT) AS k FROM daily) r ASOF LEFT JOIN sittings c ON r.day >= c.d ASOF LEFT JOIN sittings p ON r.day > p.d)"""
STARTING = f"""{RATES}, masked AS (SELECT *, effr - mid AS spread, CASE WHEN day NOT IN (SELECT d FROM sittings) THEN effr - mid END AS y FROM rates),
  held AS (SELECT *, list_filter(list(y) OVER (ORDER BY day ROWS {WINDOW - 1} PRECEDING), lambda v: v IS NOT NULL) AS l FROM masked),
  med AS (SELECT *, CASE WHEN len(l) >= {LEAST} THEN list_median(l) END AS m0 FROM held),
  starting AS (SELECT * EXCLUDE (l, m0, y), coalesce(last_value(m0 IGNORE NULLS) OVER (ORDER BY day), first_value(m0 IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS med FROM med),
  cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
  every AS (SELECT cal.day, last_value(effr IGNORE NULLS) OVER (ORDER BY cal.day) AS effr, last_value(mid IGNORE NULLS) OVER (ORDER BY cal.day) AS mid, last_value(med IGNORE NULLS) OVER (ORDER BY cal.day) AS med FROM cal LEFT JOIN starting USING (day))"""


class Meetings(Views):
    """The views of this module, over those of the adapters."""

    @classmethod
    def of(cls, v: Views) -> Meetings:
        return cls(v.spark, v.root)

    @cached_property
    def span(self) -> DataFrame:
        return self.daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))

    @cached_property
    def sittings(self) -> DataFrame:
        """(no, d, level): every meeting up to a year behind the last day, with the range's upper end from it on, in bp."""
        months = self.span.select(F.explode(F.sequence(F.trunc("a", "MM"), F.add_months(F.trunc("b", "MM"), 13), F.expr("interval 1 month"))).alias("m")).filter(F.month("m").isin(*MONTHS))
        day = F.when((F.month("m") == 6) & (F.year("m") % 2 == 0), F.last_day("m")).otherwise(F.expr("date_add(m, 4 + (month(m) * 7) % 20)"))
        rows = months.select(day.alias("d")).withColumn("no", F.row_number().over(Window.orderBy("d")).cast("long"))  # a row a meeting
        return rows.withColumn("level", F.lit(400) + 25 * (F.col("no") * F.col("no") % 6))

    @cached_property
    def rates(self) -> DataFrame:
        """(day, k, n, mid, effr, upper): the range moves on the day of a meeting, the overnight rate on the next."""
        served = self.sittings.withColumn("until", F.coalesce(F.lead("d").over(Window.orderBy("d")), F.date_add("d", 60)))
        in_force = served.select("level", F.explode(F.sequence("d", F.date_sub("until", 1))).alias("day"))
        days = self.daily.select("day", "n", F.floor(F.col("x") * 100).alias("k"))
        rows = days.join(in_force.withColumnRenamed("level", "now"), "day", "left").join(in_force.select(F.date_add("day", 1).alias("day"), F.col("level").alias("last")), "day", "left")
        rows = rows.select("day", "n", "k", F.coalesce("now", F.lit(400)).alias("upper"), F.coalesce("last", F.lit(400)).alias("last"))
        return rows.select("day", "k", "n", (F.col("upper") * 10 - 125).alias("mid"), (F.col("last") * 10 - 125 + (F.col("k") % 41 - 20)).alias("effr"), "upper")

    @cached_property
    def starting(self) -> DataFrame:
        """rates with spread and med, the median spread over the last rows that are no meeting days, filled both ways."""
        decided = self.sittings.select(F.col("d").alias("day"), F.lit(True).alias("decided"))
        rows = self.rates.join(decided, "day", "left").withColumn("spread", F.col("effr") - F.col("mid")).withColumn("y", F.when(F.col("decided").isNull(), F.col("spread")))
        rows = rows.withColumn("m0", S.rolling_median("y", by_day(), WINDOW, LEAST))
        med = F.coalesce(S.forward_fill("m0", by_day()), S.backward_fill("m0", by_day()))
        return rows.withColumn("med", med).drop("decided", "y", "m0")

    @cached_property
    def every_day(self) -> DataFrame:
        """(day, effr, mid, med) of every calendar day; a day without a row carries the last one's."""
        calendar = self.span.select(F.explode(F.sequence("a", "b")).alias("day"))
        rows = calendar.join(self.starting.select("day", "effr", "mid", "med"), "day", "left")
        return rows.select("day", *(S.forward_fill(c, by_day()).alias(c) for c in ("effr", "mid", "med")))

    @cached_property
    def paths(self) -> DataFrame:
        return chained_moves(self)

    @cached_property
    def panel(self) -> DataFrame:
        """(event, d, day, k, f, max_spread, age): the two sources' expected moves on the days a meeting is listed, the one
        from orders, the other from the lines shipped that day, each of the keys with the meeting's parity."""
        scaled = lambda cents, n: ((F.floor(F.sum(cents) / F.count(n)) % 2001) - 1000) / 100.0
        cents = lambda c: F.round(F.col(c) * 100).cast("long")
        orders = self.table("orders").groupBy(F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2).alias("par")).agg(scaled(cents("o_totalprice"), "*").alias("k"))
        age = F.sum(F.col("l_linenumber") * F.col("l_quantity").cast("long")) / F.sum(F.col("l_quantity").cast("long"))
        lines = self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") % 2).alias("par")).agg(scaled(cents("l_extendedprice"), "*").alias("f"), F.max("l_tax").alias("max_spread"), F.log1p(age).alias("age"))
        listed = self.sittings.crossJoin(F.broadcast(self.span)).filter("d <= b").select(F.col("no").alias("event"), "d", (F.col("no") % 2).alias("par"), F.explode(F.sequence(F.date_sub("d", LISTED), F.date_sub("d", 1))).alias("day"))
        return listed.join(orders, ["day", "par"]).join(lines, ["day", "par"]).drop("par")

    @cached_property
    def news(self) -> DataFrame:
        """(day, surprise_a, surprise_b, weight) of every calendar day: the last release's surprise, and its recency, decayed.

        Series a is released on the 12th and b on the 5th of a month, where that day has orders; every seventh release
        has no surprise, and counts for the recency alone."""
        calendar = self.span.select(F.explode(F.sequence("a", "b")).alias("day")).join(self.rates.select("day", "k"), "day", "left")
        number = F.dayofmonth("day")
        z = F.when(F.col("k") % 7 != 0, (F.col("k") % 401 - 200) / 100.0)
        release = lambda of: F.last(F.when(of & F.col("k").isNotNull() & z.isNotNull(), F.struct(z.alias("z"), F.col("day").alias("at"))), True).over(upto)
        upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
        rows = calendar.withColumn("ra", release(number == 12)).withColumn("rb", release(number == 5))
        rows = rows.withColumn("latest", F.last(F.when(number.isin(5, 12) & F.col("k").isNotNull(), F.col("day")), True).over(upto))
        decay = lambda at: F.exp(-F.datediff("day", at) / TAU)
        surprise = lambda r: F.coalesce(F.col(f"{r}.z") * decay(F.col(f"{r}.at")), F.lit(0.0))
        return rows.select("day", surprise("ra").alias("surprise_a"), surprise("rb").alias("surprise_b"), F.coalesce(decay(F.col("latest")), F.lit(0.0)).alias("weight"))

    @cached_property
    def features(self) -> DataFrame:
        """(event, d, day, the nine FEATURES, k, f, target_h and date_h for each horizon) in the order of days."""
        level = F.lag("upper").over(by_day())
        moved = F.when(F.col("upper") == level, F.col("spread") - F.col("med")) / 10.0
        drift = self.starting.withColumn("moved", moved).select("day", F.coalesce(F.lag("moved").over(by_day()), F.lit(0.0)).alias("drift"))
        rows = self.panel.join(self.news, "day").join(drift, "day").withColumn("gap", F.col("k") - F.col("f"))
        w = Window.partitionBy("event").orderBy("day")  # LISTED rows at most
        ahead = [c for h in HORIZONS for c in ((F.lead("gap", h).over(w) - F.col("gap")).alias(f"target_{h}"), F.lead("day", h).over(w).alias(f"date_{h}"))]
        own = {"gap_chg_5": F.col("gap") - F.lag("gap", 5).over(w), "gap_x_spread": F.col("gap") * F.col("max_spread"), "gap_x_age": F.col("gap") * F.col("age"), "gap_x_news": F.col("gap") * F.col("weight"), "x_ff": F.col("f")}
        return rows.select("event", "d", "day", *(own[f].alias(f) if f in own else F.col(f) for f in FEATURES), "k", "f", *ahead)


@query("starting_rate", "D-26 D-22 W-9 W-11 U-2", f"WITH {STARTING} SELECT strftime(day, '%Y-%m-%d') AS day, effr / 1000.0 AS effr, round(med / 1000.0, 6) AS spread, round((mid + med) / 1000.0, 6) AS r0 FROM every", "daily")
def starting_rate(v: Views) -> DataFrame:
    """The rate a day starts from: the range's midpoint and the median spread to it, for every calendar day."""
    rows = Meetings.of(v).every_day
    return rows.select(F.col("day").cast("string").alias("day"), (F.col("effr") / 1000.0).alias("effr"), R(F.col("med") / 1000.0).alias("spread"), R((F.col("mid") + F.col("med")) / 1000.0).alias("r0"))


# Contract j of a day's strip pays the average rate of the month j ahead, 0 to 12: a level that drifts from the day's own rate.
STRIP = "(effr + ((k * (j + 3)) % 61 - 30))"
PATHS = f"""{STARTING}, total AS (SELECT day, sum(effr) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS s FROM every),
  base AS (SELECT s.day AS t, s.k, s.effr, (s.mid + s.med) AS r0, coalesce((SELECT sum(e.effr) FROM every e WHERE e.day >= date_trunc('month', s.day) AND e.day < s.day), 0) AS realised FROM starting s, span WHERE s.day >= date_trunc('month', a) + INTERVAL 1 MONTH),
  up AS (SELECT t, k, effr, r0, realised, d, date_diff('month', t, d) AS j, day(last_day(d)) AS nd, day(d) AS dd FROM base JOIN sittings ON d > t AND date_diff('month', t, d) <= 12),
  link AS (SELECT *, {STRIP} AS r, row_number() OVER (PARTITION BY t ORDER BY d) AS step,
    CASE WHEN j < 12 AND lead(j) OVER (PARTITION BY t ORDER BY d) IS DISTINCT FROM j + 1 THEN {STRIP.replace("j + 3", "j + 4")} END AS rb FROM up),
  path(t, step, d, j, nb, before, a, b) AS (SELECT t, step, d, j, rb, CAST(r0 AS DOUBLE), CASE WHEN dd < nd THEN CASE WHEN j = 0 THEN (nd * r - realised - (dd - (day(t) - 1)) * r0) / CAST(nd - dd AS DOUBLE) ELSE (nd * r - dd * r0) / CAST(nd - dd AS DOUBLE) END END, CAST(rb AS DOUBLE) FROM link WHERE step = 1
    UNION ALL SELECT l.t, l.step, l.d, l.j, l.rb, coalesce(p.b, p.a), CASE WHEN l.dd < l.nd THEN (l.nd * l.r - l.dd * coalesce(p.b, p.a)) / CAST(l.nd - l.dd AS DOUBLE) END, CAST(l.rb AS DOUBLE) FROM path p JOIN link l ON l.t = p.t AND l.step = p.step + 1 WHERE coalesce(p.b, p.a) IS NOT NULL)"""


def chained_moves(m: Meetings) -> DataFrame:
    """(t, meeting, ahead, method, before, after, x, cum, gap) for each day and upcoming meeting, each from the rate after the
    one before. The month after a meeting gives its rate directly (B) if it has no meeting itself; otherwise the meeting's own
    month is un-blended (A), with the days that are past taken from the overnight rate. A meeting on the last day of its month
    has no A; without B either, it and all later ones are left out that day."""
    total = F.sum("effr").over(by_day().rowsBetween(Window.unboundedPreceding, -1))
    upto = m.every_day.select("day", F.coalesce(total, F.lit(0)).alias("s"))  # whole numbers, so differences are exact
    start = upto.select(F.col("day").alias("first"), F.col("s").alias("s0"))
    days = m.starting.join(upto, "day").withColumn("first", F.trunc("day", "MM")).join(start, "first").crossJoin(F.broadcast(m.span)).filter(F.col("day") >= F.add_months(F.trunc("a", "MM"), 1))
    days = days.select(F.col("day").alias("t"), "k", "effr", (F.col("mid") + F.col("med")).alias("r0"), (F.col("s") - F.col("s0")).alias("realised"))
    price = lambda j: F.col("effr") + (F.col("k") * (j + 3)) % 61 - 30
    sittings = m.sittings.select("d", F.trunc("d", "MM").alias("month"))  # one a month at most
    ahead = days.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("month", F.expr("add_months(trunc(t, 'MM'), j)")).join(sittings, "month").filter("d > t")
    item = F.struct("d", "j", price(F.col("j")).alias("r"), price(F.col("j") + 1).alias("next"), F.dayofmonth("d").alias("dd"), F.dayofmonth(F.last_day("d")).alias("nd"))
    per = ahead.groupBy("t", "r0", "realised").agg(F.array_sort(F.collect_list(item)).alias("meetings"))  # 13 at most
    kind = "array<struct<meeting:date,ahead:int,method:string,before:double,after:double,x:double,cum:double,gap:double>>"
    begin = F.struct(F.col("r0").cast("double").alias("r"), F.lit(False).alias("stopped"), F.array().cast(kind).alias("out"))
    months = F.transform("meetings", lambda x: x["j"])

    def step(acc: Column, x: Column) -> Column:
        past = F.when(x["j"] == 0, F.dayofmonth("t") - 1).otherwise(0)
        known = F.when(x["j"] == 0, F.col("realised")).otherwise(0)
        a = F.when(x["dd"] < x["nd"], (x["nd"] * x["r"] - known - (x["dd"] - past) * acc["r"]) / (x["nd"] - x["dd"]))
        b = F.when((x["j"] < 12) & ~F.array_contains(months, x["j"] + 1), x["next"].cast("double"))
        after = F.coalesce(b, a)
        move = (after - acc["r"]) / (STEP * 1000)
        row = F.struct(x["d"].alias("meeting"), x["j"].alias("ahead"), F.when(b.isNull(), "A").otherwise("B").alias("method"), acc["r"].alias("before"), after.alias("after"), move.alias("x"), ((after - F.col("r0")) / (STEP * 1000)).alias("cum"), ((a - b) / 10).alias("gap"))
        stopped = acc["stopped"] | after.isNull()
        return F.struct(F.coalesce(after, acc["r"]).alias("r"), stopped.alias("stopped"), F.when(stopped, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    return per.select("t", F.inline(F.aggregate("meetings", begin, step, lambda acc: acc["out"])))


@query("implied_path", "D-27 W-12", f"""WITH RECURSIVE {PATHS} SELECT strftime(t, '%Y-%m-%d') AS t, strftime(d, '%Y-%m-%d') AS meeting, CAST(j AS INTEGER) AS ahead, CASE WHEN nb IS NULL THEN 'A' ELSE 'B' END AS method,
  round((coalesce(b, a) - before) / {STEP * 1000}, 8) AS x, round((coalesce(b, a) - first_value(before) OVER (PARTITION BY t ORDER BY step)) / {STEP * 1000}, 8) AS cum, round((a - b) / 10, 8) AS gap_ab_bp FROM path WHERE coalesce(b, a) IS NOT NULL""", "daily")
def implied_path(v: Views) -> DataFrame:
    rows = Meetings.of(v).paths
    return rows.select(F.col("t").cast("string").alias("t"), F.col("meeting").cast("string").alias("meeting"), "ahead", "method", R("x", 8).alias("x"), R("cum", 8).alias("cum"), R("gap", 8).alias("gap_ab_bp"))


_AHEAD = ", ".join(f"lead(gap, {h}) OVER w - gap AS target_{h}, lead(day, {h}) OVER w AS date_{h}" for h in HORIZONS)
_SCALED = "((CAST(floor(CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS BIGINT) % 2001) - 1000) / 100.0::DOUBLE"
PANEL = f"""{STARTING}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 2 AS par, {_SCALED.format(c="o_totalprice")} AS k FROM orders GROUP BY ALL),
  l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey % 2 AS par, {_SCALED.format(c="l_extendedprice")} AS f, max(l_tax) AS max_spread, ln(1 + CAST(sum(l_linenumber * CAST(l_quantity AS BIGINT)) AS DOUBLE) / sum(CAST(l_quantity AS BIGINT))) AS age FROM lineitem GROUP BY ALL),
  panel AS (SELECT no AS event, d, o.day, k, f, k - f AS gap, max_spread, age FROM sittings, span, o, l WHERE d <= b AND o.par = no % 2 AND l.par = o.par AND l.day = o.day AND o.day BETWEEN d - {LISTED} AND d - 1)"""
TABLE = f"""{PANEL}, rel AS (SELECT day, day(day) AS dom, CASE WHEN k % 7 <> 0 THEN (k % 401 - 200) / 100.0::DOUBLE END AS z FROM rates WHERE day(day) IN (5, 12)),
  ra AS (SELECT * FROM rel WHERE dom = 12 AND z IS NOT NULL), rb AS (SELECT * FROM rel WHERE dom = 5 AND z IS NOT NULL),
  drift AS (SELECT day, coalesce(lag(moved) OVER (ORDER BY day), 0) AS drift FROM (SELECT day, CASE WHEN upper = lag(upper) OVER (ORDER BY day) THEN spread - med END / 10.0 AS moved FROM starting)),
  joined AS (SELECT p.*, coalesce(ra.z * exp(-(p.day - ra.day) / {TAU}), 0) AS surprise_a, coalesce(rb.z * exp(-(p.day - rb.day) / {TAU}), 0) AS surprise_b, coalesce(exp(-(p.day - rel.day) / {TAU}), 0) AS weight, drift
    FROM panel p ASOF LEFT JOIN ra ON p.day >= ra.day ASOF LEFT JOIN rb ON p.day >= rb.day ASOF LEFT JOIN rel ON p.day >= rel.day JOIN drift ON drift.day = p.day),
  feats AS (SELECT event, d, day, gap, gap - lag(gap, 5) OVER w AS gap_chg_5, gap * max_spread AS gap_x_spread, gap * age AS gap_x_age, surprise_a, surprise_b, gap * weight AS gap_x_news, drift, f AS x_ff, k, f, {_AHEAD}
    FROM joined WINDOW w AS (PARTITION BY event ORDER BY day))"""
USES = "daily"
_LISTING = ", ".join(f"round({c}, 6) AS {c}" for c in [*FEATURES, *(f"target_{h}" for h in HORIZONS)])


@query("meeting_features", "D-32 J-5 W-6 W-16 X-12", f"WITH {TABLE} SELECT event, strftime(day, '%Y-%m-%d') AS day, {_LISTING}, strftime(date_5, '%Y-%m-%d') AS date_5 FROM feats", USES)
def meeting_features(v: Views) -> DataFrame:
    """The nine features and the changes of the gap over each horizon."""
    rows = Meetings.of(v).features
    return rows.select("event", F.col("day").cast("string").alias("day"), *(R(c).alias(c) for c in [*FEATURES, *(f"target_{h}" for h in HORIZONS)]), F.col("date_5").cast("string").alias("date_5"))
