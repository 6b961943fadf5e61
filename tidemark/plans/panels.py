"""Forecast panels, snapshots, end-of-day panels and the other named queries over quotes and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.domain import ET, local_date, local_instant
from tidemark.operators.asof import asof_join, asof_nearest, asof_small
from tidemark.operators.ranges import exact_quantiles, range_cuts, range_of
from tidemark.operators.series import day_sequence, durations, latest

from .adapters import Views
from .registry import query

HORIZONS = (1, 2, 3, 5, 7, 10, 14, 21, 29, 30)
R = lambda c, n=6: F.round(c, n)
SEC = lambda c: F.unix_seconds(F.col(c))
# The New York clock is five hours behind UTC throughout the tables' January.
LOCAL16 = "CAST({day} AS TIMESTAMP) + INTERVAL 21 HOUR"


def forecasts(v: Views, hour: int = 16) -> DataFrame:
    """Each contract's quote in force at an hour of the day h days before its close, for each horizon h.

    Counts and sums of an event are aggregations joined back, a row for each event and horizon, so no task holds an event's
    contracts; the as-of join spreads a contract's quotes over their days."""
    listed = v.contracts.groupBy("event").agg(F.count("*").alias("buckets"))
    grid = v.contracts.withColumn("h", F.explode(F.array(*map(F.lit, HORIZONS))))
    grid = grid.withColumn("snapshot_ts", local_instant(F.date_sub(local_date(F.col("close_ts")), F.col("h")), hour))
    quotes = v.quotes.select("ticker", "ts", "bid", "ask", F.col("mid").alias("p"), "spread")
    rows = asof_join(grid, quotes, ["ticker"], "snapshot_ts", "ts", bucket=F.to_date)
    whole = rows.groupBy("event", "h").agg(F.count("p").alias("quoted"), F.sum("p").alias("total"))
    q = F.when(F.col("quoted") == F.col("buckets"), F.col("p") / F.col("total"))
    return rows.join(whole.join(listed, "event"), ["event", "h"]).select(
        "ticker", "event", "h", (F.col("result") == "yes").cast("int").alias("y"), "p", q.alias("q"), "spread",
        ((F.unix_micros("snapshot_ts") - F.unix_micros("ts")) / 86400e6).alias("age_days"), ((F.col("p") < 0.01) | (F.col("p") >= 0.99)).alias("floor"), "bid",
    )


FORECASTS = f"""asked AS (SELECT ticker, event, result, h, {LOCAL16.format(day="(DATE '2024-01-30' - CAST(h AS INTEGER))")} AS moment FROM contracts, unnest({list(HORIZONS)}) AS t(h)),
  newest AS (SELECT ticker, h, any_value(event) AS event, any_value(result) AS result, any_value(moment) AS moment, max(ts) AS ts FROM asked JOIN quotes USING (ticker) WHERE ts <= moment GROUP BY ticker, h),
  priced AS (SELECT newest.*, mid AS p, spread, bid FROM newest JOIN quotes USING (ticker, ts)), listed AS (SELECT event, count(*) AS k FROM contracts GROUP BY event),
  sums AS (SELECT event, h, sum(p) AS s, count(p) AS n FROM priced GROUP BY event, h),
  forecasts AS (SELECT ticker, event, h, CAST(result = 'yes' AS INTEGER) AS y, p, CASE WHEN n = k THEN p / s END AS q, spread, epoch(moment - ts) / 86400.0 AS age_days, NOT (p >= 0.01 AND p < 0.99) AS floor, bid
    FROM priced JOIN sums USING (event, h) JOIN listed USING (event))"""
FORECAST_USES = "contracts quotes"


@query("forecasts_panel", "T-3 J-1 J-10 W-3 W-4 X-18 X-19 X-21 X-23 F-8 S-1", f"WITH {FORECASTS} SELECT ticker, event, h, y, round(p, 6) AS p, round(q, 6) AS q, round(spread, 6) AS spread, round(age_days, 6) AS age_days, floor FROM forecasts", FORECAST_USES)
def forecasts_panel(v: Views) -> DataFrame:
    return forecasts(v).select("ticker", "event", "h", "y", R("p").alias("p"), R("q").alias("q"), R("spread").alias("spread"), R("age_days").alias("age_days"), "floor")


@query("forecasts_ladder", "T-3 W-5 J-1", f"""WITH {FORECASTS} SELECT event, ticker, h, round(bid, 6) AS bid, max(age_days) OVER (PARTITION BY event) >= 1 AS old FROM
  (SELECT event, ticker, h, bid, round(age_days, 6) AS age_days FROM forecasts WHERE bid IS NOT NULL)""", FORECAST_USES)
def forecasts_ladder(v: Views) -> DataFrame:
    """The latest row is taken first and dropped then if its bid is null: no reaching back."""
    rows = forecasts(v).filter("bid is not null").withColumn("age_days", R("age_days"))
    old = rows.groupBy("event").agg((F.max("age_days") >= 1).alias("old"))
    return rows.join(old, "event").select("event", "ticker", "h", R("bid").alias("bid"), "old")


@query("snapshots_grid", "T-4 S-23 J-1", """WITH g AS (SELECT ticker, d AS day, CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR AS snap FROM contracts, (SELECT unnest([DATE '2024-01-05', DATE '2024-01-12', DATE '2024-01-26']) AS d))
  SELECT g.ticker, strftime(day, '%Y-%m-%d') AS day, quote_id, round(q.mid, 6) AS mid FROM g ASOF JOIN quotes q ON g.ticker = q.ticker AND g.snap >= q.ts""", "contracts quotes")
def snapshots_grid(v: Views) -> DataFrame:
    days = v.spark.createDataFrame([("2024-01-05",), ("2024-01-12",), ("2024-01-26",)], "day string").withColumn("day", F.to_date("day"))
    grid = v.contracts.select("ticker").crossJoin(F.broadcast(days)).withColumn("at", local_instant(F.col("day"), 15))
    found = asof_join(grid, v.quotes.select("ticker", "ts", "quote_id", "mid"), ["ticker"], "at", "ts", bucket=F.to_date)
    return found.select("ticker", F.col("day").cast("string").alias("day"), "quote_id", R("mid").alias("mid"))


@query("last_trade_age", "J-3 X-22 T-6 X-6 X-7 X-9 A-14", """WITH g AS (SELECT ticker, event, CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR AS snap FROM contracts, (SELECT unnest([DATE '2024-01-02', DATE '2024-01-20']) AS d)),
  j AS (SELECT g.*, t.ts, least(coalesce(date_diff('second', t.ts, g.snap), 604800), 604800) AS age FROM g ASOF LEFT JOIN trades t ON g.ticker = t.ticker AND g.snap >= t.ts)
  SELECT event, epoch(snap)::BIGINT AS at_s, count(*) AS n, count(ts) AS traded, round(ln(1 + sum(age * (ticker % 7 + 1)) / sum(ticker % 7 + 1)), 6) AS log_age FROM j GROUP BY event, snap""", "contracts trades")
def last_trade_age(v: Views) -> DataFrame:
    days = F.explode(F.array(F.lit("2024-01-02"), F.lit("2024-01-20")))
    grid = v.contracts.select("ticker", "event", days.alias("day")).withColumn("at", local_instant(F.to_date("day"), 15))
    rows = asof_join(grid, v.trades.select("ticker", "ts"), ["ticker"], "at", "ts", how="left", bucket=F.to_date)
    age = F.least(F.coalesce(SEC("at") - SEC("ts"), F.lit(604800)), F.lit(604800))
    weight = F.col("ticker") % 7 + 1
    return rows.groupBy("event", SEC("at").alias("at_s")).agg(F.count("*").alias("n"), F.count("ts").alias("traded"), R(F.log1p(F.sum(age * weight) / F.sum(weight))).alias("log_age"))


def end_of_day(v: Views, of: str | None = None) -> DataFrame:
    """Every contract's last quote before the end of each day (strictly), with the day's volume; of: a filter on the contracts,
    which quotes are reduced to before anything else."""
    contracts, quotes = v.contracts, v.quotes
    if of:
        contracts = contracts.filter(of)
        quotes = quotes.join(contracts.select("ticker"), "ticker", "left_semi")
    grid = contracts.select("ticker", F.explode(day_sequence(local_date(F.col("open_ts")), F.lit("2024-01-30").cast("date"))).alias("day"))
    grid = grid.withColumn("day_end", local_instant(F.date_add("day", 1), 0))
    rows = asof_join(grid, quotes.select("ticker", "ts", "mid", "spread", "quote_id"), ["ticker"], "day_end", "ts", strict=True, bucket=F.to_date)
    volume = quotes.groupBy("ticker", local_date(F.col("ts")).alias("day")).agg(F.sum("size").alias("volume"))
    return rows.join(volume, ["ticker", "day"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


EOD = """days AS (SELECT ticker, CAST(unnest(generate_series(CAST(open_ts - INTERVAL 5 HOUR AS DATE), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM contracts),
  vol AS (SELECT ticker, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, sum(size) AS volume FROM quotes GROUP BY 1, 2),
  eod AS (SELECT d.ticker, d.day, q.ts, q.mid, q.spread, q.quote_id, coalesce(vol.volume, 0) AS volume FROM (SELECT *, CAST(day + 1 AS TIMESTAMP) + INTERVAL 5 HOUR AS day_end FROM days) d
    ASOF JOIN quotes q ON d.ticker = q.ticker AND d.day_end > q.ts LEFT JOIN vol ON vol.ticker = d.ticker AND vol.day = d.day)"""


@query("daily_eod", "U-7 U-10 J-2 J-9 X-7 X-24", f"WITH {EOD} SELECT ticker, strftime(day, '%Y-%m-%d') AS day, quote_id, round(mid, 6) AS mid, round(volume, 4) AS volume FROM eod", "contracts quotes")
def daily_eod(v: Views) -> DataFrame:
    return end_of_day(v).select("ticker", F.col("day").cast("string").alias("day"), "quote_id", R("mid").alias("mid"), R("volume", 4).alias("volume"))


@query("ladder_daily", "U-10 W-5", f"WITH {EOD} SELECT event, strftime(day, '%Y-%m-%d') AS day, count(*) AS quoted, round(sum(mid), 6) AS total, round(max(max(mid)) OVER (PARTITION BY event), 6) AS highest FROM eod JOIN contracts USING (ticker) GROUP BY event, day", "contracts quotes")
def ladder_daily(v: Views) -> DataFrame:
    rows = end_of_day(v).join(v.contracts.select("ticker", "event"), "ticker").groupBy("event", "day").agg(F.count("*").alias("quoted"), F.sum("mid").alias("total"), F.max("mid").alias("top"))
    return rows.select("event", F.col("day").cast("string").alias("day"), "quoted", R("total").alias("total"), R(F.max("top").over(Window.partitionBy("event"))).alias("highest"))


@query("hourly_path", "T-5 U-7 X-20 F-9 A-7", """WITH b AS (SELECT ticker, date_trunc('hour', min(ts)) + INTERVAL 1 HOUR AS a FROM quotes WHERE ticker IN (SELECT ticker FROM contracts WHERE event = 3) GROUP BY ticker),
  g AS (SELECT ticker, unnest(generate_series(a, TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR)) AS snap FROM b)
  SELECT g.ticker, epoch(snap)::BIGINT AS at_s, quote_id FROM g ASOF JOIN quotes q ON g.ticker = q.ticker AND g.snap >= q.ts""", "contracts quotes")
def hourly_path(v: Views) -> DataFrame:
    own = v.spark.sql("select * from {c} where event = :event", args={"event": 3}, c=v.contracts).select("ticker")
    quotes = v.quotes.join(own, "ticker", "left_semi").select("ticker", "ts", "quote_id")
    first = quotes.groupBy("ticker").agg((F.date_trunc("hour", F.min("ts")) + F.expr("interval 1 hour")).alias("a"))
    stop = F.lit("2024-01-31 00:00:00").cast("timestamp")
    hours = F.when(F.col("a") <= stop, F.sequence("a", stop, F.expr("interval 1 hour"))).otherwise(F.array().cast("array<timestamp>"))
    grid = first.select("ticker", F.explode(hours).alias("at"))
    return asof_join(grid, quotes, ["ticker"], "at", "ts", bucket=F.to_date).select("ticker", SEC("at").alias("at_s"), "quote_id")


@query("asof_nearest", "J-6", """WITH l AS (SELECT day AS ld, n FROM daily WHERE n % 3 = 0), r AS (SELECT day AS rd, x FROM daily WHERE n % 5 = 0),
  m AS (SELECT ld, n, rd, x, row_number() OVER (PARTITION BY ld ORDER BY abs(rd - ld), rd) AS k FROM l JOIN r ON abs(rd - ld) <= 3)
  SELECT strftime(ld, '%Y-%m-%d') AS ld, n, strftime(rd, '%Y-%m-%d') AS rd, x FROM m WHERE k = 1""", "daily")
def nearest(v: Views) -> DataFrame:
    left, right = v.daily.filter("n % 3 = 0").select(F.col("day").alias("ld"), "n"), v.daily.filter("n % 5 = 0").select(F.col("day").alias("rd"), "x")
    return asof_nearest(left, right, "ld", "rd", 3).select(F.col("ld").cast("string").alias("ld"), "n", F.col("rd").cast("string").alias("rd"), "x")


@query("asof_gap_bound", "J-4", """SELECT t.trade_id, q.quote_id, date_diff('day', CAST(q.ts AS DATE), CAST(t.ts AS DATE)) AS gap FROM trades t ASOF JOIN quotes q ON t.ticker = q.ticker AND t.ts >= q.ts
  WHERE date_diff('day', CAST(q.ts AS DATE), CAST(t.ts AS DATE)) BETWEEN 0 AND 4""", "trades quotes")
def gap_bound(v: Views) -> DataFrame:
    rows = asof_join(v.trades, v.quotes.select("ticker", F.col("ts").alias("quote_ts"), "quote_id"), ["ticker"], "ts", "quote_ts", bucket=F.to_date)
    return rows.withColumn("gap", F.datediff(F.to_date("ts"), F.to_date("quote_ts")).cast("long")).filter("gap between 0 and 4").select("trade_id", "quote_id", "gap")


@query("asof_unkeyed", "J-5", """SELECT t.trade_id, n.n_id FROM trades t ASOF JOIN (SELECT max(event_id) AS n_id, ts AS n_ts FROM events WHERE event_type = 'error' GROUP BY ts) n ON t.ts >= n.n_ts""", "trades")
def unkeyed(v: Views) -> DataFrame:
    news = v.events.filter("event_type = 'error'").groupBy(F.col("ts").alias("n_ts")).agg(F.max("event_id").alias("n_id"))
    cuts = range_cuts(v.trades.select(F.unix_micros("ts").alias("at")), "at")
    left = v.trades.select("trade_id", F.unix_micros("ts").alias("at"))
    return asof_join(left, news.select(F.unix_micros("n_ts").alias("n_at"), "n_id"), [], "at", "n_at", bucket=range_of(cuts)).select("trade_id", "n_id")


def open_minutes(v: Views) -> DataFrame:
    """(u, t, session): the minutes of every day of the events at which the exchange is open, in UTC and in New York, Sunday 18:00 to
    Friday 17:00 without the hour from 17:00, and the session's day, which begins at 18:00 the day before."""
    span = v.events.agg(F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b"))
    minutes = span.select(F.explode(F.expr("sequence(a, b + interval 1 day - interval 1 minute, interval 1 minute)")).alias("u"))
    rows = minutes.withColumn("t", F.from_utc_timestamp("u", ET))
    day, hour = F.weekday("t"), F.hour("t")
    is_open = (hour != 17) & (day != 5) & ~((day == 4) & (hour >= 17)) & ~((day == 6) & (hour < 18))
    return rows.filter(is_open).withColumn("session", F.to_date(F.col("t") + F.expr("interval 6 hours")))


SESSION_ROWS = 1 << 18  # rows of a range of time that one task takes


@query("session_panel", "T-8 J-5 U-12 U-14", """WITH sp AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL 1 MINUTE AS b FROM events), l AS (SELECT u, u - INTERVAL 5 HOUR AS t FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS u FROM sp)),
  g AS (SELECT * FROM l WHERE hour(t) <> 17 AND NOT (isodow(t) = 6) AND NOT (isodow(t) = 5 AND hour(t) >= 17) AND NOT (isodow(t) = 7 AND hour(t) < 18) AND minute(t) % 5 = 0),
  q AS (SELECT ts AS q_ts, max(quote_id) AS q_id FROM quotes GROUP BY ts), tr AS (SELECT ts AS t_ts, max(trade_id) AS t_id FROM trades GROUP BY ts),
  j AS (SELECT u, t, q_id, q_ts, t_id, t_ts FROM g ASOF LEFT JOIN q ON g.u >= q.q_ts ASOF LEFT JOIN tr ON g.u >= tr.t_ts)
  SELECT CAST(floor(epoch(u)) AS BIGINT) AS at_s, strftime(CAST(t + INTERVAL 6 HOUR AS DATE), '%Y-%m-%d') AS session, q_id, t_id, round(m.mid, 6) AS mid, round(p.price, 6) AS price, CAST(floor(epoch(u)) - floor(epoch(t_ts)) AS BIGINT) AS trade_age_s
  FROM j LEFT JOIN quotes m ON m.quote_id = j.q_id LEFT JOIN trades p ON p.trade_id = j.t_id""", "quotes trades")
def session_panel(v: Views) -> DataFrame:
    """Two sources on the session's grid of five minutes: the last quote and the last trade of the whole market at each. The
    as-of joins have no key, so time is cut into ranges of SESSION_ROWS rows, and the last row of earlier ranges is carried in."""
    at = lambda c: F.unix_micros(c)
    grid = open_minutes(v).filter(F.minute("t") % 5 == 0).select(at("u").alias("at"), "session")
    quotes = v.quotes.groupBy(at("ts").alias("q_at")).agg(F.max_by(F.struct("quote_id", "mid"), "quote_id").alias("q"))
    trades = v.trades.groupBy(at("ts").alias("t_at")).agg(F.max_by(F.struct("trade_id", "price"), "trade_id").alias("p"))
    bucket = range_of(range_cuts(quotes, "q_at", SESSION_ROWS))
    rows = asof_join(asof_join(grid, quotes, [], "at", "q_at", how="left", bucket=bucket), trades, [], "at", "t_at", how="left", bucket=bucket)
    second = lambda c: F.floor(F.col(c) / 1_000_000)
    return rows.select(second("at").alias("at_s"), F.col("session").cast("string").alias("session"), F.col("q.quote_id").alias("q_id"), F.col("p.trade_id").alias("t_id"), R("q.mid").alias("mid"), R("p.price").alias("price"), (second("at") - second("t_at")).alias("trade_age_s"))


@query("next_event_after", "J-17", """SELECT t.trade_id, n.quote_id FROM trades t ASOF JOIN quotes n ON t.ticker = n.ticker AND t.ts < n.ts""", "trades quotes")
def next_event_after(v: Views) -> DataFrame:
    """Strictly after: the as-of join on negated times."""
    minus = lambda c: -F.unix_micros(c)
    left = v.trades.select("ticker", "trade_id", minus("ts").alias("lt"))
    return asof_join(left, v.quotes.select("ticker", "quote_id", minus("ts").alias("rt")), ["ticker"], "lt", "rt", strict=True, bucket=lambda t: F.floor(t / 86400e6)).select("trade_id", "quote_id")


@query("nth_upcoming", "J-16", """WITH m AS (SELECT DISTINCT day AS meeting FROM daily WHERE n % 7 = 0),
  r AS (SELECT day, meeting, row_number() OVER (PARTITION BY day ORDER BY meeting) AS k FROM daily JOIN m ON meeting >= day AND meeting < day + 150)
  SELECT strftime(day, '%Y-%m-%d') AS day, k, strftime(meeting, '%Y-%m-%d') AS meeting FROM r WHERE k IN (1, 3, 6)""", "daily")
def nth_upcoming(v: Views) -> DataFrame:
    """The 1st, 3rd and 6th meeting from each day on: a meeting's number minus that of the first one still to come."""
    meetings = v.daily.filter("n % 7 = 0").select(F.col("day").alias("meeting")).distinct()
    ahead = meetings.withColumn("day", F.explode(F.sequence(F.date_sub("meeting", 149), F.col("meeting"))))
    rows = v.daily.select("day").join(ahead, "day").withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("meeting")).cast("long"))
    return rows.filter(F.col("k").isin(1, 3, 6)).select(F.col("day").cast("string").alias("day"), "k", F.col("meeting").cast("string").alias("meeting"))


@query("last_on_or_before", "J-7 A-11", """SELECT ticker, lag, arg_max(quote_id, ts) AS quote_id FROM quotes, (SELECT unnest([1, 7, 28]) AS lag) WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(lag AS INTEGER)) GROUP BY ticker, lag""", "quotes")
def last_on_or_before(v: Views) -> DataFrame:
    cuts = v.spark.createDataFrame([(1,), (7,), (28,)], "lag int").withColumn("cut", F.timestamp_add("DAY", -F.col("lag"), F.lit("2024-01-31").cast("timestamp")))
    grid = v.quotes.select("ticker").distinct().crossJoin(F.broadcast(cuts))
    return asof_small(grid, v.quotes.select("ticker", "ts", "quote_id"), ["ticker"], "cut", "ts").select("ticker", "lag", "quote_id")


@query("contract_normalise", "F-4 F-1 F-13 F-5", """SELECT ticker, move_bps, CASE WHEN move_bps < 0 THEN 'cut' WHEN move_bps = 0 THEN 'hold' WHEN move_bps IN (25, 50) THEN 'hike' END AS kind,
  CASE user_id_code WHEN 0 THEN 'C50' WHEN 1 THEN 'C25' WHEN 2 THEN 'H0' WHEN 3 THEN 'H25' END AS code FROM (SELECT *, ticker % 5 AS user_id_code FROM contracts)""", "contracts")
def contract_normalise(v: Views) -> DataFrame:
    kind = F.when(F.col("move_bps") < 0, "cut").when(F.col("move_bps") == 0, "hold").when(F.col("move_bps").isin(25, 50), "hike")
    codes = F.create_map(*map(F.lit, (0, "C50", 1, "C25", 2, "H0", 3, "H25")))
    return v.contracts.select("ticker", "move_bps", kind.alias("kind"), F.try_element_at(codes, (F.col("ticker") % 5).cast("int")).alias("code"))


@query("traded_only", "F-7", "SELECT ticker, event, round(volume, 4) AS volume FROM contracts QUALIFY sum(volume) OVER (PARTITION BY event, move_bps) > 2000", "contracts")
def traded_only(v: Views) -> DataFrame:
    traded = v.contracts.groupBy("event", "move_bps").agg(F.sum("volume").alias("total")).filter("total > 2000")
    return v.contracts.join(traded, ["event", "move_bps"], "left_semi").select("ticker", "event", R("volume", 4).alias("volume"))


@query("meeting_summary", "A-6 A-7 A-8", """SELECT event, count(*) AS contracts, count(*) FILTER (WHERE result = 'yes') AS yes, max(move_bps) FILTER (WHERE result = 'yes') AS top_yes, bool_and(volume > 0) AS all_traded, bool_or(volume > 3000) AS any_large,
  epoch(any_value(close_ts))::BIGINT AS close_s, round(avg(CAST(volume > 2000 AS INTEGER)), 6) AS share FROM contracts GROUP BY event""", "contracts")
def meeting_summary(v: Views) -> DataFrame:
    yes = F.col("result") == "yes"
    return v.contracts.groupBy("event").agg(
        F.count("*").alias("contracts"), F.count_if(yes).alias("yes"), F.max(F.when(yes, F.col("move_bps"))).alias("top_yes"), F.bool_and(F.col("volume") > 0).alias("all_traded"), F.bool_or(F.col("volume") > 3000).alias("any_large"),
        F.unix_seconds(F.any_value("close_ts", True)).alias("close_s"), R(F.avg((F.col("volume") > 2000).cast("int"))).alias("share"),
    )


@query("coverage", "A-3 J-9 D-7", """WITH t AS (SELECT ticker, count(*) AS trades, sum(count) AS size FROM trades GROUP BY ticker), q AS (SELECT ticker, count(*) AS quotes, count(DISTINCT CAST(ts AS DATE)) AS days FROM quotes GROUP BY ticker)
  SELECT event, count(DISTINCT c.ticker) AS contracts, coalesce(sum(trades), 0)::BIGINT AS trades, sum(quotes)::BIGINT AS quotes, max(days) AS most_days, round(coalesce(sum(size), 0), 3) AS size FROM contracts c LEFT JOIN t USING (ticker) LEFT JOIN q USING (ticker) GROUP BY event""", "contracts trades quotes")
def coverage(v: Views) -> DataFrame:
    t = v.trades.groupBy("ticker").agg(F.count("*").alias("trades"), F.sum("count").alias("size"))
    q = v.quotes.groupBy("ticker").agg(F.count("*").alias("quotes"), F.count_distinct(F.to_date("ts")).alias("days"))
    rows = v.contracts.join(t, "ticker", "left").join(q, "ticker", "left").groupBy("event")
    return rows.agg(F.count_distinct("ticker").alias("contracts"), F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.sum("quotes").alias("quotes"), F.max("days").alias("most_days"), R(F.coalesce(F.sum("size"), F.lit(0.0)), 3).alias("size"))


@query("liquidity_by_month", "X-20 A-4", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, round(median(count), 6) AS median_size, round(sum(price * count), 2) AS notional FROM trades GROUP BY 1, 2", "trades")
def liquidity_by_month(v: Views) -> DataFrame:
    rows = v.trades.select(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month"), "price", "count")
    sums = rows.groupBy("week", "month").agg(R(F.sum(F.col("price") * F.col("count")), 2).alias("notional"))
    return exact_quantiles(rows, ["week", "month"], "count", [0.5]).join(sums, ["week", "month"]).select("week", "month", "n", R("q0").alias("median_size"), "notional")


@query("spread_by_move", "A-4 J-8", "SELECT move_bps, count(*) AS n, round(median(spread), 6) AS spread, round(median(mid), 6) AS mid FROM quotes JOIN contracts USING (ticker) WHERE bid IS NOT NULL GROUP BY move_bps", "quotes contracts")
def spread_by_move(v: Views) -> DataFrame:
    rows = v.quotes.filter("bid is not null").join(v.contracts.select("ticker", "move_bps"), "ticker").select("move_bps", "spread", "mid")
    spread, mid = (exact_quantiles(rows, ["move_bps"], c, [0.5]).select("move_bps", "n", R("q0").alias(c)) for c in ("spread", "mid"))
    return spread.join(mid.drop("n"), "move_bps")


@query("spread_by_price", "X-3", "SELECT round(least(floor(mid * 10) / 10, 0.9), 1) AS bin, count(*) AS n, round(median(spread), 6) AS spread FROM quotes GROUP BY 1", "quotes")
def spread_by_price(v: Views) -> DataFrame:
    rows = v.quotes.select(F.round(F.least(F.floor(F.col("mid") * 10) / 10, F.lit(0.9)), 1).alias("bin"), "spread")
    return exact_quantiles(rows, ["bin"], "spread", [0.5]).select("bin", "n", R("q0").alias("spread"))


@query("probability_path", "F-5 F-9 O-1", f"WITH {EOD} SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(mid, 6) AS mid FROM eod JOIN contracts USING (ticker) WHERE event = 7 ORDER BY ALL", "contracts quotes")
def probability_path(v: Views) -> DataFrame:
    return end_of_day(v, "event = 7").select("ticker", F.col("day").cast("string").alias("day"), R("mid").alias("mid")).orderBy(F.col("ticker").asc_nulls_last(), "day")


@query("sum_of_mids", "D-8", f"WITH {EOD} SELECT event, strftime(day, '%Y-%m-%d') AS day, count(*) AS quoted, round(sum(mid), 6) AS total FROM eod JOIN (SELECT *, count(*) OVER (PARTITION BY event) AS buckets FROM contracts) USING (ticker) GROUP BY event, day HAVING count(*) = max(buckets)", "contracts quotes")
def sum_of_mids(v: Views) -> DataFrame:
    listed = v.contracts.groupBy("event").agg(F.count("*").alias("buckets"))
    rows = end_of_day(v).join(v.contracts.select("ticker", "event"), "ticker").groupBy("event", "day").agg(F.count("*").alias("quoted"), F.sum("mid").alias("s"))
    return rows.join(listed, "event").filter("quoted = buckets").select("event", F.col("day").cast("string").alias("day"), "quoted", R("s").alias("total"))


@query("calibration_bins", "X-3 A-3", f"WITH {EOD} SELECT round(least(floor(mid * 10) / 10, 0.9), 1) AS bin, count(*) AS n, count(DISTINCT ticker) AS contracts, round(avg(mid), 6) AS forecast, round(avg(CAST(result = 'yes' AS INTEGER)), 6) AS observed FROM eod JOIN contracts USING (ticker) GROUP BY 1", "contracts quotes")
def calibration_bins(v: Views) -> DataFrame:
    rows = end_of_day(v).join(v.contracts.select("ticker", "result"), "ticker").groupBy(F.round(F.least(F.floor(F.col("mid") * 10) / 10, F.lit(0.9)), 1).alias("bin"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("contracts"), R(F.avg("mid")).alias("forecast"), R(F.avg((F.col("result") == "yes").cast("int"))).alias("observed"))


STATES = """s AS (SELECT q.ticker, q.ts, round(mid, 2) AS p, spread, least(coalesce(lead(q.ts) OVER (PARTITION BY q.ticker ORDER BY q.ts), close_ts), close_ts) AS stop, close_ts FROM quotes q JOIN contracts USING (ticker))"""


@query("minute_quotes", "T-1 W-1 X-23 X-6", f"WITH {STATES}, c AS (SELECT *, greatest(ts, close_ts - INTERVAL 7 DAY) AS a FROM s) SELECT ticker, p, round(sum(epoch(stop - a)), 3) AS seconds FROM c WHERE stop > a GROUP BY ticker, p", "quotes contracts")
def minute_quotes(v: Views) -> DataFrame:
    return quote_seconds(v).groupBy("ticker", "p").agg(R(F.sum("seconds"), 3).alias("seconds"))


def quote_seconds(v: Views) -> DataFrame:
    states = v.quotes.join(v.contracts.select("ticker", "close_ts", "result", "event"), "ticker").withColumn("p", F.round("mid", 2))
    return durations(states, "ticker", "ts", F.col("close_ts"), F.timestamp_add("DAY", F.lit(-7), F.col("close_ts")))


@query("minute_quotes_by_bucket", "T-2 J-11 U-8 J-10", f"""WITH {STATES}, b AS (SELECT unnest(['near', 'mid', 'far']) AS bucket, unnest([0, 3, 10]) AS lo, unnest([3, 10, 25]) AS hi),
  c AS (SELECT ticker, bucket, greatest(ts, close_ts - to_days(hi::INTEGER)) AS a, least(stop, close_ts - to_days(lo::INTEGER)) AS z, p FROM s, b) SELECT bucket, p, count(*) AS n, round(sum(epoch(z - a)), 3) AS seconds FROM c WHERE z > a GROUP BY bucket, p""", "quotes contracts")
def minute_quotes_by_bucket(v: Views) -> DataFrame:
    buckets = F.inline(F.arrays_zip(F.array(*map(F.lit, ("near", "mid", "far"))).alias("bucket"), F.array(*map(F.lit, (0, 3, 10))).alias("lo"), F.array(*map(F.lit, (3, 10, 25))).alias("hi")))
    states = v.quotes.join(v.contracts.select("ticker", "close_ts"), "ticker")
    stop = F.least(F.coalesce(F.lead("ts").over(Window.partitionBy("ticker").orderBy("ts")), F.col("close_ts")), F.col("close_ts"))
    rows = states.select("ticker", "ts", F.round("mid", 2).alias("p"), "close_ts", stop.alias("stop")).select("*", buckets)
    a = F.greatest(F.col("ts"), F.timestamp_add("DAY", -F.col("hi"), F.col("close_ts")))
    z = F.least(F.col("stop"), F.timestamp_add("DAY", -F.col("lo"), F.col("close_ts")))
    return rows.withColumn("a", a).withColumn("z", z).filter("z > a").groupBy("bucket", "p").agg(F.count("*").alias("n"), R(F.sum((F.unix_micros("z") - F.unix_micros("a")) / 1e6), 3).alias("seconds"))


DAYS_OUT = "date_diff('day', CAST(ts - INTERVAL 5 HOUR AS DATE), DATE '2024-01-30')"


@query("trades_by_day", "X-21 A-1 A-2", f"SELECT event, {DAYS_OUT} AS days_out, count(*) AS n, round(sum(count), 3) AS size FROM trades JOIN contracts USING (ticker) WHERE {DAYS_OUT} BETWEEN 0 AND 20 GROUP BY ALL", "trades contracts")
def trades_by_day(v: Views) -> DataFrame:
    return days_out(v).groupBy("event", "days_out").agg(F.count("*").alias("n"), R(F.sum("count"), 3).alias("size"))


def days_out(v: Views) -> DataFrame:
    out = F.datediff(F.lit("2024-01-30").cast("date"), local_date(F.col("ts"))).cast("long")
    return v.trades.join(v.contracts.select("ticker", "event"), "ticker").withColumn("days_out", out).filter("days_out between 0 and 20")


@query("equal_trade_buckets", "T-7 W-12 J-13", f"""WITH d AS (SELECT {DAYS_OUT} AS k, count(*) AS n FROM trades WHERE {DAYS_OUT} BETWEEN 0 AND 20 GROUP BY 1), g AS (SELECT i AS k, coalesce(n, 0) AS n FROM range(0, 21) t(i) LEFT JOIN d ON d.k = i),
  s AS (SELECT k, sum(n) OVER (ORDER BY k) / sum(n) OVER () AS share FROM g) SELECT q AS part, arg_min(k, abs(share - q / 4.0) * 1000000 + k / 1000.0) AS cut_day FROM s, (SELECT unnest([1, 2, 3]) AS q) GROUP BY q""", "trades")
def equal_trade_buckets(v: Views) -> DataFrame:
    grid = v.spark.range(21).withColumnRenamed("id", "days_out").join(days_out(v).groupBy("days_out").agg(F.count("*").alias("n")), "days_out", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.sum("n").over(Window.orderBy("days_out")) / F.sum("n").over(Window.partitionBy())
    rows = grid.withColumn("share", share).withColumn("part", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.groupBy("part").agg(F.min_by("days_out", F.abs(F.col("share") - F.col("part") / 4.0) * 1000000 + F.col("days_out") / 1000.0).alias("cut_day"))


@query("contracts_catalog", "J-9 O-1", """SELECT c.ticker, c.result, n.last_id, strftime(CAST(close_ts AS DATE) - 1, '%Y-%m-%d') AS day_before FROM contracts c LEFT JOIN (SELECT ticker, max(trade_id) AS last_id FROM trades GROUP BY ticker) n USING (ticker) ORDER BY c.ticker DESC""", "contracts trades")
def contracts_catalog(v: Views) -> DataFrame:
    last = v.trades.groupBy("ticker").agg(F.max("trade_id").alias("last_id"))
    return v.contracts.join(last, "ticker", "left").select("ticker", "result", "last_id", F.date_sub(F.to_date("close_ts"), 1).cast("string").alias("day_before")).orderBy(F.col("ticker").desc())


@query("minute_mids", "F-6 F-9", "SELECT ticker, epoch(date_trunc('minute', ts))::BIGINT AS minute, round(avg(mid), 6) AS mid FROM quotes WHERE ticker IN (SELECT unnest([3, 5, 8, 13])) GROUP BY 1, 2", "quotes")
def minute_mids(v: Views) -> DataFrame:
    rows = v.spark.sql("select ticker, ts, mid from {q} where array_contains(cast(:tickers as array<bigint>), ticker)", args={"tickers": F.array(*map(F.lit, (3, 5, 8, 13)))}, q=v.quotes)
    return rows.groupBy("ticker", F.unix_seconds(F.date_trunc("minute", "ts")).alias("minute")).agg(R(F.avg("mid")).alias("mid"))


@query("volume_completeness", "S-16 J-13 A-15", """WITH t AS (SELECT ticker, sum(count) AS s FROM trades WHERE trade_id % 97 <> 5 GROUP BY ticker) SELECT event, count(*) AS n, round(avg(CAST(abs(coalesce(s, 0) - volume) <= 0.01 * greatest(volume, 1) AS INTEGER)), 6) AS complete FROM contracts LEFT JOIN t USING (ticker) GROUP BY event""", "contracts trades")
def volume_completeness(v: Views) -> DataFrame:
    held = v.trades.filter("trade_id % 97 <> 5").groupBy("ticker").agg(F.sum("count").alias("s"))
    rows = v.contracts.join(held, "ticker", "left").withColumn("ok", F.abs(F.coalesce("s", F.lit(0.0)) - F.col("volume")) <= 0.01 * F.greatest(F.col("volume"), F.lit(1.0)))
    return rows.groupBy("event").agg(F.count("*").alias("n"), R(F.avg(F.col("ok").cast("int"))).alias("complete"))


@query("incremental_merge", "S-15 A-9 J-15 U-1", """WITH old AS (SELECT * FROM trades WHERE ts < TIMESTAMP '2024-01-16 00:00:00'), mark AS (SELECT ticker, max(ts) - INTERVAL 1 HOUR AS since FROM old GROUP BY ticker),
  new AS (SELECT t.* FROM trades t LEFT JOIN mark USING (ticker) WHERE since IS NULL OR t.ts >= since), u AS (SELECT *, 0 AS late FROM old UNION ALL BY NAME SELECT *, 1 AS late FROM new)
  SELECT trade_id, ticker, late FROM u QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY late DESC) = 1""", "trades")
def incremental_merge(v: Views) -> DataFrame:
    from tidemark.sources.incremental import merge, since_marks

    old = v.trades.filter("ts < timestamp '2024-01-16 00:00:00'")
    new = since_marks(old, v.trades, "ticker", "ts", hours=1)
    return merge(old.withColumn("late", F.lit(0)), new.withColumn("late", F.lit(1)), ["trade_id"], [F.col("late")]).select("trade_id", "ticker", "late")


@query("day_grid_ffill", "U-9 U-2 W-11", """WITH d AS (SELECT ticker, CAST(ts AS DATE) AS day, arg_max(mid, ts) AS mid, sum(size) AS size FROM quotes GROUP BY 1, 2), g AS (SELECT ticker, CAST(unnest(generate_series(min(day), DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY ticker)
  SELECT g.ticker, strftime(g.day, '%Y-%m-%d') AS day, round(last_value(mid IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.day), 6) AS mid, round(coalesce(size, 0), 4) AS size FROM g LEFT JOIN d ON d.ticker = g.ticker AND d.day = g.day""", "quotes")
def day_grid_ffill(v: Views) -> DataFrame:
    from tidemark.operators.series import forward_fill

    days = v.quotes.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.max_by("mid", "ts").alias("mid"), F.sum("size").alias("size"))
    grid = days.groupBy("ticker").agg(F.min("day").alias("a")).select("ticker", F.explode(day_sequence(F.col("a"), F.lit("2024-01-31").cast("date"))).alias("day"))
    rows = grid.join(days, ["ticker", "day"], "left")
    return rows.select("ticker", F.col("day").cast("string").alias("day"), R(forward_fill("mid", Window.partitionBy("ticker").orderBy("day"))).alias("mid"), R(F.coalesce("size", F.lit(0.0)), 4).alias("size"))


@query("stale_rows_dropped", "F-15 W-6 W-7", """WITH s AS (SELECT *, abs(floor(x / 20000) - lag(floor(x / 20000)) OVER (ORDER BY day)) AS a, abs(n - lag(n) OVER (ORDER BY day)) AS b FROM daily) SELECT strftime(day, '%Y-%m-%d') AS day, n FROM s WHERE coalesce(a, 0) + coalesce(b, 0) <> 0""", "daily")
def stale_rows_dropped(v: Views) -> DataFrame:
    from tidemark.operators.series import drop_repeats

    return drop_repeats(v.daily.withColumn("k", F.floor(F.col("x") / 20000)), ["k", "n"], "day").select(F.col("day").cast("string").alias("day"), "n")


@query("keep_last_quote", "A-9 A-11", "SELECT ticker, quote_id FROM quotes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, quote_id DESC) = 1", "quotes")
def keep_last_quote(v: Views) -> DataFrame:
    return latest(v.quotes, ["ticker"], ["ts", "quote_id"]).select("ticker", "quote_id")
