"""Joins, aggregates, windows, ordering, reshaping and scalar families, a query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tidemark.functions import domain as D
from tidemark.operators import series as S
from tidemark.operators.checks import enforced, failures
from tidemark.operators.ranges import exact_quantiles

from .adapters import Views
from .panels import EOD, FORECAST_USES, FORECASTS, R, end_of_day, forecasts, open_minutes
from .registry import query

DAY = lambda c="day": F.col(c).cast("string").alias("day")


def monthly(v: Views) -> DataFrame:
    """The daily series with its month."""
    return v.daily.withColumn("month", F.date_format("day", "yyyy-MM"))


MONTHLY = "m AS (SELECT *, strftime(day, '%Y-%m') AS month FROM daily)"


def by_day() -> WindowSpec:
    """Over the whole series, through the ends of months. It has a row a calendar day, however many rows the tables have, so
    one task holds some thousand of them at any scale."""
    return Window.orderBy("day")


@query("semi_join", "J-14", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(v: Views) -> DataFrame:
    return v.table("customer").join(v.table("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("anti_join", "J-15 U-3", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')")
def anti_join(v: Views) -> DataFrame:
    return v.table("customer").join(v.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("full_outer_series", "S-18 J-12", "WITH a AS (SELECT day, x FROM daily WHERE n % 2 = 0), b AS (SELECT day, n FROM daily WHERE n % 3 = 0) SELECT strftime(coalesce(a.day, b.day), '%Y-%m-%d') AS day, x, n FROM a FULL JOIN b ON a.day = b.day", "daily")
def full_outer_series(v: Views) -> DataFrame:
    return v.daily.filter("n % 2 = 0").select("day", "x").join(v.daily.filter("n % 3 = 0").select("day", "n"), "day", "full_outer").select(DAY(), "x", "n")


@query("matched_samples", "J-18 U-3", "SELECT ticker, strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT ticker, CAST(ts AS DATE) AS d FROM quotes WHERE spread < 0.2 INTERSECT SELECT DISTINCT ticker, CAST(ts AS DATE) FROM trades INTERSECT SELECT DISTINCT ticker, CAST(ts AS DATE) FROM quotes WHERE mid > 0.4)", "quotes trades")
def matched_samples(v: Views) -> DataFrame:
    keys = lambda df: df.select("ticker", F.to_date("ts").alias("d")).distinct()
    out = keys(v.quotes.filter("spread < 0.2")).join(keys(v.trades), ["ticker", "d"]).join(keys(v.quotes.filter("mid > 0.4")), ["ticker", "d"])
    return out.select("ticker", F.col("d").cast("string").alias("day"))


@query("basic_joins", "J-8 J-12", "SELECT n_name, r_name, count(*) AS customers, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def basic_joins(v: Views) -> DataFrame:
    n = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    per = v.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    rows = v.table("customer").join(per, "c_custkey", "left").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name")
    return rows.agg(F.sum(F.coalesce("k", F.lit(1))).alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))


@query("first_value_lookup", "J-19", "SELECT trade_id, round(price - first_value(price) OVER (PARTITION BY ticker ORDER BY ts), 6) AS change FROM trades", "trades")
def first_value_lookup(v: Views) -> DataFrame:
    first = v.trades.groupBy("ticker").agg(F.min_by("price", "ts").alias("first"))
    return v.trades.join(first, "ticker").select("trade_id", R(F.col("price") - F.col("first")).alias("change"))


@query("basic_filters", "F-2 F-3 F-10 F-11 F-12 F-16 S-2", """SELECT * EXCLUDE (ts, bid, size), CASE WHEN mid > 0.5 THEN 'high' ELSE 'low' END AS side FROM (SELECT q.* FROM quotes q) WHERE mid BETWEEN 0.2 AND 0.8 AND ask > 0.3 AND ask < 0.9 AND bid IS NOT NULL AND NOT (ticker % 2 = 0) AND ts < TIMESTAMP '2024-01-21 00:00:00'""", "quotes")
def basic_filters(v: Views) -> DataFrame:
    mask = F.col("mid").between(0.2, 0.8) & (F.col("ask") > 0.3) & (F.col("ask") < 0.9)
    mask &= ~(F.col("ticker") % 2 == 0)
    q = v.quotes.alias("q").select("q.*").filter(mask).na.drop(subset=["bid"]).filter("ts < timestamp '2024-01-21'")
    return q.drop("ts", "bid", "size").withColumn("side", F.when(F.col("mid") > 0.5, "high").otherwise("low"))


@query("basic_aggs", "A-1 A-2", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL")
def basic_aggs(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), R(F.sum("l_quantity"), 2).alias("quantity"), R(F.avg("l_extendedprice"), 4).alias("price"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@query("quantiles_linear", "A-5 A-4", "SELECT l_shipmode, round(q[1], 6) AS lo, round(q[2], 6) AS mid, round(q[3], 6) AS hi FROM (SELECT l_linenumber AS l_shipmode, quantile_cont(l_extendedprice, [0.025, 0.5, 0.975]) AS q FROM lineitem GROUP BY 1)")
def quantiles_linear(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_linenumber").alias("l_shipmode"), "l_extendedprice")
    return exact_quantiles(rows, ["l_shipmode"], "l_extendedprice", [0.025, 0.5, 0.975]).select("l_shipmode", *(R(f"q{i}").alias(n) for i, n in enumerate(("lo", "mid", "hi"))))


@query("distinct_rows", "A-10", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("argmax_row", "A-12", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def argmax_row(v: Views) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return v.table("orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("weighted_mean", "A-14 X-2", "SELECT ticker, round(sum(price * count) / sum(count) + 1e-9, 6) AS vwap, round(sum(price * (trade_id % 2)) / nullif(sum(trade_id % 2), 0) + 1e-9, 6) AS odd FROM trades GROUP BY ticker", "trades")
def weighted_mean(v: Views) -> DataFrame:
    odd = F.col("trade_id") % 2
    return v.trades.groupBy("ticker").agg(R(F.try_divide(F.sum(F.col("price") * F.col("count")), F.sum("count")) + 1e-9).alias("vwap"), R(F.try_divide(F.sum(F.col("price") * odd), F.sum(odd)) + 1e-9).alias("odd"))


@query("mode_value", "A-18", "SELECT ticker, arg_max(c, struct_pack(n := n, c := -c)) AS mode, max(n) AS times FROM (SELECT ticker, CAST(floor(mid * 10) AS BIGINT) AS c, count(*) AS n FROM quotes GROUP BY 1, 2) GROUP BY ticker", "quotes")
def mode_value(v: Views) -> DataFrame:
    counts = v.quotes.groupBy("ticker", F.floor(F.col("mid") * 10).alias("c")).agg(F.count("*").alias("n"))
    return counts.groupBy("ticker").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("mode"), F.max("n").alias("times"))


@query("dispersion", "A-13", "SELECT month, round(stddev_samp(x), 4) AS sd, round(var_samp(n), 6) AS var, round(covar_samp(x, n) + 1e-6, 4) AS cov, round(corr(x, n), 6) AS cor FROM (SELECT x, n, strftime(day, '%Y-%m') AS month FROM daily) GROUP BY month", "daily")
def dispersion(v: Views) -> DataFrame:
    return monthly(v).groupBy("month").agg(R(F.stddev_samp("x"), 4).alias("sd"), R(F.var_samp("n")).alias("var"), R(F.covar_samp("x", "n") + 1e-6, 4).alias("cov"), R(F.corr("x", "n")).alias("cor"))


@query("share_aggregates", "A-15 A-8", "SELECT ticker, round(avg(CAST(coalesce(bid = 0, false) AS INTEGER)), 6) AS zero_bid, round(avg(CAST(coalesce(spread > 0.2, false) AS INTEGER)), 6) AS wide FROM quotes GROUP BY ticker", "quotes")
def share_aggregates(v: Views) -> DataFrame:
    share = lambda c: R(F.avg(F.coalesce(c, F.lit(False)).cast("int")))
    return v.quotes.groupBy("ticker").agg(share(F.col("bid") == 0).alias("zero_bid"), share(F.col("spread") > 0.2).alias("wide"))


@query("cluster_sums", "A-20 A-21", "SELECT ticker, round(coalesce(sum(bid), 0), 6) AS bids, CASE WHEN count(bid) = count(*) THEN round(sum(bid), 6) END AS complete FROM quotes GROUP BY ticker", "quotes")
def cluster_sums(v: Views) -> DataFrame:
    return v.quotes.groupBy("ticker").agg(R(F.coalesce(F.sum("bid"), F.lit(0.0))).alias("bids"), F.when(F.count("bid") == F.count("*"), R(F.sum("bid"))).alias("complete"))


MEDIAN_ROWS = """r AS (SELECT *, list(CASE WHEN n % 4 <> 0 THEN x END) OVER (ORDER BY day ROWS 9 PRECEDING) AS l FROM m)"""


@query("rolling_median", "W-9", f"WITH {MONTHLY}, {MEDIAN_ROWS} SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN len(list_filter(l, lambda v: v IS NOT NULL)) >= 3 THEN round(list_median(list_filter(l, lambda v: v IS NOT NULL)), 4) END AS med FROM r", "daily")
def rolling_median(v: Views) -> DataFrame:
    rows = monthly(v).withColumn("y", F.when(F.col("n") % 4 != 0, F.col("x")))
    return rows.select(DAY(), R(S.rolling_median("y", by_day(), 10, 3), 4).alias("med"))


@query("centered_mean", "W-10", f"WITH {MONTHLY} SELECT strftime(day, '%Y-%m-%d') AS day, round(avg(x) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 1e-7, 4) AS mean FROM m", "daily")
def centered_mean(v: Views) -> DataFrame:
    return monthly(v).select(DAY(), R(F.avg("x").over(by_day().rowsBetween(-3, 3)) + 1e-7, 4).alias("mean"))


@query("ffill_bfill", "W-11", f"""WITH {MONTHLY}, z AS (SELECT *, CASE WHEN n % 5 = 0 THEN x END AS y FROM m) SELECT strftime(day, '%Y-%m-%d') AS day, last_value(y IGNORE NULLS) OVER (ORDER BY day) AS f,
  first_value(y IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM z""", "daily")
def ffill_bfill(v: Views) -> DataFrame:
    rows = monthly(v).withColumn("y", F.when(F.col("n") % 5 == 0, F.col("x")))
    return rows.select(DAY(), S.forward_fill("y", by_day()).alias("f"), S.backward_fill("y", by_day()).alias("b"))


@query("group_lag_lead", "W-6 W-1", "SELECT quote_id, lag(quote_id, 2) OVER w AS before, lead(quote_id, 3) OVER w AS after, round(lead(mid) OVER w - mid, 6) AS next_change FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY ts)", "quotes")
def group_lag_lead(v: Views) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ts")
    return v.quotes.select("quote_id", F.lag("quote_id", 2).over(w).alias("before"), F.lead("quote_id", 3).over(w).alias("after"), R(F.lead("mid").over(w) - F.col("mid")).alias("next_change"))


@query("gap_guard_diff", "W-8 W-7", f"WITH {MONTHLY} SELECT strftime(day, '%Y-%m-%d') AS day, round(x - lag(x) OVER w + 1e-7, 4) AS dx FROM m QUALIFY day - lag(day) OVER w = 1 WINDOW w AS (ORDER BY day)".replace("QUALIFY day - lag(day) OVER w = 1 WINDOW w AS (ORDER BY day)", "WINDOW w AS (ORDER BY day) QUALIFY day - lag(day) OVER w = 1"), "daily")
def gap_guard_diff(v: Views) -> DataFrame:
    rows = monthly(v).withColumn("step", F.datediff("day", F.lag("day").over(by_day()))).withColumn("dx", R(F.col("x") - F.lag("x").over(by_day()) + 1e-7, 4))
    return rows.filter("step = 1").select(DAY(), "dx")


@query("cumulative_minmax", "W-13 W-12", f"WITH {MONTHLY} SELECT strftime(day, '%Y-%m-%d') AS day, min(x) OVER w AS low, max(x) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS high, CAST(sum(n) OVER w AS BIGINT) AS total FROM m WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)", "daily")
def cumulative_minmax(v: Views) -> DataFrame:
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    back = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return monthly(v).select(DAY(), F.min("x").over(w).alias("low"), F.max("x").over(back).alias("high"), F.sum("n").over(w).alias("total"))


@query("rank_terciles", "W-14 X-14", f"WITH {MONTHLY}, k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n, day) AS r, count(*) OVER (PARTITION BY month) AS c FROM m) SELECT strftime(day, '%Y-%m-%d') AS day, r, CASE WHEN r <= c // 3 + CAST(c % 3 = 2 AS INTEGER) THEN 0 WHEN r <= c // 3 * 2 + CAST(c % 3 = 2 AS INTEGER) THEN 1 ELSE 2 END AS tercile FROM k", "daily")
def rank_terciles(v: Views) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("month").orderBy("n", "day")).cast("long")
    rows = monthly(v).withColumn("r", r).withColumn("c", F.count("*").over(Window.partitionBy("month")))
    low = F.expr("c div 3 + if(c % 3 = 2, 1, 0)")
    return rows.select(DAY(), "r", F.when(F.col("r") <= low, 0).when(F.col("r") <= low + F.expr("c div 3"), 1).otherwise(2).alias("tercile"))


@query("top_quantile", "O-5", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.97) FROM orders)")
def top_quantile(v: Views) -> DataFrame:
    o = v.table("orders")
    bound = exact_quantiles(o, [], "o_totalprice", [0.97]).select(F.col("q0").alias("bound"))  # a row
    return o.join(F.broadcast(bound), F.col("o_totalprice") >= F.col("bound")).select("o_orderkey")


@query("nsmallest", "O-3 O-1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def nsmallest(v: Views) -> DataFrame:
    return v.table("orders").orderBy("o_totalprice", "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("last_k_groups", "O-6", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders ORDER BY m DESC LIMIT 3)")
def last_k_groups(v: Views) -> DataFrame:
    o = v.table("orders").withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    return o.join(F.broadcast(o.select("m").distinct().orderBy(F.col("m").desc()).limit(3)), "m", "left_semi").select("o_orderkey")


@query("top_abs", "O-2", f"WITH {MONTHLY} SELECT strftime(day, '%Y-%m-%d') AS day, dx FROM (SELECT day, round(x - lag(x) OVER (ORDER BY day) + 1e-7, 4) AS dx FROM m) WHERE dx IS NOT NULL ORDER BY abs(dx) DESC, day LIMIT 10", "daily")
def top_abs(v: Views) -> DataFrame:
    rows = monthly(v).withColumn("dx", R(F.col("x") - F.lag("x").over(by_day()) + 1e-7, 4)).filter("dx is not null")
    return rows.orderBy(F.abs("dx").desc(), "day").limit(10).select(DAY(), "dx")


@query("head_tail", "O-4", "(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50) UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1)")
def head_tail(v: Views) -> DataFrame:
    o = v.table("orders")
    return o.orderBy("o_orderkey").limit(50).select(F.lit("head").alias("part"), "o_orderkey").unionByName(o.agg(F.max("o_orderkey").alias("o_orderkey")).select(F.lit("tail").alias("part"), "o_orderkey"))


@query("pivot_scores", "U-4 A-16 A-17 D-6", f"""WITH {FORECASTS}, s AS (SELECT event % 3 AS kind, event, h, avg((p - y) * (p - y)) AS b FROM forecasts WHERE h IN (1, 7, 21) GROUP BY ALL), u AS (SELECT CAST(kind AS VARCHAR) AS kind, h, b FROM s UNION ALL SELECT 'All', h, b FROM s)
  SELECT kind, round(avg(b) FILTER (WHERE h = 1), 6) AS h1, round(avg(b) FILTER (WHERE h = 7), 6) AS h7, round(median(b) FILTER (WHERE h = 21), 6) AS h21, count(b) AS n FROM u GROUP BY kind""", FORECAST_USES)
def pivot_scores(v: Views) -> DataFrame:
    per = forecasts(v).filter(F.col("h").isin(1, 7, 21)).groupBy((F.col("event") % 3).alias("kind"), "event", "h").agg(F.avg(D.brier(F.col("p"), F.col("y"))).alias("b"))
    rows = per.select(F.explode(F.array(F.col("kind").cast("string"), F.lit("All"))).alias("kind"), "h", "b")
    wide = rows.groupBy("kind").pivot("h", [1, 7, 21]).agg(R(F.avg("b")).alias("mean"), R(F.median("b")).alias("median"), F.count("b").alias("n"))
    return wide.select("kind", F.col("1_mean").alias("h1"), F.col("7_mean").alias("h7"), F.col("21_median").alias("h21"), (F.col("1_n") + F.col("7_n") + F.col("21_n")).alias("n"))


@query("unpivot_scores", "U-5 U-6 S-9", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, round(sum(l_discount), 6) AS discount, round(sum(l_tax), 6) AS tax FROM lineitem GROUP BY 1, 2) UNPIVOT (value FOR name IN (discount, tax))")
def unpivot_scores(v: Views) -> DataFrame:
    wide = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(R(F.sum("l_discount")).alias("discount"), R(F.sum("l_tax")).alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "name", "value")


@query("totals_grouping_sets", "A-17 A-1", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))")
def totals_grouping_sets(v: Views) -> DataFrame:
    rows = v.table("orders").groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"]], "o_orderstatus", "o_orderpriority")
    return rows.agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("resample_15min", "U-11", "SELECT epoch(time_bucket(INTERVAL 15 MINUTE, ts))::BIGINT AS start, count(*) AS n, arg_max(quote_id, struct_pack(t := ts, q := quote_id)) AS last FROM quotes GROUP BY 1", "quotes")
def resample_15min(v: Views) -> DataFrame:
    return v.quotes.groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.max_by("quote_id", F.struct("ts", "quote_id")).alias("last")).select(F.unix_seconds("w.start").alias("start"), "n", "last")


SESSIONS = """sp AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL 1 MINUTE AS b FROM events), l AS (SELECT u, u - INTERVAL 5 HOUR AS t FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS u FROM sp)),
  o AS (SELECT * FROM l WHERE hour(t) <> 17 AND NOT (isodow(t) = 6) AND NOT (isodow(t) = 5 AND hour(t) >= 17) AND NOT (isodow(t) = 7 AND hour(t) < 18))"""


@query("session_minutes", "U-12 U-13 U-14", f"""WITH {SESSIONS}
  SELECT strftime(CAST(t + INTERVAL 6 HOUR AS DATE), '%Y-%m-%d') AS session, count(*) AS minutes, count(*) FILTER (WHERE minute(t) % 5 = 0 AND hour(t) BETWEEN 9 AND 15) AS us FROM o GROUP BY 1""")
def session_minutes(v: Views) -> DataFrame:
    us = (F.minute("t") % 5 == 0) & F.hour("t").between(9, 15)
    return open_minutes(v).groupBy(F.col("session").cast("string").alias("session")).agg(F.count("*").alias("minutes"), F.count_if(us).alias("us"))


EDGES = [*D.edges(0.05)]


@query("prob_bins", "X-4 X-28", f"WITH e AS (SELECT round(mid, 9) AS p, {EDGES[:-1]} AS e, {EDGES[1:]} AS u FROM quotes), k AS (SELECT len(list_filter(e, lambda x: x <= p)) AS i, e, u FROM e) SELECT round(e[i], 2) AS low, printf('[%.2f, %.2f)', e[i], u[i]) AS label, count(*) AS n FROM k GROUP BY ALL", "quotes")
def prob_bins(v: Views) -> DataFrame:
    low = v.quotes.select(D.bin_floor(F.col("mid"), 0.05).alias("low"))
    return low.groupBy("low").agg(F.count("*").alias("n")).select(F.round("low", 2).alias("low"), D.bin_label(F.col("low"), 0.05).alias("label"), "n")


@query("cut_bins", "X-5", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN n <= 0 THEN NULL WHEN n <= 4 THEN 'few' WHEN n <= 7 THEN 'some' WHEN n <= 10 THEN 'many' END AS band FROM daily) GROUP BY band", "daily")
def cut_bins(v: Views) -> DataFrame:
    return v.daily.groupBy(D.cut(F.col("n"), [0, 4, 7, 10], ["few", "some", "many"]).alias("band")).agg(F.count("*").alias("n"))


@query("histogram_clipped", "A-22 A-23 X-6", "WITH c AS (SELECT least(greatest(x / 1000, 100), 199.999) AS z FROM daily) SELECT CAST(floor(z / 10) AS BIGINT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY 1", "daily")
def histogram_clipped(v: Views) -> DataFrame:
    z = D.clip(F.col("x") / 1000, 100.0, 199.999)
    rows = v.daily.groupBy(F.floor(z / 10).alias("bin")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", R(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("scores_brier_logloss", "X-10 X-9", f"WITH {FORECASTS}, c AS (SELECT ticker, h, y, least(greatest(p, 0.005), 0.995) AS p FROM forecasts) SELECT ticker, h, round((p - y) * (p - y), 6) AS brier, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss, round(ln(p / (1 - p)), 6) AS logit FROM c", FORECAST_USES)
def scores_brier_logloss(v: Views) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    rows = forecasts(v).withColumn("p", D.clip(p, 0.005, 0.995))
    return rows.select("ticker", "h", R(D.brier(p, y)).alias("brier"), R(D.log_loss(p, y)).alias("loss"), R(D.logit(p)).alias("logit"))


@query("meeting_scores", "D-5 X-6", f"WITH {FORECASTS} SELECT event, h, round(sum((q - y) * (q - y)), 6) AS brier, round(-ln(sum(q * y)), 6) AS log_score FROM forecasts WHERE q IS NOT NULL GROUP BY event, h HAVING sum(y) > 0", FORECAST_USES)
def meeting_scores(v: Views) -> DataFrame:
    rows = forecasts(v).filter("q is not null").groupBy("event", "h").agg(F.sum(D.brier(F.col("q"), F.col("y"))).alias("b"), F.sum(F.col("q") * F.col("y")).alias("w"), F.sum("y").alias("k"))
    return rows.filter("k > 0").select("event", "h", R("b").alias("brier"), R(-F.ln("w")).alias("log_score"))


BINNED = f"b AS (SELECT *, ({EDGES[:-1]})[len(list_filter({EDGES[:-1]}, lambda x: x <= round(p, 9)))] AS low FROM forecasts)"


@query("reliability", "D-1 X-4 A-3", f"WITH {FORECASTS}, {BINNED} SELECT h, round(low, 2) AS low, count(*) AS n, count(DISTINCT ticker) AS contracts, count(DISTINCT event) AS events, round(avg(p) + 1e-9, 6) AS forecast, round(avg(y), 6) AS observed FROM b GROUP BY h, low", FORECAST_USES)
def reliability(v: Views) -> DataFrame:
    rows = forecasts(v).groupBy("h", D.bin_floor(F.col("p"), 0.05).alias("low"))
    rows = rows.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("contracts"), F.count_distinct("event").alias("events"), R(F.avg("p") + 1e-9).alias("forecast"), R(F.avg("y")).alias("observed"))
    return rows.withColumn("low", F.round("low", 2))


TIMED = """s AS (SELECT q.ticker, round(mid, 2) AS p, result, least(coalesce(lead(q.ts) OVER (PARTITION BY q.ticker ORDER BY q.ts), close_ts), close_ts) AS stop, greatest(q.ts, close_ts - INTERVAL 7 DAY) AS a FROM quotes q JOIN contracts USING (ticker)),
  t AS (SELECT *, epoch(stop - a) AS seconds, CAST(floor(p * 10) / 10 AS DOUBLE) AS bin FROM s WHERE stop > a)"""


@query("reliability_timeweighted", "D-2 T-1", f"WITH {TIMED} SELECT round(bin, 1) AS bin, count(DISTINCT ticker) AS contracts, round(sum(seconds) / 60, 3) AS minutes, round(sum(p * seconds) / sum(seconds), 6) AS forecast, round(sum(CAST(result = 'yes' AS INTEGER) * seconds) / sum(seconds), 6) AS observed FROM t GROUP BY bin", "quotes contracts")
def reliability_timeweighted(v: Views) -> DataFrame:
    from .panels import quote_seconds

    rows = quote_seconds(v).groupBy((F.floor(F.col("p") * 10) / 10).alias("bin"))
    weighted = lambda c: R(F.sum(c * F.col("seconds")) / F.sum("seconds"))
    out = rows.agg(F.count_distinct("ticker").alias("contracts"), R(F.sum("seconds") / 60, 3).alias("minutes"), weighted(F.col("p")).alias("forecast"), weighted((F.col("result") == "yes").cast("int")).alias("observed"))
    return out.withColumn("bin", F.round("bin", 1))


@query("calibration_error", "D-3 A-14", f"WITH {FORECASTS}, {BINNED}, r AS (SELECT h, low, count(*) AS n, avg(p) AS f, avg(y) AS o FROM b GROUP BY h, low) SELECT h, round(sum(n * abs(o - f)) / sum(n), 6) AS error, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY h", FORECAST_USES)
def calibration_error(v: Views) -> DataFrame:
    r = forecasts(v).groupBy("h", D.bin_floor(F.col("p"), 0.05).alias("low")).agg(F.count("*").alias("n"), F.avg("p").alias("f"), F.avg("y").alias("o"))
    return r.groupBy("h").agg(R(F.sum(F.col("n") * F.abs(F.col("o") - F.col("f"))) / F.sum("n")).alias("error"), F.sum("n").alias("n"))


@query("reliability_two_source", "D-4 U-6", f"WITH {FORECASTS}, u AS (SELECT 'market' AS source, p, y FROM forecasts UNION ALL SELECT 'bid', bid, y FROM forecasts WHERE bid IS NOT NULL) SELECT source, round(least(floor(p * 10) / 10, 0.9), 1) AS bin, count(*) AS n, round(avg(p) + 1e-9, 6) AS forecast, round(avg(y), 6) AS observed FROM u GROUP BY 1, 2", FORECAST_USES)
def reliability_two_source(v: Views) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.lit("market").alias("source"), F.col("p").alias("f")), F.struct(F.lit("bid").alias("source"), F.col("bid").alias("f")))).alias("s")
    rows = forecasts(v).select("y", pairs).select("y", "s.*").filter("f is not null")
    return rows.groupBy("source", F.round(F.least(F.floor(F.col("f") * 10) / 10, F.lit(0.9)), 1).alias("bin")).agg(F.count("*").alias("n"), R(F.avg("f") + 1e-9).alias("forecast"), R(F.avg("y")).alias("observed"))


@query("month_roll_check", "W-15", "WITH c AS (SELECT month, price, lag(price) OVER (ORDER BY month) AS before FROM curve) SELECT strftime(month, '%Y-%m') AS month, round(price - before, 4) AS gap, month(month) = 1 AS new_year FROM c", "curve")
def month_roll_check(v: Views) -> DataFrame:
    w = Window.orderBy("month")  # one row a month
    return v.curve.select(F.date_format("month", "yyyy-MM").alias("month"), R(F.col("price") - F.lag("price").over(w), 4).alias("gap"), (F.month("month") == 1).alias("new_year"))


@query("lagged_feature", "W-16", f"WITH {MONTHLY}, z AS (SELECT *, CASE WHEN n = lag(n) OVER w THEN x END AS y FROM m WINDOW w AS (ORDER BY day)) SELECT strftime(day, '%Y-%m-%d') AS day, lag(y) OVER (ORDER BY day) AS known FROM z", "daily")
def lagged_feature(v: Views) -> DataFrame:
    rows = monthly(v).withColumn("y", F.when(F.col("n") == F.lag("n").over(by_day()), F.col("x")))
    return rows.select(DAY(), F.lag("y").over(by_day()).alias("known"))


@query("scalar_math", "X-1 X-2 X-8 X-9", "SELECT l_orderkey, l_linenumber, l_partkey % 7 AS m, round(pow(l_quantity, 2), 4) AS sq, round(sqrt(l_extendedprice), 6) AS root, round(ln(1 + l_quantity), 6) AS l1, round(exp(-l_discount), 6) AS e, CAST(sign(l_tax - 0.04) AS INTEGER) AS s, round(l_tax / nullif(l_discount, 0), 6) AS ratio, abs(-l_quantity) AS a FROM lineitem")
def scalar_math(v: Views) -> DataFrame:
    c = F.col
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_partkey") % 7).alias("m"), R(F.pow("l_quantity", F.lit(2)), 4).alias("sq"), R(F.sqrt("l_extendedprice")).alias("root"), R(F.log1p("l_quantity")).alias("l1"), R(F.exp(-c("l_discount"))).alias("e"),
        F.signum(c("l_tax") - 0.04).cast("int").alias("s"), R(F.try_divide("l_tax", "l_discount")).alias("ratio"), F.abs(-c("l_quantity")).alias("a"),
    )


@query("json_roundtrip", "X-27 X-15", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, printf('{\"k\":%d}', CAST(json_extract(props, '$.k') AS BIGINT)) AS again, TRY_CAST(nullif(event_type, '') AS DOUBLE) AS bad FROM events")
def json_roundtrip(v: Views) -> DataFrame:
    k = F.from_json("props", "k long, k_dollars long")
    rows = v.events.withColumn("j", k).withColumn("k", F.coalesce("j.k_dollars", "j.k"))
    return rows.select("event_id", "k", F.to_json(F.struct("k")).alias("again"), F.expr("try_cast(nullif(event_type, '') as double)").alias("bad"))


@query("string_regex", "X-16 X-17", "SELECT p_partkey, regexp_extract(p_name, '([^ ]+)$', 1) AS last, upper(p_type) AS type, length(regexp_replace(p_name, '[aeiou]', '', 'g')) AS consonants, starts_with(p_brand, 'Brand#1') AS first_brand, len(regexp_extract_all(p_name, '[a-z]+')) AS words, printf('%05d-%s', p_partkey, substr(p_brand, 7)) AS code FROM part")
def string_regex(v: Views) -> DataFrame:
    return v.table("part").select(
        "p_partkey", F.substring_index("p_name", " ", -1).alias("last"), F.upper("p_type").alias("type"), F.length(F.regexp_replace("p_name", "[aeiou]", "")).cast("long").alias("consonants"), F.col("p_brand").startswith("Brand#1").alias("first_brand"),
        F.size(F.regexp_extract_all("p_name", F.lit("([a-z]+)"))).cast("long").alias("words"), F.format_string("%05d-%s", "p_partkey", F.expr("substr(p_brand, 7)")).alias("code"),
    )


@query("tz_roundtrip", "X-18 X-19 X-26", "SELECT event_id, strftime(CAST(ts - INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') AS et_day, epoch(CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 21 HOUR)::BIGINT AS four_pm, strftime(CAST(ts - INTERVAL 18001 SECOND AS DATE), '%Y-%m-%d') AS covered FROM events")
def tz_roundtrip(v: Views) -> DataFrame:
    day = D.local_date(F.col("ts"))
    return v.events.select("event_id", day.cast("string").alias("et_day"), F.unix_seconds(D.local_instant(day, 16)).alias("four_pm"), D.local_date(F.col("ts") - F.expr("interval 1 second")).cast("string").alias("covered"))


@query("date_parts", "X-20 X-25 X-24", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) - 1 AS dow, day(last_day(o_orderdate)) AS days, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next_month, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def date_parts(v: Views) -> DataFrame:
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.weekday(d).alias("dow"), F.dayofmonth(F.last_day(d)).alias("days"), F.date_format(F.add_months(d, 1), "yyyy-MM").alias("next_month"), F.date_format(d, "yyyy-MM").alias("period"))


@query("profile_table", "S-24 S-5", """SELECT 'o_totalprice' AS name, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high, count(DISTINCT o_totalprice) AS n_distinct, round(avg(CAST(o_totalprice IS NULL AS INTEGER)), 6) AS nulls FROM orders
  UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), count(DISTINCT o_custkey), round(avg(CAST(o_custkey IS NULL AS INTEGER)), 6) FROM orders""")
def profile_table(v: Views) -> DataFrame:
    from tidemark.sources.tables import profile

    return profile(v.table("orders"), ["o_totalprice", "o_custkey"])


@query("sample_rows", "S-25")
def sample_rows(v: Views) -> DataFrame:
    from tidemark.sources.tables import seeded_sample

    return seeded_sample(v.table("orders"), 20, seed=1).select("o_orderkey", "o_totalprice")


@query("scan_sink_roundtrip", "S-1 S-2 S-3 S-7 S-21", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_sink_roundtrip(v: Views) -> DataFrame:
    from tidemark.sources.tables import csv_roundtrip

    return csv_roundtrip(v.table("customer").select("c_custkey", "c_name", "c_nationkey"))


@query("eod_wide", "U-4 W-13", f"WITH {EOD} SELECT strftime(day, '%Y-%m-%d') AS day, round(max(mid) FILTER (WHERE ticker = 1), 6) AS t1, round(max(mid) FILTER (WHERE ticker = 2), 6) AS t2 FROM eod WHERE ticker IN (1, 2) GROUP BY day", "contracts quotes")
def eod_wide(v: Views) -> DataFrame:
    return end_of_day(v, "ticker IN (1, 2)").groupBy("day").pivot("ticker", [1, 2]).agg(R(F.max("mid"))).select(DAY(), F.col("1").alias("t1"), F.col("2").alias("t2"))


# name: (table, the condition in both languages)
CHECKS = {
    "order key known": ("orders", "o_orderkey IS NOT NULL"), "order price positive": ("orders", "o_totalprice > 0"), "order day known": ("orders", "o_orderdate IS NOT NULL"),
    "order status listed": ("orders", "o_orderstatus IN ('F', 'O', 'P')"), "line quantity in range": ("lineitem", "l_quantity BETWEEN 1 AND 50"), "line discount in range": ("lineitem", "l_discount BETWEEN 0 AND 0.1"),
    "line tax small": ("lineitem", "l_tax < 0.08"), "line number in range": ("lineitem", "l_linenumber BETWEEN 1 AND 7"), "event value positive": ("events", "value > 0"), "event time known": ("events", "ts IS NOT NULL"),
    "event type listed": ("events", "event_type IN ('click', 'error', 'purchase', 'signup', 'view')"), "event has properties": ("events", "props LIKE '{%}'"),
}


@query("data_checks", "F-14 F-11", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failures FROM {table}" for name, (table, c) in CHECKS.items()))
def data_checks(v: Views) -> DataFrame:
    """How many rows of each table break each assertion, one pass a table."""
    parts = [failures(v.table(t), {name: F.expr(c) for name, (of, c) in CHECKS.items() if of == t}) for t in ("orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("checked_trades", "F-14", "SELECT trade_id, round(price, 6) AS price FROM trades WHERE price > 0 AND price < 1", "trades")
def checked_trades(v: Views) -> DataFrame:
    """Trades whose price is a probability: a row that isn't would stop the query."""
    return enforced(v.trades, {"price above 0": F.col("price") > 0, "price below 1": F.col("price") < 1}).select("trade_id", R("price").alias("price"))
