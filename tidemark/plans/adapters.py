"""Market-shaped views over the supplied tables, in DataFrame form and as SQL for the oracle.

contracts: one for each user of events. quotes: events other than purchases. trades: purchases. ladders: lineitem by order
and line number. daily: orders by date. curve: monthly means of orders as a futures-like strip.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLOSE = "2024-01-31 00:00:00"


def _price(value: Column) -> Column:
    return F.lit(0.005) + F.lit(0.99) * ((value % 100) / F.lit(100.0))


class Views:
    """Lazily built views of one folder of tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def contracts(self) -> DataFrame:
        rows = self.events.groupBy("user_id").agg(F.min("ts").alias("open_ts"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("volume"))
        move = F.element_at(F.array(*map(F.lit, (-50, -25, 0, 25, 50))), (F.floor(F.col("user_id") / 10) % 5 + 1).cast("int"))
        return rows.select(
            F.col("user_id").alias("ticker"), (F.col("user_id") % 10).alias("event"), move.alias("move_bps"), F.when(F.col("user_id") % 3 == 0, "yes").otherwise("no").alias("result"),
            "open_ts", F.lit(CLOSE).cast("timestamp").alias("close_ts"), "volume",
        )

    @cached_property
    def quotes(self) -> DataFrame:
        half = (F.col("event_id") % 20) / F.lit(100.0)
        rows = self.events.filter("event_type <> 'purchase'").withColumn("m", _price(F.col("value")))
        bid = F.when(F.col("event_id") % 50 != 0, F.greatest(F.col("m") - half, F.lit(0.0)))
        return rows.select(F.col("user_id").alias("ticker"), "ts", bid.alias("bid"), F.least(F.col("m") + half, F.lit(1.0)).alias("ask"), F.col("m").alias("mid"), (half * 2).alias("spread"), F.col("value").alias("size"), F.col("event_id").alias("quote_id"))

    @cached_property
    def trades(self) -> DataFrame:
        return self.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("trade_id"), F.col("user_id").alias("ticker"), "ts", _price(F.col("value")).alias("price"), F.col("value").alias("count"))

    @cached_property
    def ladders(self) -> DataFrame:
        rows = self.table("lineitem").groupBy(F.col("l_orderkey").alias("event"), F.col("l_linenumber").cast("int").alias("strike"))
        rows = rows.agg(F.least(F.round(F.avg("l_discount") * 10, 6), F.lit(1.0)).alias("p"), F.round(F.avg("l_tax"), 6).alias("spread"))
        return rows.withColumn("w", F.lit(1.0) / (F.col("spread") + 0.02)).withColumn("result", F.when(F.col("strike") <= F.col("event") % 8, "yes").otherwise("no"))

    @cached_property
    def daily(self) -> DataFrame:
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (F.count("*") * 100)).alias("x"), F.count("*").alias("n"))

    @cached_property
    def curve(self) -> DataFrame:
        month = F.trunc("day", "MM")
        return self.daily.groupBy(month.alias("month")).agg(F.round(F.lit(95.0) + F.avg("x") % 500 / 100 + 1e-7, 4).alias("price"), F.min("day").alias("first_day"))


_PRICE = "(0.005::DOUBLE + 0.99::DOUBLE * ((value % 100) / 100.0::DOUBLE))"
_SQL = {
    "contracts": f"""contracts AS (SELECT user_id AS ticker, user_id % 10 AS event,
        CASE (user_id // 10) % 5 WHEN 0 THEN -50 WHEN 1 THEN -25 WHEN 2 THEN 0 WHEN 3 THEN 25 ELSE 50 END AS move_bps,
        CASE WHEN user_id % 3 = 0 THEN 'yes' ELSE 'no' END AS result, min(ts) AS open_ts, TIMESTAMP '{CLOSE}' AS close_ts,
        coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS volume FROM events GROUP BY user_id)""",
    "quotes": f"""quotes AS (SELECT user_id AS ticker, ts, CASE WHEN event_id % 50 <> 0 THEN greatest(m - h, 0) END AS bid,
        least(m + h, 1) AS ask, m AS mid, h * 2 AS spread, value AS size, event_id AS quote_id
        FROM (SELECT *, {_PRICE} AS m, (event_id % 20) / 100.0::DOUBLE AS h FROM events WHERE event_type <> 'purchase'))""",
    "trades": f"""trades AS (SELECT event_id AS trade_id, user_id AS ticker, ts, {_PRICE} AS price, value AS count FROM events WHERE event_type = 'purchase')""",
    "ladders": """ladders AS (SELECT *, 1.0::DOUBLE / (spread + 0.02::DOUBLE) AS w, CASE WHEN strike <= event % 8 THEN 'yes' ELSE 'no' END AS result FROM (
        SELECT l_orderkey AS event, l_linenumber AS strike, least(round(avg(l_discount) * 10, 6), 1) AS p, round(avg(l_tax), 6) AS spread FROM lineitem GROUP BY ALL))""",
    "daily": """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS x, count(*) AS n FROM orders GROUP BY 1)""",
    "curve": """curve AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, round(95.0::DOUBLE + avg(x) % 500 / 100 + 1e-7, 4) AS price, min(day) AS first_day FROM daily GROUP BY 1)""",
}
_NEEDS = {"curve": ["daily"]}


def ctes(names: list[str], body: str) -> str:
    """body behind the CTEs of the adapters it names; a body that begins with WITH goes on from them."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    if not wanted:
        return body
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    body = body.strip()
    head += ", ".join(_SQL[n] for n in wanted)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return head + ", " + body.removeprefix(start)
    return head + " " + body
