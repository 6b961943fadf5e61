import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.sources import pages, tables
from tidemark.streaming import candles


def test_paged_source_follows_cursors(spark, tmp_path):
    for name, body in {"0": {"rows": [{"a": 1}], "cursor": "x"}, "x": {"rows": [{"a": 2}, {"a": None}], "cursor": ""}}.items():
        (tmp_path / "k").mkdir(exist_ok=True)
        (tmp_path / "k" / f"{name}.json").write_text(json.dumps(body))
    spark.dataSource.register(pages.PagedJson)
    got = spark.read.format("paged_json").option("paths", f"{tmp_path}/k,{tmp_path}/missing").load()
    assert [r.a for r in got.select(F.get_json_object("row", "$.a").cast("int").alias("a")).collect()] == [1, 2, None]


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0


def test_json_payload_has_no_nan(spark, tmp_path):
    tables.write_json_payload(spark.createDataFrame([("k", 1.0), ("k", float("nan"))], "key string, x double"), f"{tmp_path}/j", "key")
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_candles_on_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(i, f"t{i % 2}", datetime(2024, 1, 1, 0, i % 7, i % 60), float(i % 11), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "trade_id long, ticker string, ts timestamp, price double, count double")
    df.union(df.limit(5)).write.parquet(f"{tmp_path}/in")
    stream = candles.candles(candles.without_copies(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), late=None)
    query = stream.writeStream.format("memory").queryName("c").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {tuple(r) for r in candles.candles(candles.without_copies(df)).collect()}
    assert {tuple(r) for r in spark.table("c").collect()} <= want and len(want) == 14
