"""Streams over files: windows with a watermark, and upserts by micro-batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import technical
from tidewell.sources.store import TableStore
from tidewell.streaming import prices, stateful

TICKS = "asset_id string, ts timestamp, close double"


def test_closing_values(spark, tmp_path):
    rows = [("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-01 12:00:00", 2.0), ("A", "2024-01-02 09:00:00", None), ("A", "2024-02-01 00:00:00", 9.0)]
    spark.createDataFrame(rows, "asset_id string, ts string, close double").selectExpr("asset_id", "cast(ts as timestamp) ts", "close").write.parquet(f"{tmp_path}/in")
    stream = prices.closing_values(spark.readStream.schema(TICKS).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("closing").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {str(r.window_end): r.close for r in spark.table("closing").collect()}
    assert got == {"2024-01-02 00:00:00": 2.0, "2024-01-03 00:00:00": None}


def test_upsert_prices(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    rows = [("A", "2024-01-01", 1.0), ("A", None, 2.0), ("B", "2024-01-01", 3.0)]
    schema = "asset_id string, date string, close double"
    for n, part in enumerate((rows, [("A", "2024-01-01", 5.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        prices.upsert_prices(stream, store, f"{tmp_path}/c").awaitTermination(120)
    assert {(r.asset_id, r.close) for r in store.read("prices").collect()} == {("A", 5.0), ("B", 3.0)}


def files(spark, folder, batches):
    """A file for each batch of (asset, seconds, close)."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "asset_id string, s bigint, close double").selectExpr("asset_id", "timestamp_seconds(1700000000 + s) as ts", "close")
        df.coalesce(1).write.mode("append").parquet(folder)
        if n + 1 < len(batches):
            __import__("time").sleep(0.02)  # files are read in order of their time


def stream_of(spark, folder):
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(folder)


def run_into(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None


def shuffled_ticks(seed, n=160):
    """Ticks of three assets out of order by up to some minutes, in batches; the last one moves the watermark past all."""
    rng = random.Random(seed)
    rows = [(rng.choice("ABC"), 60 * i, 100 + rng.gauss(0, 5)) for i in range(n)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.randint(0, 1500))
    return rows, [*(mixed[i : i + 40] for i in range(0, n, 40)), [("Z", 60 * n + 100_000, 1.0)], [("Z", 60 * n + 100_001, 1.0)]]


def test_rsi_stream_equals_batch_after_a_restart(spark, tmp_path):
    for key, value in stateful.ROCKSDB.items():
        spark.conf.set(key, value)
    try:
        rows, batches = shuffled_ticks(1)
        for part in (batches[:2], batches[2:]):  # stopped and started again on one checkpoint
            files(spark, f"{tmp_path}/in", part)
            run_into(stateful.rsi_stream(stream_of(spark, f"{tmp_path}/in"), lateness="30 minutes", period=5, oversold=45, overbought=55), f"{tmp_path}/out", f"{tmp_path}/c")
        got = spark.read.parquet(f"{tmp_path}/out").where("asset_id <> 'Z'").toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True)
        frame = spark.createDataFrame(rows, "asset_id string, s bigint, close double").selectExpr("asset_id", "timestamp_seconds(1700000000 + s) as ts", "close")
        want = technical.rsi(frame, by=["asset_id"], order=["ts"], period=5).withColumn("signal", technical.rsi_signal(F.col("rsi"), 45, 55))
        want = technical.positions(want, by=["asset_id"], order="ts").toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True)
        assert len(got) == len(want) == 160
        np.testing.assert_allclose(got.rsi.astype(float), want.rsi.astype(float))
        for c in ("asset_id", "ts", "signal", "position", "entry"):
            assert got[c].tolist() == want[c].tolist()
    finally:
        for key in stateful.ROCKSDB:
            spark.conf.unset(key)


@pytest.mark.parametrize("name,options", [("sliding_values", {"length": "20 minutes", "slide": "5 minutes"}), ("trading_sessions", {"gap": "150 seconds"})])
def test_windows_of_ticks_out_of_order(spark, tmp_path, name, options):
    rows, batches = shuffled_ticks(2)
    files(spark, f"{tmp_path}/in", batches)
    run_into(getattr(prices, name)(stream_of(spark, f"{tmp_path}/in"), lateness="30 minutes", **options), f"{tmp_path}/out", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").where("asset_id <> 'Z'").collect()
    want = getattr(prices, name)(spark.read.parquet(f"{tmp_path}/in").where("asset_id <> 'Z'"), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_repeats_and_late_rows(spark, tmp_path):
    rows, batches = shuffled_ticks(3)
    late = ("A", 60, 7.0)
    batches = [*batches[:-2], [late, batches[0][0], ("B", 60 * 170, 1.0)]]  # hours after both rows
    files(spark, f"{tmp_path}/in", batches)
    for _ in range(2):  # the second time nothing is left to read
        assert prices.split_late(stream_of(spark, f"{tmp_path}/in"), f"{tmp_path}/split", f"{tmp_path}/c2", lateness="30 minutes").awaitTermination(240)
    parts = {k: [(r.asset_id, int(r.ts.timestamp()) - 1700000000, r.close) for r in spark.read.parquet(f"{tmp_path}/split/{k}").collect()] for k in ("on_time", "late")}
    assert sorted(parts["late"]) == sorted([late, batches[0][0]]) and len(parts["on_time"]) == 161
    again = [batches[0], batches[0][:20], batches[1]]
    files(spark, f"{tmp_path}/twice", again)
    run_into(prices.distinct_ticks(stream_of(spark, f"{tmp_path}/twice"), on=("asset_id", "ts", "close"), lateness="10 hours"), f"{tmp_path}/once", f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 80
