"""Price histories into the store, the benchmark file, and snapshot paths and schemas."""

import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell.sources import prices, snapshots
from tidewell.sources.store import TableStore


def history(spark):
    rows = [("2010-01-04", "1.5", "2", "1", "1.75", "100", "9"), ("2024-01-02", "n/a", "2", "1", "2.5", "1e3", "9"), (None, "1", "1", "1", "1", "1", "9"), ("2024-01-03", "1", "1", "1", None, "1", "9"), ("bad", "1", "1", "1", "1", "1", "9")]
    return spark.createDataFrame(rows, "Date string, Open string, High string, low string, ` Close` string, Volume string, `Adj Close` string")


def test_history_to_prices(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    assert prices.load_history(store, history(spark), F.lit("SPY"), F.lit("test")) == 2
    assert prices.load_history(store, history(spark), F.lit("SPY"), F.lit("again")) == 2
    got = {r.date: (r.asset_id, r.open, r.close, r.volume, r.source) for r in store.read("prices").collect()}
    assert got == {date(2010, 1, 4): ("SPY", 1.5, 1.75, 100, "again"), date(2024, 1, 2): ("SPY", None, 2.5, 1000, "again")}
    assert prices.price_rows(spark.createDataFrame([("2024-01-01", 1.0)], "date string, close double"), F.lit("X"), F.lit("t")).first().volume is None


def test_benchmark_is_one_file_and_a_failed_write_leaves_it(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/db")
    prices.load_history(store, history(spark), F.lit("SPY"), F.lit("test"))
    place = tmp_path / "bench" / "spy_10y.parquet"
    place.parent.mkdir()
    for _ in range(2):  # the second time in the place of the first
        prices.write_benchmark(store, "SPY", f"file://{place}")
    assert place.is_file() and [r.date for r in spark.read.parquet(f"file://{place}").collect()] == [date(2024, 1, 2)]
    with pytest.raises(Exception, match="broken"):
        prices.write_one_file(spark.range(1).select(F.raise_error(F.lit("broken")).alias("x").cast("int")), f"file://{place}")
    assert spark.read.parquet(f"file://{place}").count() == 1 and [f.name for f in place.parent.iterdir() if not f.name.endswith(".crc")] == [place.name]


def test_snapshot_paths_and_schema(spark, tmp_path):
    root = Path(snapshots.__file__).resolve().parents[2]
    assert snapshots.project_path("data/x.json") == root / "data/x.json" and snapshots.project_path(tmp_path) == tmp_path
    place = tmp_path / "sp500.json"
    snapshots.write_snapshot([{"symbol": "A"}], place, "sp500")
    place.with_suffix(".schema.json").unlink()
    assert not snapshots.ensure_snapshot(spark, "sp500", place).refreshed
    schema = json.loads(place.with_suffix(".schema.json").read_text())
    assert schema["$id"] == "sp500_constituents.schema.json" and all(p["description"] for p in schema["items"]["properties"].values())
