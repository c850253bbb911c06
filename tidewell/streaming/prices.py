"""Prices as a stream: late-bounded closing values, and micro-batches into the table store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.series import valid_prices
from tidewell.schemas import TABLES, require_columns
from tidewell.sources.store import TableStore


def closing_values(ticks: DataFrame, *, ts: str = "ts", key: str = "asset_id", value: str = "close", window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """``(key, window_end, value)``: the last value of each tumbling window, once the watermark has passed it."""
    require_columns(ticks, ts, key, value)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts)))
    return ticks.withWatermark(ts, lateness).groupBy(key, F.window(ts, window).alias("w")).agg(last.alias(value)).select(key, F.col("w.end").alias("window_end"), value)


def sliding_values(ticks: DataFrame, *, ts: str = "ts", key: str = "asset_id", value: str = "close", length: str = "1 hour", slide: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """``(key, window_start, window_end, low, high, n)`` of overlapping windows, once the watermark has passed them."""
    require_columns(ticks, ts, key, value)
    bars = ticks.withWatermark(ts, lateness).groupBy(key, F.window(ts, length, slide).alias("w")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return bars.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "low", "high", "n")


def trading_sessions(ticks: DataFrame, *, ts: str = "ts", key: str = "asset_id", value: str = "close", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """``(key, session_start, session_end, n, low, high)``: runs of ticks less than ``gap`` apart; a session ends a gap after its last tick."""
    require_columns(ticks, ts, key, value)
    bars = ticks.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return bars.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "low", "high")


def distinct_ticks(ticks: DataFrame, *, on: Sequence[str] = ("asset_id", "tick_id"), ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """The first tick of each key; a repeat within ``lateness`` of it is left out, and the state for it goes after that."""
    require_columns(ticks, ts, *on)
    return ticks.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(on))


def split_late(ticks: DataFrame, folder: str, checkpoint: str, *, ts: str = "ts", lateness: str = "1 hour") -> StreamingQuery:
    """Micro-batches into ``folder/on_time`` and ``folder/late``, a sub-folder a batch.

    Late is what lies more than ``lateness`` before the latest time of the batches
    before: the rows that a watermark of that delay makes Spark drop. That time is kept
    under ``folder/marks``, so a batch run again, or a restart, splits alike. Rows
    without a time are late.
    """
    require_columns(ticks, ts)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], "batch bigint, high timestamp").write.mode("append").parquet(f"{folder}/marks/batch_id=-1")
        marks = spark.read.schema("batch bigint, high timestamp").option("recursiveFileLookup", "true").parquet(f"{folder}/marks")
        high = marks.where(F.col("batch") < n).agg(F.max("high")).first()[0]
        bound = F.lit(high).cast("timestamp") - F.expr(f"interval {lateness}")
        late = F.col(ts).isNull() if high is None else F.coalesce(F.col(ts) < bound, F.lit(True))
        batch = batch.persist()
        batch.where(~late).write.mode("overwrite").parquet(f"{folder}/on_time/batch_id={n}")
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch_id={n}")
        batch.agg(F.lit(n).cast("bigint").alias("batch"), F.max(ts).cast("timestamp").alias("high")).write.mode("overwrite").parquet(f"{folder}/marks/batch_id={n}")
        batch.unpersist()

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_prices(stream: DataFrame, store: TableStore, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch of valid price rows; a batch run again after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        good = valid_prices(batch)
        schema = TABLES["prices"][0]
        store.upsert("prices", good.select(*(F.col(f.name).cast(f.dataType) if f.name in good.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields)))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
