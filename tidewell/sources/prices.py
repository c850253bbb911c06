"""Daily price histories: provider rows into the ``prices`` table, and a benchmark as one Parquet file."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import to_date, to_double
from tidewell.schemas import PRICES
from tidewell.sources.store import TableStore


def price_rows(history: DataFrame, asset_id: Column, source: Column, ingestion_ts: Column | None = None) -> DataFrame:
    """Provider rows in the shape of ``prices``: columns by name, whatever their case and blanks; numbers coerced.

    Columns that the provider lacks are null, others are left out. Rows without a date
    or a close stay out.
    """
    found = {c.strip().lower().replace(" ", "_"): F.col("`" + c.replace("`", "``") + "`") for c in history.columns}
    none = F.lit(None)
    numbers = {c: to_double(found.get(c, none)).alias(c) for c in ("open", "high", "low", "close")}
    volume = found.get("volume", none).try_cast("double").cast("bigint").alias("volume")
    at = (ingestion_ts if ingestion_ts is not None else F.current_timestamp()).cast("timestamp_ntz").alias("ingestion_ts")
    rows = history.select(asset_id.cast("string").alias("asset_id"), to_date(found.get("date", none)).alias("date"), *numbers.values(), volume, source.cast("string").alias("source"), at)
    return rows.where("date is not null and close is not null").select(*PRICES.fieldNames())


def load_history(store: TableStore, history: DataFrame, asset_id: Column, source: Column) -> int:
    """Upsert a provider's history into ``prices``; the number of rows taken. Any number of assets may come at once."""
    return store.upsert("prices", price_rows(history, asset_id, source))


def write_one_file(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A small table, such as one benchmark's years of days, as one file of that name.

    It is written beside its place and then renamed, so readers see the file before or
    after, and a write that fails leaves nothing.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside, goal = hadoop.Path(f"{path}.{uuid.uuid4().hex}.writing"), hadoop.Path(path)
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.coalesce(1).write.format(kind).save(beside.toString())
        (made,) = (f.getPath() for f in fs.listStatus(beside) if f.getPath().getName().startswith("part-"))
        option = getattr(hadoop, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(option, 1)
        how[0] = option.OVERWRITE
        hadoop.FileContext.getFileContext(goal.toUri(), spark._jsc.hadoopConfiguration()).rename(made, goal, how)
    finally:
        fs.delete(beside, True)


def write_benchmark(store: TableStore, asset_id: str, path: str, years: int = 10) -> None:
    """The asset's last ``years`` of ``prices`` rows up to its latest one, in order of date, as one Parquet file."""
    rows = store.read("prices").where(F.col("asset_id") == asset_id)
    latest = rows.agg(F.max("date").alias("latest"))
    kept = rows.crossJoin(F.broadcast(latest)).where(F.col("date") > F.add_months("latest", -12 * years)).drop("latest")  # one row
    write_one_file(kept.orderBy("date"), path)
