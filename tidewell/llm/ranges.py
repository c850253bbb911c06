"""Running sums over a whole table, without a window that needs all rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidewell.llm.scratch import Scratch


def _summed(batches: Iterator[pa.RecordBatch], sums: int) -> Iterator[pa.RecordBatch]:
    """The last ``sums`` columns as running sums of the task's rows."""
    carried = [0] * sums
    for batch in batches:
        k = batch.num_columns - sums
        columns = list(batch.columns)
        for i in range(sums if batch.num_rows else 0):
            run = np.cumsum(columns[k + i].to_numpy(zero_copy_only=False)) + carried[i]
            carried[i] = run[-1]
            columns[k + i] = pa.array(run)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with running sums, up to and including each row, in a total order of its rows.

    Rows are sorted into ranges, each range is summed by its task, and what the
    ranges before hold is added from a table of one row a range. What is summed
    mustn't be null or negative. The result is read from a table named ``name``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    placed = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*(f"_o{i}" for i in range(len(order))))
    placed = placed.select("*", F.spark_partition_id().alias("_range"), *(c.alias(k) for k, c in sums.items()))
    kinds = [StructField(k, DoubleType() if placed.schema[k].dataType == DoubleType() else LongType()) for k in sums]
    placed = placed.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in kinds})
    width = len(sums)
    placed = placed.mapInArrow(lambda it: _summed(it, width), StructType([*placed.schema.fields[: -len(sums)], *kinds]))
    placed = scratch.save(placed, name)
    held = placed.groupBy("_range").agg(*(F.max(k).alias(k) for k in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = held.select(F.col("_range").alias("_r"), *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    joined = placed.join(F.broadcast(held), F.col("_range") == F.col("_r"))
    return joined.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_range", "_r", *(f"_b_{k}" for k in sums))
