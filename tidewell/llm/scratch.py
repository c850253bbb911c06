"""Intermediate tables that cut lineage.

An intermediate result that several later steps read is written once as Parquet
under the folder named by ``spark.checkpoint.dir``, which every executor sees, so
a lost executor only costs a re-read. Where that setting is absent, on one machine
only, a temporary folder is chosen and stored in the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.shared import remove, shared_dir


def column(name: str) -> Column:
    """The column of that very name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *apart: str) -> Column:
    """All columns but those named as one struct column ``rest`` with plain field names, so that their names meet none used inside."""
    kept = [c for c in df.columns if c not in apart]
    return F.struct(F.lit(0).alias("none"), *(column(c).alias(f"c{i}") for i, c in enumerate(kept))).alias("rest")


def unpacked(df: DataFrame, *apart: str) -> list[Column]:
    """The columns of ``df`` that ``packed(df, *apart)`` holds, under their names."""
    kept = [c for c in df.columns if c not in apart]
    return [F.col("rest").getField(f"c{i}").alias(c) for i, c in enumerate(kept)]


def replaced(df: DataFrame, name: str, value: Column, *apart: str) -> list[Column]:
    """The columns of ``df`` in order, from ``packed(df, name, *apart)``, with ``value`` in the place of ``name`` and without ``apart``."""
    held = iter(unpacked(df, name, *apart))
    return [value.alias(c) if c == name else next(held) for c in df.columns if c not in apart]


class Scratch:
    """Tables of one operator call. ``drop`` frees those that its result doesn't read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet under ``name`` and read it back."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


BATCH_BYTES = 4_000_000  # of rows that go to Python at once


def byte_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on Arrow batches of the session hold some ``size`` bytes at most, unless it has a limit of its own.

    A plan takes the setting when it runs, and what an operator returns runs later, so it stays. Without it a batch of
    10,000 whole texts is held several times over: by the task in Arrow's memory, and by its Python worker as rows that
    came, as strings and as rows that go. A longer text is a batch alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


@contextmanager
def row_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the plans that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
