"""Table functions over whole tables, for SQL: rows come by partition and in order, one at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class RisingRuns:
    """``rising_runs(TABLE (t) PARTITION BY (key) ORDER BY (at), 'key', 'value')``: the stretches in which the value rises.

    Rows ``(key, value, n)``: the key, the value that a run begins with and its rows, in
    order. The columns have the types that the table's have. A null value ends a run
    and begins none. Only the run at hand is held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or key.value is None or value.value is None:
            raise ValueError("rising_runs takes a table and the names of its key and value columns")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [c for c in (key.value, value.value) if c not in kinds]
        if missing:
            raise ValueError(f"Missing required columns: {', '.join(missing)}")
        return AnalyzeResult(StructType([StructField(key.value, kinds[key.value]), StructField(value.value, kinds[value.value]), StructField("n", LongType())]))

    def __init__(self) -> None:
        self.run: list | None = None  # key, first value, rows
        self.last = None

    def eval(self, rows: Row, key: str, value: str) -> Iterator[tuple]:
        x = rows[value]
        if self.run and (x is None or not x > self.last):
            yield tuple(self.run)
            self.run = None
        if x is not None:
            if self.run:
                self.run[2] += 1
            else:
                self.run = [rows[key], x, 1]
            self.last = x

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    spark.udtf.register("rising_runs", RisingRuns)
