"""The table function over partitions of a table."""

import pytest

from tidewell.functions import tables


def test_rising_runs(spark):
    tables.register(spark)
    values = {"a": [1.0, 2.0, 3.0, 3.0, 4.0, 1.0], "b": [None, 5.0, None, 1.0, 2.0, None], "c": [None], None: [7.0, 8.0]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows[::-1], "k string, i int, v double").createOrReplaceTempView("rising_rows")
    got = spark.sql("SELECT * FROM rising_runs(TABLE(rising_rows) PARTITION BY (k) ORDER BY (i), 'k', 'v')")
    assert got.dtypes == [("k", "string"), ("v", "double"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1.0, 3), ("a", 3.0, 2), ("a", 1.0, 1), ("b", 5.0, 1), ("b", 1.0, 2), (None, 7.0, 2)], key=str)
    with pytest.raises(Exception, match="Missing required columns: w"):
        spark.sql("SELECT * FROM rising_runs(TABLE(rising_rows) PARTITION BY (k) ORDER BY (i), 'k', 'w')").collect()
    spark.catalog.dropTempView("rising_rows")
