"""Range joins against all pairs."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import intervals


def rows(seed, n, scale):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.uniform(-500, 500)
        out.append((i, rng.choice(["a", "b", None]), start, start + rng.choice([0.0, -1.0, 1e-9, 1.0, 7.5, 100.0, 5000.0]) * scale))
    return [*out, (n, "a", None, 1.0), (n + 1, "a", 1.0, None), out[0]]


def pairs(df):
    return sorted((r.left.id, r.right.id) for r in df.collect())


@pytest.mark.parametrize("by", [[], ["k"]])
def test_overlaps(spark, by):
    left, right = rows(1, 120, 1.0), rows(2, 90, 0.3)
    schema = "id int, k string, s double, e double"
    got = intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), left_ends=("s", "e"), right_ends=("s", "e"), by=by)
    want = sorted((a[0], b[0]) for a in left for b in right if None not in (*a[2:], *b[2:]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3] and (not by or a[1] is not None and a[1] == b[1]))
    assert pairs(got) == want and want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "bigint", "decimal(20,3)"])
def test_points(spark, kind):
    rng = random.Random(4)
    point = [(i, rng.randint(-400, 400)) for i in range(150)] + [(200, None)]
    held = [(i, x := rng.randint(-400, 400), x + rng.choice([0, 1, 30, 700])) for i in range(40)]
    if kind == "date":
        at = lambda d: None if d is None else date(2001, 1, 1) + timedelta(d)
    elif kind.startswith("timestamp"):
        at = lambda d: None if d is None else datetime(2001, 1, 1) + timedelta(seconds=d)
    else:
        at = lambda d: d
    base = kind if kind in ("date", "timestamp", "timestamp_ntz") else "bigint"
    p = spark.createDataFrame([(i, at(x)) for i, x in point], f"id int, p {base}").withColumn("p", F.col("p").cast(kind))
    h = spark.createDataFrame([(i, at(s), at(e)) for i, s, e in held], f"id int, s {base}, e {base}").withColumns({c: F.col(c).cast(kind) for c in ("s", "e")})
    want = sorted((i, j) for i, x in point if x is not None for j, s, e in held if s <= x <= e)
    assert pairs(intervals.point_join(p, h, point="p", ends=("s", "e"))) == want
    assert intervals.point_join(p.limit(0), h.limit(0), point="p", ends=("s", "e")).count() == 0


def test_text_is_no_axis(spark):
    df = spark.createDataFrame([("a", "b")], "s string, e string")
    with pytest.raises(ValueError):
        intervals.overlap_join(df, df, left_ends=("s", "e"), right_ends=("s", "e"))


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("width", [0.3, None])
def test_totals_equal_those_of_the_pairs(spark, by, width):
    """Also with ends cut into ranges, with equal rows, null keys and ends, and points on one side."""
    schema = "id int, k string, s double, e double"
    left = spark.createDataFrame(rows(1, 120, 1.0), schema)
    right = spark.createDataFrame(rows(2, 90, width or 1.0), schema).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id") * 10))
    ends = ("s", "e") if width else ("s", "s")
    totals = {"n": ("count", "*"), "nx": ("count", "x"), "total": ("sum", "x"), "least": ("min", "x"), "most": ("max", "x")}
    got = intervals.overlap_totals(left, right, left_ends=("s", "e"), right_ends=ends, totals=totals, by=by, range_rows=40)
    met = intervals.overlap_join(left.distinct(), right, left_ends=("s", "e"), right_ends=ends, by=by).groupBy("left.id")
    made = met.agg(F.count("*").alias("n"), F.count("right.x").alias("nx"), F.sum("right.x").alias("total"), F.min("right.x").alias("least"), F.max("right.x").alias("most"))
    want = left.join(made, "id", "left").fillna(0, ["n", "nx"]).select(*left.columns, *totals)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.agg(F.max("n")).first()[0] > 20


def test_totals_of_nine_million_pairs(spark):
    """Three thousand times three thousand equal rows: nine million pairs, of which none is made."""
    df = spark.range(3000).select("id", F.lit(1).alias("s"), F.lit(5).alias("e"))
    out = intervals.overlap_totals(df, df.select(F.col("id").alias("other"), F.col("s").alias("b"), F.col("e").alias("c")), left_ends=("s", "e"), right_ends=("b", "c"), totals={"n": ("count", "*"), "first": ("min", "other")})
    assert out.groupBy("n", "first").count().collect() == [(3000, 0, 3000)]
    with pytest.raises(ValueError):
        intervals.overlap_totals(df, df, left_ends=("s", "e"), right_ends=("s", "e"), totals={"id": ("count", "*")})
