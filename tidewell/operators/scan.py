"""Running values over long series, with each series cut into ranges that tasks share.

A window partitioned by series puts a whole series into one task. Here a series of
more than RANGE_ROWS rows is cut, by its order, into ranges of about that many. Each
range is scanned by itself; what the ranges before it come to is taken from a summary
of one row a range and put in: the last value, the largest, the product. Shorter
series are one range, and a table without long ones is a plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

#: Rows of a range, about; a series of more is cut.
RANGE_ROWS = 2_000_000
#: Most cuts of a series that are looked for.
MOST_CUTS = 1000

_CUTTABLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Scan:
    """A running value: inside a range, a range's summary, what earlier summaries come to, and both together."""

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]  # given the order of rows as a struct
    before: Callable[[str, WindowSpec], Column]
    joined: Callable[[Column, Column, Column], Column]  # local value, carry, whether the row is its range's first


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def filled(x: Column) -> Scan:
    """The last value that isn't null, up to and including the row's."""
    return Scan(
        lambda w: F.last(x, ignorenulls=True).over(_so_far(w)), lambda order: F.max_by(x, F.when(x.isNotNull(), order)),
        lambda s, w: F.last(s, ignorenulls=True).over(w), lambda local, carry, first: F.coalesce(local, carry),
    )


def previous(x: Column) -> Scan:
    """The value of the row before, null for a series' first row."""
    return Scan(
        lambda w: F.lag(x).over(w), lambda order: F.max_by(F.struct(x.alias("x")), order),
        lambda s, w: F.last(s).over(w)["x"], lambda local, carry, first: F.when(first, carry).otherwise(local),
    )


def row_number() -> Scan:
    """1 for a series' first row, and so on."""
    return Scan(
        lambda w: F.row_number().over(w).cast("bigint"), lambda order: F.count("*"),
        lambda s, w: F.sum(s).over(w), lambda local, carry, first: local + F.coalesce(carry, F.lit(0)),
    )


def running_max(x: Column) -> Scan:
    return Scan(lambda w: F.max(x).over(_so_far(w)), lambda order: F.max(x), lambda s, w: F.max(s).over(w), lambda local, carry, first: F.greatest(local, carry))


def running_sum(x: Column) -> Scan:
    """The sum of the values so far; nulls are left out."""
    return Scan(lambda w: F.sum(x).over(_so_far(w)), lambda order: F.sum(x), lambda s, w: F.sum(s).over(w), lambda local, carry, first: F.coalesce(local + carry, local, carry))


def running_product(x: Column) -> Scan:
    """The product of the values so far; nulls are left out."""
    return Scan(
        lambda w: F.product(x).over(_so_far(w)), lambda order: F.product(x), lambda s, w: F.product(s).over(w),
        lambda local, carry, first: F.when(local.isNull() | carry.isNull(), F.coalesce(local, carry)).otherwise(local * carry),
    )


class Ranges:
    """How the series of a frame are cut. ``order`` must be the same for all scans on it.

    Making it counts the rows of each series and, for those of more than ``rows``,
    asks for quantiles of the first order column; equal values of that column stay
    together. Series ordered first by text are not cut. The cuts, one for every
    ``rows`` rows at most, are held by the driver, so that every use sees the same.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = RANGE_ROWS) -> None:
        self.by, self.order = list(by), list(order)
        self.cuts: DataFrame | None = None
        if not isinstance(df.schema[self.order[0]].dataType, _CUTTABLE):
            return
        keys = self._keyed(df).groupBy("_key")
        long_ = keys.agg(F.count("*").alias("n")).where(F.col("n") > rows)
        most = long_.agg(F.max("n")).first()[0]
        if most is None:
            return
        parts = min(MOST_CUTS, -(-most // rows))
        at = [i / parts for i in range(1, parts)]
        first = F.percentile_approx(self.order[0], F.array(*map(F.lit, at)), F.lit(100 * parts)).alias("cuts")
        found = self._keyed(df).join(long_.select("_key"), "_key", "left_semi").groupBy("_key").agg(first)
        schema = found.schema
        self.cuts = df.sparkSession.createDataFrame([(r["_key"], sorted(set(r["cuts"]))) for r in found.collect()], schema)  # a cut for every range

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.struct(*self.by) if self.by else F.lit(0))

    def marked(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_key``, its series, and ``_range``, the number of its range."""
        df = self._keyed(df)
        if self.cuts is None:
            return df.withColumn("_range", F.lit(0))
        met = df.join(F.broadcast(self.cuts), "_key", "left")  # long series only
        passed = F.size(F.filter("cuts", lambda c: c < F.col(self.order[0])))
        return met.withColumn("_range", F.when(F.col("cuts").isNull(), 0).otherwise(passed)).drop("cuts")

    def window(self) -> WindowSpec:
        return Window.partitionBy("_key", "_range").orderBy(*self.order)

    def scan(self, df: DataFrame, scans: Mapping[str, Scan]) -> DataFrame:
        """A ``marked`` frame with a column for each scan."""
        w = self.window()
        out = df.withColumns({name: s.local(w) for name, s in scans.items()})
        if self.cuts is None:
            return out
        out = out.withColumn("_first", F.row_number().over(w) == 1)
        order = F.struct(*self.order)
        long_ = df.join(F.broadcast(self.cuts.select("_key")), "_key", "left_semi")
        sums = long_.groupBy("_key", "_range").agg(*(s.summary(order).alias(f"_s{i}") for i, s in enumerate(scans.values())))
        earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        carried = sums.select("_key", "_range", *(s.before(f"_s{i}", earlier).alias(f"_c{i}") for i, s in enumerate(scans.values()))).where("_range > 0")
        met = out.join(F.broadcast(carried), ["_key", "_range"], "left")  # a row for every RANGE_ROWS rows
        done = {name: s.joined(F.col(name), F.col(f"_c{i}"), F.col("_first")) for i, (name, s) in enumerate(scans.items())}
        return met.withColumns(done).drop("_first", *(f"_c{i}" for i in range(len(scans))))

    @staticmethod
    def plain(df: DataFrame) -> DataFrame:
        return df.drop("_key", "_range")


def scanned(df: DataFrame, scans: Mapping[str, Scan], *, by: Sequence[str] = (), order: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with a running value for each of ``scans``; ``order`` must put the rows of a series in a total order.

    Null keys are a series of their own. Column order is not kept where series are cut.
    """
    ranges = Ranges(df, by, order, rows)
    return ranges.plain(ranges.scan(ranges.marked(df), scans)).select(*df.columns, *scans)
