"""Joins on ranges without comparing all pairs.

Every interval gets a level, the power of two next above its length, and a bin is a
stretch of that length, so an interval touches two bins of its level at most, however
long it is. Rows meet by level and bin, an equality join that shuffles by both; pairs
that meet in two bins count in the first one they share. Lengths may differ by any
factor: no bin width has to fit them all.

Where only totals over each row's partners are asked for, ``overlap_totals`` makes no
pairs, which may grow with the square of the tables: see there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.scan import RANGE_ROWS, row_number, scanned
from tidewell.shared import kept

#: Lengths below two to this power share a level.
LEAST_LEVEL = -20


def _axis(df: DataFrame, name: str) -> Column:
    """The column as a double, so that order is kept; days for dates, microseconds for times."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp_ltz(F.col(name).cast("string"))).cast("double")
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{name} is neither a number nor a time")
    return F.col(name).cast("double")


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def _side(df: DataFrame, by: Sequence[str], start: str, end: str, prefix: str) -> DataFrame:
    """All columns as ``<prefix>row``, the keys, the ends on the axis and the interval's level; rows that hold nothing are left out."""
    s, e = _axis(df, start), _axis(df, end)
    rows = df.where(F.col(start) <= F.col(end)).select(F.struct(*(F.col(c) for c in df.columns)).alias(f"{prefix}row"), *(F.col(c).alias(f"{prefix}k{i}") for i, c in enumerate(by)), s.alias(f"{prefix}s"), e.alias(f"{prefix}e"))
    length = F.col(f"{prefix}e") - F.col(f"{prefix}s")
    return rows.withColumn(f"{prefix}own", F.when(length > 0, F.greatest(F.ceil(F.log2(length)), F.lit(LEAST_LEVEL))).otherwise(LEAST_LEVEL).cast("int"))


def _levels(side: DataFrame, prefix: str) -> list[int]:
    """The levels that occur; a double's range has some two thousand, tables have a few."""
    return sorted(r[0] for r in side.select(f"{prefix}own").distinct().collect())


def _placed(side: DataFrame, prefix: str, levels: Sequence[int]) -> DataFrame:
    """A row for each of ``levels`` not below the interval's own and each bin that it touches there."""
    own, s, e = (F.col(f"{prefix}{c}") for c in ("own", "s", "e"))
    reached = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= own)
    at = side.withColumn(f"{prefix}level", F.explode(reached))
    level = F.col(f"{prefix}level")
    return at.withColumn(f"{prefix}first", _bin(s, level)).withColumn(f"{prefix}bin", F.explode(F.sequence(F.col(f"{prefix}first"), _bin(e, level))))


def overlap_join(left: DataFrame, right: DataFrame, *, left_ends: tuple[str, str], right_ends: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``(left, right)``: structs of all pairs whose closed intervals meet, and whose ``by`` columns are equal.

    Null ends and intervals that end before they start meet nothing; null keys are
    equal to nothing. Repeated rows give repeated pairs. Levels are found by a job.
    """
    a, b = _side(left, by, *left_ends, "a_"), _side(right, by, *right_ends, "b_")
    levels = sorted({*_levels(a, "a_"), *_levels(b, "b_")})
    if not levels:
        levels = [0]
    a, b = _placed(a, "a_", levels), _placed(b, "b_", levels)
    same = (F.col("a_level") == F.col("b_level")) & (F.col("a_bin") == F.col("b_bin"))
    for i in range(len(by)):
        same = same & (F.col(f"a_k{i}") == F.col(f"b_k{i}"))
    # A pair meets at the larger of its levels, and there in the first bin that it shares.
    once = (F.col("a_level") == F.greatest("a_own", "b_own")) & (F.col("a_bin") == F.greatest("a_first", "b_first"))
    meets = (F.col(f"a_row.{left_ends[0]}") <= F.col(f"b_row.{right_ends[1]}")) & (F.col(f"b_row.{right_ends[0]}") <= F.col(f"a_row.{left_ends[1]}"))
    return a.join(b, same & once & meets).select(F.col("a_row").alias("left"), F.col("b_row").alias("right"))


def point_join(points: DataFrame, intervals: DataFrame, *, point: str, ends: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``(left, right)``: structs of each point with every closed interval that holds it, see ``overlap_join``."""
    return overlap_join(points, intervals, left_ends=(point, point), right_ends=ends, by=by)


#: Kinds of totals: of rows, and of totals of parts.
_TOTALS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def _ends(df: DataFrame, by: Sequence[str], ends: tuple[str, str], totals: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The different intervals of each key as ``_k<i>``, ``_s`` and ``_e``, with the totals ``_t<j>`` of their rows."""
    for c in ends:
        _axis(df, c)  # a number or a time
    s, e = map(F.col, ends)
    rows = df.where(reduce(lambda a, c: a & F.col(c).isNotNull(), by, s <= e))
    keys = (*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), s.alias("_s"), e.alias("_e"))
    if not totals:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*(_TOTALS[kind][0](of).alias(f"_t{j}") for j, (kind, of) in enumerate(totals.values())))


def _numbered(side: DataFrame, values: DataFrame) -> DataFrame:
    """``side`` with the places ``_lo`` and ``_hi`` of its ends among all ends. Sorted joins: what is exploded or distinct can be far more than Spark reckons before it sends a side to all tasks."""
    for end, place in (("_s", "_lo"), ("_e", "_hi")):
        side = side.join(values.select(F.col("_v").alias(end), F.col("_i").alias(place)).hint("merge"), end)
    return side


def _top(side: DataFrame, low: Column) -> int:
    """The level of the largest node inside any stretch from ``low`` to ``_hi``."""
    longest = side.agg(F.max(F.col("_hi") - low + 1)).first()[0]
    return max(longest or 1, 1).bit_length() - 1


def _cover(low: Column, high: Column, top: int) -> Column:
    """The fewest nodes that make up the places from ``low`` to ``high``; node n of level k holds the places n 2^k up to the next's. None for no places."""
    found = []
    for k in range(top + 1):
        first, end = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high + 1, k)
        for odd, node in ((first, first), (end, end - 1)):
            found.append(F.when((first < end) & (odd % 2 == 1), F.struct(F.lit(k).alias("level"), node.alias("node"))))
    return F.explode(F.array_compact(F.array(*found)))


def _above(top: int) -> Column:
    """The nodes up to a level that hold the place ``_lo``."""
    return F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("_lo", k).alias("node")) for k in range(top + 1))))


def overlap_totals(
    left: DataFrame, right: DataFrame, *, left_ends: tuple[str, str], right_ends: tuple[str, str], totals: Mapping[str, tuple[str, str]], by: Sequence[str] = (), range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``left`` with totals over those right rows that ``overlap_join`` would pair it with, without making the pairs.

    ``totals`` gives for each new column its kind (count, sum, min or max) and the right
    column, ``*`` for rows. Without partners a count is 0, other totals are null.

    The ends of both sides are numbered in order, and a binary tree stands over the
    numbers. A right interval meets a left one if it starts inside it, or starts before
    it and reaches its start. For the first kind each right start is added to the nodes
    above it, and a left interval takes the few nodes that make it up; for the second
    the right intervals are added to the nodes that make them up, and a left start takes
    those above it. So work is rows times levels, about the logarithm of the longest
    interval's ends, however many pairs meet. Intermediate tables are kept.
    """
    if len({*left.columns, *totals}) < len(left.columns) + len(totals):
        raise ValueError("a total has the name of a column")
    keys, made = [f"_k{i}" for i in range(len(by))], [f"_t{j}" for j in range(len(totals))]
    again = [_TOTALS[kind][1](t).alias(t) for t, (kind, _) in zip(made, totals.values())]
    a, b = _ends(left, by, left_ends, {}), kept(_ends(right, by, right_ends, totals))
    values = reduce(DataFrame.union, (side.select(F.col(end).alias("_v")) for side in (a, b) for end in ("_s", "_e")))
    values = scanned(kept(values.distinct()), {"_i": row_number()}, order=["_v"], rows=range_rows)
    a, b = kept(_numbered(a, values)), kept(_numbered(b, values))

    def met(asking: DataFrame, giving: DataFrame, *place: str) -> DataFrame:
        nodes = giving.groupBy(*keys, "_node").agg(*again)
        return asking.join(nodes.hint("merge"), [*keys, "_node"]).groupBy(*keys, *place).agg(*again)

    top = _top(a, F.col("_lo"))
    starts = b.groupBy(*keys, "_lo").agg(*again).select(*keys, *made, _above(top).alias("_node"))
    inside = met(a.select(*keys, "_lo", "_hi", _cover(F.col("_lo"), F.col("_hi"), top).alias("_node")), starts, "_lo", "_hi")
    found = a.join(inside.hint("merge"), [*keys, "_lo", "_hi"], "left")
    if right_ends[0] != right_ends[1]:
        top = _top(b, F.col("_lo") + 1)
        reaching = b.select(*keys, *made, _cover(F.col("_lo") + 1, F.col("_hi"), top).alias("_node"))
        over = met(a.select(*keys, "_lo").distinct().select(*keys, "_lo", _above(top).alias("_node")), reaching, "_lo")
        found = found.join(over.select(*keys, "_lo", *(F.col(t).alias(f"_o{t}") for t in made)).hint("merge"), [*keys, "_lo"], "left")
        both = {"min": F.least, "max": F.greatest}
        found = found.withColumns({t: both[kind](t, f"_o{t}") if kind in both else F.coalesce(F.col(t) + F.col(f"_o{t}"), t, f"_o{t}") for t, (kind, _) in zip(made, totals.values())})
    same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{n}") for c, n in zip((*by, *left_ends), (*(f"k{i}" for i in range(len(by))), "s", "e"))))
    done = [(F.coalesce(t, F.lit(0)) if kind == "count" else F.col(t)).alias(name) for t, (name, (kind, _)) in zip(made, totals.items())]
    return left.join(found.select(*keys, "_s", "_e", *made), same, "left").select(*left.columns, *done)
