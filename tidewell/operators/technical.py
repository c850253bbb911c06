"""RSI and the long-or-flat strategy on it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import no_nan
from tidewell.operators.scan import RANGE_ROWS, Ranges, filled, previous, row_number, running_max, running_product
from tidewell.schemas import require_columns


def _block_rows(period: int) -> int:
    """Rows over which ``(1 - 1/period)`` decays by e^300: its powers and their inverses stay far inside a double's range."""
    return max(period + 1, int(300 / math.log(period / (period - 1)))) if period > 1 else 4096


def _smoothed(bars: DataFrame, x: str, period: int, size: int, block: Window) -> DataFrame:
    """``bars`` with ``_m_<x>``: Wilder's mean of ``x`` inside the row's block, as if nothing came before it.

    Wilder's step is m -> a m + x / period with a = 1 - 1 / period, so a block's value
    is a sum of decayed terms: no row waits for the one before. The first mean, of
    ``period`` values, stands at row ``period`` of the series.
    """
    decay = 1 - 1 / period
    seed = F.avg(x).over(block.rowsBetween(-(period - 1), 0))
    bars = bars.withColumn("_term", F.when(F.col("_i") < period, 0.0).when(F.col("_i") == period, seed).otherwise(F.col(x) / period))
    if period == 1:
        return bars.withColumnRenamed("_term", f"_m_{x}")
    grown = F.sum(F.col("_term") * F.pow(F.lit(1 / decay), F.col("_at"))).over(block.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn(f"_m_{x}", grown * F.pow(F.lit(decay), F.col("_at"))).drop("_term")


def _carried(bars: DataFrame, names: Sequence[str], period: int, size: int) -> DataFrame:
    """``bars`` with what the blocks before add to each of ``names``.

    A block is the map m -> A m + B of what enters it: A is its decay, B its own last
    mean. The maps of the three blocks before are composed; A cubed, e^-900, is zero
    in double arithmetic, so those further back add nothing.
    """
    decay = 1 - 1 / period
    whole = decay**size
    ends = bars.groupBy("_key", "_block").agg(*(F.max_by(c, "_i").alias(f"_e{i}") for i, c in enumerate(names)))
    w = Window.partitionBy("_key").orderBy("_block")  # a row a block
    into = [sum((F.coalesce(F.lag(f"_e{i}", k).over(w), F.lit(0.0)) * whole ** (k - 1) for k in (1, 2, 3)), F.lit(0.0)).alias(f"_e{i}") for i in range(len(names))]
    into = ends.select("_key", "_block", *into).where("_block > 0")
    met = bars.join(into, ["_key", "_block"], "left")
    reach = F.pow(F.lit(decay), F.col("_at") + 1)
    return met.withColumns({c: F.col(c) + F.coalesce(F.col(f"_e{i}"), F.lit(0.0)) * reach for i, c in enumerate(names)}).drop(*(f"_e{i}" for i in range(len(names))))


def rsi(df: DataFrame, *, by: Sequence[str] = (), order: Sequence[str] = ("date",), close: str = "close", period: int = 14, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``rsi`` by Wilder's smoothing, as a scan of affine maps: one series spreads over many tasks.

    Rows are numbered by ranges of the series (see ``scan``), dealt out by blocks of
    some thousand rows, smoothed inside each, and given what earlier blocks carry in.
    NULL for the first ``period`` rows of a series, and for all of a shorter one.
    Rows with a NULL close are left out. ``order`` must be total within a series.
    """
    if period < 1:
        raise ValueError("period must be at least 1")
    require_columns(df, *by, *order, close)
    bars = df.where(F.col(close).isNotNull())
    ranges = Ranges(bars, by, order, range_rows)
    bars = ranges.scan(ranges.marked(bars), {"_n": row_number(), "_prev": previous(F.col(close).cast("double"))})
    size = _block_rows(period)
    change = F.col(close).cast("double") - F.col("_prev")
    bars = bars.withColumns({"_i": F.col("_n") - 1, "_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))})
    bars = bars.withColumns({"_block": F.floor(F.col("_i") / size), "_at": F.col("_i") % size})
    block = Window.partitionBy("_key", "_block").orderBy("_i")
    for x in ("_up", "_down"):
        bars = _smoothed(bars, x, period, size, block)
    if period > 1:
        bars = _carried(bars, ("_m__up", "_m__down"), period, size)
    up, down = F.col("_m__up"), F.col("_m__down")
    found = F.when(F.col("_i") >= period, F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down))))
    return bars.withColumn("rsi", found).select(*(c for c in df.columns if c != "rsi"), "rsi")


def rsi_signal(x: Column, oversold: float = 30.0, overbought: float = 70.0) -> Column:
    """buy at or below ``oversold``, sell at or above ``overbought``, else hold."""
    return F.when(x <= oversold, "buy").when(x >= overbought, "sell").otherwise("hold")


def _positions(df: DataFrame, ranges: Ranges, signal: str, strength: str | None, gate_threshold: float) -> DataFrame:
    gate = F.coalesce(no_nan(F.col(strength)) > gate_threshold, F.lit(False)) if strength else F.lit(False)
    effective = F.when((F.col(signal) == "buy") & ~gate, 1).when(F.col(signal) == "sell", 0)
    df = ranges.scan(df, {"_effective": previous(effective), "gated": previous((F.col(signal) == "buy") & gate)})
    df = ranges.scan(df.withColumn("gated", F.coalesce("gated", F.lit(False))), {"_held": filled(F.col("_effective"))})
    df = df.withColumn("position", F.coalesce("_held", F.lit(0))).drop("_effective", "_held")
    df = ranges.scan(df, {"_was": previous(F.col("position"))})
    return df.withColumn("entry", (F.col("position") == 1) & (F.coalesce("_was", F.lit(0)) == 0)).drop("_was")


def positions(df: DataFrame, *, by: Sequence[str] = (), order: str = "seq", signal: str = "signal", strength: str | None = None, gate_threshold: float = 0.2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``position`` (1 long, 0 flat), ``gated`` and ``entry``, from the bar before.

    A buy while the macro strength of its bar exceeds the threshold is gated and
    holds. No recursion: the position is the last effective signal.
    """
    ranges = Ranges(df, by, [order], range_rows)
    out = _positions(ranges.marked(df), ranges, signal, strength, gate_threshold)
    return out.select(*df.columns, "gated", "position", "entry")


def _equity(df: DataFrame, ranges: Ranges, close: str) -> DataFrame:
    df = ranges.scan(df, {"_was": previous(F.col(close))})
    df = df.withColumn("asset_return", F.coalesce(F.try_divide(F.col(close), F.col("_was")) - 1, F.lit(0.0))).drop("_was")
    df = df.withColumn("strategy_return", F.col("asset_return") * F.col("position"))
    return ranges.scan(df, {"equity": running_product(1 + F.col("strategy_return")), "buy_and_hold": running_product(1 + F.col("asset_return"))})


def equity_curves(df: DataFrame, *, by: Sequence[str] = (), order: str = "seq", close: str = "close", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with simple, strategy and buy-and-hold returns' running products, from 1.0."""
    ranges = Ranges(df, by, [order], range_rows)
    return _equity(ranges.marked(df), ranges, close).select(*df.columns, "asset_return", "strategy_return", "equity", "buy_and_hold")


def rsi_backtest(
    df: DataFrame, *, by: Sequence[str] = (), order: str = "seq", close: str = "close", period: int = 14, oversold: float = 30.0, overbought: float = 70.0, strength: str | None = None, gate_threshold: float = 0.2,
    range_rows: int = RANGE_ROWS,
) -> dict[str, DataFrame]:
    """Frames ``series`` (every bar) and ``metrics`` (one row per series)."""
    if gate_threshold < 0:
        raise ValueError("gate_threshold must be zero or more")
    bars = rsi(df, by=by, order=[order], close=close, period=period, range_rows=range_rows)
    ranges = Ranges(df.where(F.col(close).isNotNull()), by, [order], range_rows)
    bars = ranges.marked(bars.withColumn("signal", rsi_signal(F.col("rsi"), oversold, overbought)))
    bars = _equity(_positions(bars, ranges, "signal", strength, gate_threshold), ranges, close)
    bars = ranges.scan(bars, {"_peak": running_max(F.col("equity")), "_n": row_number()})
    bars = bars.withColumns({"drawdown": F.try_divide("equity", "_peak") - 1, "_first": F.col("_n") == 1}).drop("_peak", "_n")
    active = (F.col("position") == 1) & ~F.col("_first")
    # What is left in the end is kept beside the return, which from 1e-16 on is -1 whatever is left.
    metrics = bars.groupBy(*by).agg(
        (F.max_by("equity", order) - 1).alias("total_return"),
        (F.max_by("buy_and_hold", order) - 1).alias("buy_and_hold_return"),
        F.max_by("equity", order).alias("equity"),
        F.max_by("buy_and_hold", order).alias("buy_and_hold"),
        F.count_if("entry").cast("bigint").alias("trades"),
        F.coalesce(F.try_divide(F.count_if(active & (F.col("strategy_return") > 0)), F.count_if(active)), F.lit(0.0)).alias("hit_rate"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if("gated").cast("bigint").alias("gated_buys"),
        F.count("*").cast("bigint").alias("bars"),
    )
    return {"series": ranges.plain(bars.drop("_first")), "metrics": metrics.where("bars >= 2")}
