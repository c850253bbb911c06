"""Time-series operators: one plan for any number of series, keyed by ``by``.

A series is rows of (keys, date, value). Every window is partitioned by the keys,
so series spread over the cluster; ties on a date are settled by ``tie`` columns.
Missing values are NULL throughout, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidewell.functions.scalars import no_nan, to_date, to_double
from tidewell.schemas import require_columns


def ordered(by: Sequence[str], order: str = "month_end") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def month_end_last(df: DataFrame, *, by: Sequence[str] = (), date: str = "date", value: str = "close", tie: Sequence[str] = (), drop_null_values: bool = True) -> DataFrame:
    """``(by, month_end, value)``: the last non-null value of each month on a dense month grid.

    Rows without a date are left out. With ``drop_null_values`` the grid spans the
    months that have values, otherwise all months that have rows.
    """
    require_columns(df, *by, date, value, *tie)
    rows = df.select(*by, to_date(F.col(date)).alias("_d"), F.col(date).alias("_at"), to_double(F.col(value)).alias("_v"), *(F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie))).where("_d is not null")
    if drop_null_values:
        rows = rows.where("_v is not null")
    order = F.struct("_at", *(f"_tie{i}" for i in range(len(tie))))
    monthly = rows.groupBy(*by, F.last_day("_d").alias("month_end")).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), order)).alias(value))
    months = F.sequence(F.trunc(F.min("month_end"), "MM"), F.trunc(F.max("month_end"), "MM"), F.expr("interval 1 month"))
    grid = monthly.groupBy(*by).agg(months.alias("_m")).where("_m is not null").select(*by, F.explode("_m").alias("_m")).select(*by, F.last_day("_m").alias("month_end"))
    return _null_safe_join(grid, monthly, [*by, "month_end"], "left").select(*by, "month_end", value)


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return left.join(renamed, condition, how).drop(*(f"_r_{c}" for c in on))


def difference(x: str, w: WindowSpec) -> Column:
    return F.col(x) - F.lag(x).over(w)


def log_return(x: str, w: WindowSpec) -> Column:
    """ln(x) less that of the row before; NULL at a gap or a value of zero or less."""
    return F.ln(x) - F.lag(F.ln(x)).over(w)


def simple_return(x: str, w: WindowSpec) -> Column:
    return F.try_divide(F.col(x), F.lag(x).over(w)) - 1


def shifted(x: str, k: int, w: WindowSpec) -> Column:
    if k < 0:
        raise ValueError("shift must be zero or more")
    return F.lag(x, k).over(w)


def forward_fill(x: str, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _gated(pair: Column, value: Column, window: int, w: WindowSpec) -> Column:
    """``value`` where the frame has ``window`` complete rows."""
    return F.when(F.count(pair).over(w.rowsBetween(-(window - 1), 0)) == window, value)


def rolling_beta(
    stock: DataFrame, benchmark: DataFrame, *, window: int = 36, by: Sequence[str] = (), date: str = "date", value: str = "close",
    benchmark_date: str = "date", benchmark_value: str = "close", benchmark_lag_months: int = 0, tie: Sequence[str] = (), benchmark_tie: Sequence[str] = (),
) -> DataFrame:
    """``(by, month_end, stock_return, benchmark_return, beta_<window>m)`` from monthly log returns.

    One benchmark serves all series. Beta is sample covariance by variance over
    ``window`` complete months, NULL before that and where the variance is zero.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    if benchmark_lag_months < 0:
        raise ValueError("benchmark_lag_months must be zero or more")
    s = month_end_last(stock, by=by, date=date, value=value, tie=tie)
    s = s.select(*by, "month_end", log_return(value, ordered(by)).alias("stock_return"))
    b = month_end_last(benchmark, date=benchmark_date, value=benchmark_value, tie=benchmark_tie)
    b = b.select("month_end", log_return(benchmark_value, ordered(())).alias("r"))
    b = b.select("month_end", shifted("r", benchmark_lag_months, ordered(())).alias("benchmark_return"))
    joined = s.join(b, "month_end")
    w = ordered(by)
    frame = w.rowsBetween(-(window - 1), 0)
    pair = F.when(F.col("stock_return").isNotNull() & F.col("benchmark_return").isNotNull(), 1)
    cov, var = F.covar_samp("stock_return", "benchmark_return").over(frame), F.var_samp("benchmark_return").over(frame)
    return joined.select(*by, "month_end", "stock_return", "benchmark_return", _gated(pair, F.try_divide(cov, var), window, w).alias(f"beta_{window}m"))


def rolling_policy_correlation(
    prices: DataFrame, policy: DataFrame, *, window: int = 36, by: Sequence[str] = (), policy_lag_months: int = 1, transform: str = "delta", date: str = "date", value: str = "close",
    policy_date: str = "observation_date", policy_value: str = "FEDFUNDS", tie: Sequence[str] = (), policy_tie: Sequence[str] = (),
) -> DataFrame:
    """``(by, month_end, <value>, log_return, policy, corr)``: monthly returns against the lagged policy rate.

    The policy rate is filled forward over months without one; ``transform`` delta
    takes its monthly change, anything else its level. Correlation needs ``window``
    complete months; zero variance gives NULL.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    if policy_lag_months < 0:
        raise ValueError("policy_lag_months must be zero or more")
    p = month_end_last(prices, by=by, date=date, value=value, tie=tie, drop_null_values=False)
    p = p.select(*by, "month_end", value, log_return(value, ordered(by)).alias("log_return"))
    f = month_end_last(policy, date=policy_date, value=policy_value, tie=policy_tie, drop_null_values=False)
    alone = ordered(())
    f = f.select("month_end", forward_fill(policy_value, alone).alias("x"))
    if transform == "delta":
        f = f.select("month_end", difference("x", alone).alias("x"))
    f = f.select("month_end", shifted("x", policy_lag_months, alone).alias("policy"))
    joined = p.join(f, "month_end").withColumn("_pair", F.when(F.col("log_return").isNotNull() & F.col("policy").isNotNull(), 1))
    joined = joined.withColumns({"_x": F.when(F.col("_pair") == 1, F.col("log_return")), "_y": F.when(F.col("_pair") == 1, F.col("policy"))})
    w = ordered(by)
    frame = w.rowsBetween(-(window - 1), 0)
    spread = F.sqrt(F.var_samp("_x").over(frame) * F.var_samp("_y").over(frame))
    corr = F.try_divide(F.covar_samp("_x", "_y").over(frame), spread)
    return joined.select(*by, "month_end", value, "log_return", "policy", _gated(F.col("_pair"), no_nan(corr), window, w).alias("corr"))


def drawdown(equity: str, w: WindowSpec) -> Column:
    """Loss since the highest equity so far, zero or below."""
    return F.try_divide(F.col(equity), F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1


def _coerced_prices(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with its numbers and dates coerced, and whether a row has a date and a close."""
    require_columns(df, "asset_id", "date", "close")
    numbers = {c: to_double(F.col(c)) for c in ("open", "high", "low", "close") if c in df.columns}
    if "volume" in df.columns:
        numbers["volume"] = F.col("volume").try_cast("double").cast("bigint")
    return df.withColumns({"date": to_date(F.col("date")), **numbers}), F.col("date").isNotNull() & F.col("close").isNotNull()


def valid_prices(df: DataFrame) -> DataFrame:
    """Rows with a date and a close, numbers coerced. Runs no job."""
    coerced, good = _coerced_prices(df)
    return coerced.where(good)


def validate_prices(df: DataFrame) -> tuple[DataFrame, int]:
    """``valid_prices(df)`` and the number of rows that it leaves out, which one job counts."""
    coerced, good = _coerced_prices(df)
    bad = coerced.agg(F.count_if(~good)).first()[0]
    return coerced.where(good), int(bad)
