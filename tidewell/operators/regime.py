"""Macro regimes and the strategies that follow them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import label_map, no_nan
from tidewell.operators.series import log_return, ordered, rolling_policy_correlation
from tidewell.schemas import require_columns

REGIMES = ("positive", "negative", "neutral")
DEFAULT_WEIGHTS = {"positive": 1.0, "neutral": 1.0, "negative": 0.5}


def classify_regime(corr: Column, positive_threshold: float = 0.2, negative_threshold: float = -0.2) -> Column:
    """positive above, negative below the thresholds, else neutral; so is a missing value."""
    if negative_threshold >= positive_threshold:
        raise ValueError("negative_threshold must be less than positive_threshold")
    x = no_nan(corr)
    return F.when(x > positive_threshold, "positive").when(x < negative_threshold, "negative").otherwise("neutral")


def macro_features(prices: DataFrame, policy: DataFrame, *, positive_threshold: float = 0.2, negative_threshold: float = -0.2, **series) -> DataFrame:
    """Rolling correlation with its regime."""
    return rolling_policy_correlation(prices, policy, **series).withColumn("regime", classify_regime(F.col("corr"), positive_threshold, negative_threshold))


def model_input(prices: DataFrame, policy: DataFrame, *, by: Sequence[str] = (), asset_id: str | None = None, value: str = "close", strength: bool = True, **series) -> DataFrame:
    """``(by, month_end, spy_close, spy_log_ret_1m, corr, regime[, strength])``, one pass over the prices."""
    if asset_id is not None and "asset_id" in prices.columns:
        prices = prices.where(F.col("asset_id") == asset_id)
        if prices.isEmpty():
            raise ValueError(f"No price rows for asset_id={asset_id}")
    found = macro_features(prices, policy, by=by, value=value, **series)
    out = found.select(*by, "month_end", F.col(value).alias("spy_close"), F.col("log_return").alias("spy_log_ret_1m"), "corr", "regime")
    return out.withColumn("strength", F.abs("corr")) if strength else out


def current_regime(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The regime of the last month of each series."""
    return frame.groupBy(*by).agg(F.max_by("regime", F.when(F.col("regime").isNotNull(), F.col("month_end"))).alias("regime"))


def align_regime(returns: DataFrame, regimes: DataFrame, *, by: Sequence[str] = (), date: str = "month_end", ret: str = "monthly_return", regime: str = "regime", lag: int = 1) -> DataFrame:
    """Returns with the regime known ``lag`` rows before, on the regimes' own dates."""
    require_columns(returns, *by, date, ret)
    require_columns(regimes, *by, date, regime)
    if lag < 0:
        raise ValueError("lag must be zero or more")
    known = regimes.select(*by, date, F.lag(regime, lag).over(ordered(by, date)).alias("regime")).where("regime is not null")
    return returns.where(F.col(ret).isNotNull()).select(*by, date, F.col(ret).alias("ret")).join(known, [*by, date])


def _summary(strategy_return: Column, invested: Column) -> list[Column]:
    return [
        (F.coalesce(F.product(1 + strategy_return), F.lit(1.0)) - 1).alias("total_return"),
        F.count_if(invested).cast("bigint").alias("months_invested"),
        F.avg(strategy_return).alias("mean_return"),
        F.stddev_pop(strategy_return).alias("volatility"),
    ]


def regime_filtered_backtest(returns: DataFrame, regimes: DataFrame, *, by: Sequence[str] = (), **columns) -> dict[str, DataFrame]:
    """For each regime: invested in its months only. Frames ``summary`` and ``strategy_returns``."""
    aligned = align_regime(returns, regimes, by=by, **columns)
    each = aligned.withColumn("strategy", F.explode(F.array(*map(F.lit, REGIMES))))
    each = each.withColumn("invested", F.col("regime") == F.col("strategy")).withColumn("strategy_return", F.when(F.col("invested"), F.col("ret")).otherwise(0.0))
    names = returns.sparkSession.createDataFrame([(r,) for r in REGIMES], "strategy string")
    summary = each.groupBy(*by, "strategy").agg(*_summary(F.col("strategy_return"), F.col("invested")))
    if not by:
        summary = names.join(summary, "strategy", "left").withColumns({"total_return": F.coalesce("total_return", F.lit(0.0)), "months_invested": F.coalesce("months_invested", F.lit(0))})
    return {"summary": summary, "strategy_returns": each, "aligned_input": aligned}


def regime_weighted_backtest(returns: DataFrame, regimes: DataFrame, *, weights: Mapping[str, float] | None = None, by: Sequence[str] = (), **columns) -> dict[str, DataFrame]:
    """Returns weighted by regime against always long. Frames ``summary`` and ``strategy_returns``."""
    weights = dict(DEFAULT_WEIGHTS if weights is None else weights)
    missing = [r for r in REGIMES if r not in weights]
    if missing:
        raise ValueError(f"Missing regime weights: {', '.join(missing)}")
    if any(w < 0 for w in weights.values()):
        raise ValueError("Regime weights must be zero or more")
    aligned = align_regime(returns, regimes, by=by, **columns).withColumn("weight", label_map(F.col("regime"), weights))
    both = F.array(
        F.struct(F.lit("weighted_by_regime").alias("strategy"), (F.col("ret") * F.col("weight")).alias("strategy_return"), F.coalesce(F.col("weight") > 0, F.lit(False)).alias("invested")),
        F.struct(F.lit("always_long").alias("strategy"), F.col("ret").alias("strategy_return"), F.lit(True).alias("invested")),
    )
    each = aligned.select("*", F.inline(both))
    summary = each.groupBy(*by, "strategy").agg(*_summary(F.col("strategy_return"), F.col("invested")))
    return {"summary": summary, "strategy_returns": each, "aligned_input": aligned}


def monthly_returns(monthly: DataFrame, *, by: Sequence[str] = (), value: str = "close") -> DataFrame:
    """``(by, month_end, monthly_return)`` as log returns of a month grid."""
    return monthly.select(*by, "month_end", log_return(value, ordered(by)).alias("monthly_return"))
