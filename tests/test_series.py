"""Series operators against pandas, on gaps, NULLs, constant windows and several assets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import regime, series


def prices(seed, asset="A", start="2010-01-01", end="2018-12-31", holes=True):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range(start, end)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0002, 0.01, len(days))))
    df = pd.DataFrame({"asset_id": asset, "date": days.date, "close": close})
    if holes:
        df.loc[rng.random(len(df)) < 0.02, "close"] = np.nan
        df = df[~((pd.to_datetime(df.date) >= "2013-05-01") & (pd.to_datetime(df.date) < "2013-06-01"))]
    return df


def frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "asset_id string, date date, close double")


def month_last(df, drop=True):
    df = df.dropna(subset=["close"]) if drop else df
    s = pd.Series(df.close.values, index=pd.to_datetime(df.date)).sort_index()
    return s.resample("ME").last()


def test_month_grid_is_dense_and_takes_last_value(spark):
    df = prices(1)
    got = series.month_end_last(frame(spark, df), by=["asset_id"]).toPandas().sort_values("month_end")
    want = month_last(df)
    assert list(pd.to_datetime(got.month_end)) == list(want.index)
    np.testing.assert_allclose(got.close.astype(float).values, want.values)
    assert got.close.isna().sum() == 1


def test_month_grid_of_nothing(spark):
    empty = spark.createDataFrame([], "asset_id string, date date, close double")
    assert series.month_end_last(empty, by=["asset_id"]).count() == 0
    with pytest.raises(ValueError, match="Missing required columns: close"):
        series.month_end_last(empty.drop("close"))


@pytest.mark.parametrize("lag", [0, 2])
def test_rolling_beta_equals_pandas(spark, lag):
    stock, bench = prices(2), prices(3, "B")
    s, b = np.log(month_last(stock)).diff(), np.log(month_last(bench)).diff().shift(lag)
    both = pd.concat([s, b], axis=1, join="inner")
    want = both[0].rolling(12).cov(both[1]) / both[1].rolling(12).var()
    got = series.rolling_beta(frame(spark, stock), frame(spark, bench), window=12, by=["asset_id"], benchmark_lag_months=lag).toPandas().sort_values("month_end")
    np.testing.assert_allclose(got.beta_12m.astype(float).values, want.values, atol=1e-10)


def test_beta_of_constructed_series(spark):
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2015-01-01", "2025-12-31")
    r = rng.normal(0.00015, 0.008, len(days))
    make = lambda x, a: frame(spark, pd.DataFrame({"asset_id": a, "date": days.date, "close": 100 * np.exp(np.cumsum(x))}))
    out = series.rolling_beta(make(1.5 * r + rng.normal(0, 0.003, len(days)), "S"), make(r, "B"), by=["asset_id"]).toPandas().sort_values("month_end")
    assert out.beta_36m.isna().sum() <= 37
    assert 1.2 <= out.beta_36m.tail(24).astype(float).mean() <= 1.8


@pytest.mark.parametrize(("window", "lag"), [(1, 0), (12, -1)])
def test_beta_refuses(spark, window, lag):
    df = frame(spark, prices(1))
    with pytest.raises(ValueError):
        series.rolling_beta(df, df, window=window, benchmark_lag_months=lag)


@pytest.mark.parametrize("transform", ["delta", "level"])
def test_rolling_correlation_equals_pandas(spark, transform):
    df = prices(4)
    rng = np.random.default_rng(5)
    months = pd.date_range("2010-01-31", "2018-12-31", freq="ME")
    rate = pd.Series(2 + np.cumsum(rng.normal(0, 0.08, len(months))), index=months)
    rate.iloc[[5, 6, 40]] = np.nan
    rate.iloc[60:80] = 1.0
    p, x = np.log(month_last(df, drop=False)).diff(), rate.ffill()
    x = (x.diff() if transform == "delta" else x).shift(1)
    both = pd.concat([p, x], axis=1, join="inner")
    want = both[0].rolling(12).corr(both[1])
    constant = both[1].rolling(12).var() < 1e-15
    want[constant] = np.nan
    policy = spark.createDataFrame([(d.date(), None if np.isnan(v) else float(v)) for d, v in rate.items()], "observation_date date, FEDFUNDS double")
    got = series.rolling_policy_correlation(frame(spark, df), policy, window=12, by=["asset_id"], transform=transform).toPandas().sort_values("month_end")
    np.testing.assert_allclose(got["corr"].astype(float).values[~constant.values], want.values[~constant.values], atol=1e-8)


def test_regime_labels(spark):
    df = spark.createDataFrame([(0.3,), (-0.3,), (0.2,), (None,), (float("nan"),)], "c double")
    assert [r[0] for r in df.select(regime.classify_regime(F.col("c"))).collect()] == ["positive", "negative", "neutral", "neutral", "neutral"]
    with pytest.raises(ValueError):
        regime.classify_regime(F.col("c"), -1, 1)


def regime_inputs(spark):
    labels = ["positive", "negative", "neutral", "positive", "positive", "negative", "neutral", "neutral"]
    days = pd.date_range("2020-01-31", periods=8, freq="ME").date
    returns = [0.01, -0.02, 0.03, None, 0.02, -0.01, 0.04, 0.01]
    r = spark.createDataFrame(list(zip(days, returns)), "month_end date, monthly_return double")
    return r, spark.createDataFrame(list(zip(days, labels)), "month_end date, regime string"), labels, returns


def test_filtered_backtest(spark):
    r, g, labels, returns = regime_inputs(spark)
    known = [(x, y) for x, y in zip(returns[1:], labels[:-1]) if x is not None]
    out = {x.strategy: x for x in regime.regime_filtered_backtest(r, g)["summary"].collect()}
    for name in regime.REGIMES:
        mine = np.array([x if y == name else 0.0 for x, y in known])
        assert out[name].total_return == pytest.approx(np.prod(1 + mine) - 1)
        assert out[name].months_invested == sum(y == name for _, y in known)
        assert out[name].volatility == pytest.approx(mine.std())
    assert sum(x.months_invested for x in out.values()) == len(known)


def test_weighted_backtest(spark):
    r, g, labels, returns = regime_inputs(spark)
    out = {x.strategy: x for x in regime.regime_weighted_backtest(r, g)["summary"].collect()}
    known = [(x, y) for x, y in zip(returns[1:], labels[:-1]) if x is not None]
    mine = np.array([x * (0.5 if y == "negative" else 1.0) for x, y in known])
    assert out["weighted_by_regime"].total_return == pytest.approx(np.prod(1 + mine) - 1)
    assert out["always_long"].months_invested == len(known)
    with pytest.raises(ValueError, match="neutral"):
        regime.regime_weighted_backtest(r, g, weights={"positive": 1, "negative": 1})
    with pytest.raises(ValueError):
        regime.regime_weighted_backtest(r, g, weights={"positive": 1, "negative": -1, "neutral": 1})


def test_empty_backtest_has_zero_return(spark):
    r, g, _, _ = regime_inputs(spark)
    out = regime.regime_filtered_backtest(r.limit(0), g)["summary"].collect()
    assert {(x.total_return, x.months_invested, x.mean_return) for x in out} == {(0.0, 0, None)}


def test_price_validation(spark):
    rows = [("A", None, "1.0"), ("A", "2024-01-02", None), ("A", "2024-01-03", "2.5")]
    good, bad = series.validate_prices(spark.createDataFrame(rows, "asset_id string, date string, close string"))
    assert bad == 2
    assert [(str(r.date), r.close) for r in good.collect()] == [("2024-01-03", 2.5)]


def test_valid_prices_runs_no_job(spark):
    df = spark.createDataFrame([("A", None, "1.0"), ("A", "2024-01-03", "x"), ("A", "2024-01-04", "2.5")], "asset_id string, date string, close string")
    spark.sparkContext.setJobGroup("no-job", "")
    good = series.valid_prices(df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("no-job")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0
    assert [(str(r.date), r.close) for r in good.collect()] == [("2024-01-04", 2.5)]
