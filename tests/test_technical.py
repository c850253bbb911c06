"""RSI and its strategy against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import scan, technical
from tidewell.sources.store import asof_join


def wilder(close, period):
    """Wilder's RSI of one ordered series by a plain loop; NaN for its first ``period`` values."""
    out = np.full(len(close), np.nan)
    if len(close) <= period:
        return out
    change = np.diff(close)
    gain, loss = np.maximum(change, 0.0), np.maximum(-change, 0.0)
    up, down = gain[:period].mean(), loss[:period].mean()
    for i in range(period, len(close)):
        if i > period:
            up = (up * (period - 1) + gain[i - 1]) / period
            down = (down * (period - 1) + loss[i - 1]) / period
        out[i] = 100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down)
    return out


def bars(spark, series):
    return spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k int, seq int, close double")


def rsi_of(df, k):
    return df[df.k.isna() if k is None else df.k == k].sort_values("seq").rsi.astype(float)


def test_rsi_bounds_and_warm_up(spark):
    series = {1: [100, 101, 102, 101, 103, 104, 103, 105, 106, 105, 107, 108, 107, 109, 109.5], 2: np.full(20, 5.0), 3: np.arange(14.0)}
    got = technical.rsi(bars(spark, series), by=["k"], order=["seq"]).toPandas()
    one = rsi_of(got, 1).to_numpy()
    assert np.isnan(one[:14]).all() and 0 <= one[14] <= 100
    assert rsi_of(got, 2).iloc[-1] == 100 and rsi_of(got, 3).isna().all()


@pytest.mark.parametrize("period,rows", [(14, 2_000_000), (14, 100), (1, 50), (2, 100), (5, 300)])
def test_rsi_of_many_series(spark, period, rows):
    """Also of series cut into ranges and of several blocks; a null key is a series."""
    rng = np.random.default_rng(1)
    series = {k: 100 + np.cumsum(rng.normal(0, 1, 40)) for k in (0, 1, 2, None)}
    series |= {4: 100 + np.cumsum(rng.normal(0, 1, 900)), 5: np.concatenate([np.arange(400.0), np.arange(400.0)[::-1]]), 9: [1.0]}
    df = bars(spark, series).union(spark.createDataFrame([(4, 10_000, None)], "k int, seq int, close double"))
    got = technical.rsi(df, by=["k"], order=["seq"], period=period, range_rows=rows).toPandas()
    assert len(got) == sum(map(len, series.values()))
    for k, v in series.items():
        np.testing.assert_allclose(rsi_of(got, k), wilder(np.asarray(v), period), rtol=1e-9)


def test_rsi_of_one_long_series(spark):
    """A million bars without a key, cut into ranges and blocks, without Python workers."""
    n = 1_000_000
    df = spark.range(n).select("id", (F.rand(3) + F.sin(F.col("id") / 1e5) * 100 + F.when(F.col("id").between(300_000, 340_000), F.col("id")).otherwise(0)).alias("close"))
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/long-series")
    df = spark.read.parquet(path)
    out = technical.rsi(df, order=["id"], range_rows=100_000)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values("id")
    np.testing.assert_allclose(got.rsi.astype(float), wilder(got.close.to_numpy(), 14), rtol=1e-9)


def test_scans_equal_windows_whatever_the_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(None if k == 3 else k, int(i // 3), int(i), None if rng.random() < 0.4 else float(rng.normal(1, 0.2))) for k in range(4) for i in range([5, 400, 90, 200][k])]
    df = spark.createDataFrame(rows, "k int, t int, u int, x double")
    x = F.col("x")
    made = {"fill": scan.filled(x), "prev": scan.previous(x), "n": scan.row_number(), "top": scan.running_max(x), "prod": scan.running_product(x)}
    want = sorted(map(str, scan.scanned(df, made, by=["k"], order=["t", "u"]).withColumn("prod", F.round("prod", 9)).collect()))
    for size in (1, 7, 64, 199):
        cut = scan.Ranges(df, ["k"], ["t", "u"], size)
        assert cut.cuts is not None and cut.marked(df).agg(F.max("_range")).first()[0] >= 400 // size // 4
        got = scan.scanned(df, made, by=["k"], order=["t", "u"], rows=size).withColumn("prod", F.round("prod", 9)).collect()
        assert sorted(map(str, got)) == want
    w = scan.Window.partitionBy("k").orderBy("t", "u")
    plain = df.select("*", F.last("x", True).over(w).alias("fill"), F.lag("x").over(w).alias("prev"), F.row_number().over(w).cast("bigint").alias("n"), F.max("x").over(w).alias("top"), F.round(F.product("x").over(w), 9).alias("prod"))
    assert sorted(map(str, plain.collect())) == want


def test_backtest_and_asof_join_on_cut_series(spark):
    rng = np.random.default_rng(2)
    df = bars(spark, {k: 100 + np.cumsum(rng.normal(0, 1, n)) for k, n in ((1, 500), (2, 30))}).withColumn("strength", (F.col("seq") % 5) / 10)
    runs = [technical.rsi_backtest(df, by=["k"], oversold=45, overbought=55, strength="strength", range_rows=r) for r in (10**6, 40)]
    for part in ("series", "metrics"):
        a, b = (r[part].toPandas().sort_values(["k", "seq"] if part == "series" else ["k"]).reset_index(drop=True) for r in runs)
        for c in a.columns:
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True) if c != "signal" else (a[c] == b[c]).all()
    left, right = df.select("k", F.col("seq").alias("at"), F.col("close").alias("id")), df.where("seq % 7 = 3").select("k", F.col("seq").alias("at"), F.col("close").alias("v"))
    one, two = (sorted(map(str, asof_join(left, right, by=["k"], on="at", values=["v"], range_rows=r).collect())) for r in (10**6, 25))
    assert one == two and len(one) == 530


def test_signal(spark):
    df = spark.createDataFrame([(None,), (20.0,), (50.0,), (80.0,), (30.0,)], "x double")
    assert [r[0] for r in df.select(technical.rsi_signal(F.col("x"))).collect()] == ["hold", "buy", "hold", "sell", "buy"]


def test_position_state_machine(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, str(rng.choice(["buy", "sell", "hold"])), None if rng.random() < 0.2 else float(rng.random() / 2)) for k in range(20) for i in range(30)]
    got = technical.positions(spark.createDataFrame(rows, "k int, seq int, signal string, strength double"), by=["k"], strength="strength").toPandas()
    for k in range(20):
        held, want = 0, []
        mine = [r for r in rows if r[0] == k]
        for i in range(30):
            if i:
                _, _, signal, strength = mine[i - 1]
                gate = strength is not None and strength > 0.2
                held = 1 if signal == "buy" and not gate else 0 if signal == "sell" else held
            want.append(held)
        assert got[got.k == k].sort_values("seq").position.tolist() == want


def test_backtest_metrics(spark):
    closes = [100, 90, 80, 85, 95, 100, 110, 90, 95, 97.0]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(closes)] + [(2, 0, 5.0)], "k int, seq int, close double")
    out = technical.rsi_backtest(df, by=["k"], period=2, oversold=40, overbought=60)
    m = out["metrics"].collect()
    assert [r.k for r in m] == [1]
    bars = out["series"].where("k = 1").orderBy("seq").collect()
    equity, peak, worst = 1.0, 1.0, 0.0
    for a, b, bar in zip([None, *closes], closes, bars):
        if a:
            equity *= 1 + (b / a - 1) * bar.position
        peak = max(peak, equity)
        worst = min(worst, equity / peak - 1)
    assert m[0].total_return == pytest.approx(equity - 1)
    assert m[0].max_drawdown == pytest.approx(worst)
    assert m[0].buy_and_hold_return == pytest.approx(closes[-1] / closes[0] - 1)
    with pytest.raises(ValueError):
        technical.rsi_backtest(df, by=["k"], gate_threshold=-1)
