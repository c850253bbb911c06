"""Correlations, z-scores and principal components against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import matrix


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x[:, 1] += x[:, 0]
    df = pd.DataFrame(x, columns=list("abcd"))
    df["c"] = (df["c"] * 2).round()
    df.loc[rng.random(60) < 0.1, "b"] = np.nan
    df.insert(0, "id", range(60))
    return df


def to_spark(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "id bigint, a double, b double, c double, d double")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_equals_pandas(spark, data, method):
    want = data[list("abcd")].corr(method=method)
    got = matrix.correlation_matrix(to_spark(spark, data), features=list("abcd"), method=method).collect()
    assert len(got) == 10
    for r in got:
        assert r["corr"] == pytest.approx(want.loc[r.row, r.col], abs=1e-10)


def test_kendall(spark, data):
    got = {(r.row, r.col): r["corr"] for r in matrix.correlation_matrix(to_spark(spark, data), features=["a", "c"], method="kendall", key="id").collect()}
    a, c = data.a.values, data.c.values
    s = sum(np.sign(a[i] - a[j]) * np.sign(c[i] - c[j]) for i in range(60) for j in range(i))
    ta = sum(a[i] != a[j] for i in range(60) for j in range(i))
    tc = sum(c[i] != c[j] for i in range(60) for j in range(i))
    assert got["c", "a"] == pytest.approx(s / np.sqrt(ta * tc))


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    cells = {(r.row, r.col): r["corr"] for r in matrix.correlation_matrix(df).collect()}
    assert cells["b", "a"] is None
    with pytest.raises(ValueError):
        matrix.correlation_matrix(df, features=["a"])


def test_pca(spark, data):
    full = data.dropna()
    x = full[list("abcd")].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = matrix.pca(to_spark(spark, full), list("abcd"), 3, keep=["id"])
    np.testing.assert_allclose(got.explained_variance_ratio, (s**2 / (s**2).sum())[:3], atol=1e-10)
    emb = got.embedding.toPandas().sort_values("id")[["pc1", "pc2", "pc3"]].to_numpy()
    np.testing.assert_allclose(np.abs(emb), np.abs(z @ vt[:3].T), atol=1e-8)
    with pytest.raises(ValueError):
        matrix.pca(to_spark(spark, full), list("abcd"), 5)


def test_umap_is_optional(spark, data):
    with pytest.raises(ValueError):
        matrix.umap_embedding(to_spark(spark, data), ["a"], n_neighbors=1)
    try:
        import umap  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            matrix.umap_embedding(to_spark(spark, data), ["a", "b"])


def test_sample_is_stable(spark, data):
    df = to_spark(spark, data)
    first = {r.id for r in matrix.sample_rows(df, 10, "id").collect()}
    assert len(first) == 10 and first == {r.id for r in matrix.sample_rows(df, 10, "id").collect()}
    with pytest.raises(ValueError):
        matrix.sample_rows(df, 0, "id")


def tau(x, y):
    """Kendall's tau-b by all pairs."""
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    untied = (dx != 0).sum() * (dy != 0).sum()
    return (dx * dy).sum() / np.sqrt(float(untied)) if untied else None


@pytest.mark.parametrize("rows,cuts", [(500_000, 500), (50, 500), (7, 40), (1, 3)])
def test_kendall_whatever_the_ranges(spark, rows, cuts):
    rng = np.random.default_rng(rows)
    x = np.concatenate([rng.normal(size=250), np.full(200, 0.3), rng.integers(-3, 3, 150)])
    y = np.concatenate([x[:250] + rng.normal(size=250), rng.normal(size=200), rng.integers(0, 2, 150)])
    nulls = [(None, 1.0), (2.0, None), (None, None), (float("nan"), 3.0)]
    df = spark.createDataFrame([*((float(a), float(b)) for a, b in zip(x, y)), *nulls], "x double, y double")
    assert matrix.kendall_tau(df, "x", "y", range_rows=rows, most_cuts=cuts) == pytest.approx(tau(x, y), abs=1e-12)
    assert matrix.kendall_tau(df.withColumn("y", df.x * 0 + 1), "x", "y") is None and matrix.kendall_tau(df.limit(0), "x", "y") is None


def test_counting_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 60):
        x, y = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        assert matrix.inversions(y) == sum(y[i] > y[j] for j in range(n) for i in range(j))
        assert matrix.concordance(x, y) == sum(int(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for j in range(n) for i in range(j))
        cells = [(int(a), int(b), 10**15) for a, b in zip(x, y)]
        assert matrix._grid_concordance(cells) == 10**30 * matrix.concordance(x, y)


def test_spearman_ranks_whole_columns_once(spark, monkeypatch):
    calls = []
    plain = matrix.average_ranks
    monkeypatch.setattr(matrix, "average_ranks", lambda df, columns: calls.append(list(columns)) or plain(df, columns))
    df = spark.range(50).selectExpr("id % 7 as a", "id * id % 11 as b", "if(id % 5 = 0, null, id) as c", "1 as d")
    got = {(r.row, r.col): r["corr"] for r in matrix.correlation_matrix(df, method="spearman").collect()}
    assert sorted(map(len, calls)) == [2, 2, 2, 3]
    want = df.toPandas().astype(float).corr(method="spearman")
    assert all((c is None and np.isnan(want.loc[k])) or c == pytest.approx(want.loc[k], abs=1e-10) for k, c in got.items()) and len(got) == 10


def test_ranks_over_many_ranges_equal_pandas(spark):
    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.1 else float(rng.integers(-40, 40)) for _ in range(700)] + [7.0] * 300
    got = matrix.average_ranks(spark.createDataFrame(list(enumerate(values)), "id int, v double"), ["v"]).orderBy("id").toPandas()["v"]
    want = pd.Series(values, dtype="float64").rank()
    assert np.allclose(got, want, equal_nan=True)


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(3)
    n, d = 400, 500
    x = rng.normal(size=(n, 8)) @ rng.normal(size=(8, d)) + rng.normal(size=(n, d)) + 1e6
    x[:, 7] = 5.5
    names = [f"v{i}" for i in range(d)]
    whole = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(7)
    got = matrix.pca(whole, [c for c in names if c != "v7"], 2)
    z = np.delete(x, 7, 1)
    z = (z - z.mean(0)) / z.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(got.explained_variance_ratio, (s**2 / (s**2).sum())[:2], rtol=1e-9)
    np.testing.assert_allclose(np.sort(np.abs(got.embedding.toPandas()["pc1"])), np.sort(np.abs(z @ vt[0])), rtol=1e-6)
    holes = pd.DataFrame(np.where(rng.random((n, d)) < 0.2, np.nan, x), columns=names)
    holes["v9"] = np.nan
    want = holes.drop(columns="v7").corr()
    cells = matrix.correlation_matrix(spark.createDataFrame(holes.astype(object).where(holes.notna(), None), ", ".join(f"{c} double" for c in names)).repartition(5)).collect()
    assert len(cells) == d * (d + 1) // 2
    for r in cells:
        if "v7" in (r.row, r.col) or "v9" in (r.row, r.col):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.at[r.row, r.col], abs=1e-9)
