"""Numeric frames: correlation matrices, z-scores, principal components, samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import no_nan


#: Ranges that ranks are counted in.
RANGES = 64
#: Kendall's grid: rows of a range, about, and most cuts of a column, which bound its cells.
KENDALL_ROWS, KENDALL_CUTS = 500_000, 500

#: From more columns than this, moments come from products of blocks of rows instead of one expression a pair.
GRAM_COLUMNS = 40


def numeric_columns(df: DataFrame, features: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """The chosen columns less the excluded; by default all numeric ones."""
    chosen = list(features) if features is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in chosen if c not in exclude]


def numeric_frame(df: DataFrame, dropna: bool = True) -> DataFrame:
    out = df.select(*numeric_columns(df))
    return out.dropna() if dropna else out


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by md5 of seed and ``key``: the same ones in every run."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over the rows that have both; NULL where a variance is zero."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return no_nan(F.try_divide(F.covar_samp(a, b), F.sqrt(F.var_samp(a) * F.var_samp(b))))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by their ranks, ties averaged, NULL kept.

    Counts by value are cut into RANGES ranges at approximate quantiles; a range is
    ranked by itself, and what the ranges before hold is added from a table of one
    row a range. How even the ranges are changes nothing in the ranks.
    """
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
        cuts = sorted(set(counts.select(F.col("_v").cast("double").alias("v")).approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.01)))
        part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("_v").cast("double"))) if cuts else F.lit(0)
        counts = counts.withColumn("_part", part)
        held = counts.groupBy("_part").agg(F.sum("_n").alias("_held")).select(F.col("_part").alias("_p"), F.expr("sum(_held) over (order by _part) - _held").alias("_before"))
        placed = counts.join(F.broadcast(held), F.col("_part") == F.col("_p"))
        ranked = placed.select("_v", F.expr("_before + sum(_n) over (partition by _part order by _v) - (_n - 1) / 2").alias("_rank"))
        df = df.join(ranked, df[c] == ranked["_v"], "left").drop("_v").withColumn(c, F.col("_rank").cast("double")).drop("_rank")
    return df


def _unpivot(df: DataFrame, pairs: list[tuple[str, str]], values: list[Column]) -> DataFrame:
    wide = df.agg(*(v.alias(f"c{i}") for i, v in enumerate(values)))
    rows = F.array(*(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.inline(rows))


@dataclass
class Moments:
    """For columns i and j over the rows that have both: their number, the sums of i and of i squared, and of i times j."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    p: np.ndarray

    def covariance(self) -> np.ndarray:
        """Of the population, pair by pair."""
        with np.errstate(all="ignore"):
            return np.where(self.n > 0, (self.p - self.s * self.s.T / self.n) / self.n, 0.0)

    def correlation(self) -> np.ndarray:
        """NaN where a column doesn't vary over the rows of the pair."""
        with np.errstate(all="ignore"):
            var = self.q - self.s**2 / self.n
            var[var <= 1e-12 * self.q] = np.nan  # what rounding leaves of a constant
            return (self.p - self.s * self.s.T / self.n) / np.sqrt(var) / np.sqrt(var.T)


def _partial_moments(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's moments: a row for each column i, its four rows of the matrices end to end."""
    d = len(centre)
    sums = np.zeros((d, 4, d))
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - centre
        has = ~np.isnan(x)
        x[~has] = 0.0
        mask = has.astype(np.float64)
        for k, (a, b) in enumerate(((mask, mask), (x, mask), (x * x, mask), (x, x))):
            sums[:, k] += a.T @ b
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, TaskContext.get().partitionId(), np.int32)), pa.array(list(sums.reshape(d, -1)), pa.list_(pa.float64()))], ["i", "part", "v"])


def _added_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    part = 0
    for batch in batches:
        part = batch.column(1)[0].as_py() if batch.num_rows else part
        for i, v in zip(batch.column(0).to_pylist(), batch.column(2)):
            sums[i] = sums.get(i, 0) + v.values.to_numpy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "part", "v"])


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Pairwise moments of any number of columns, from their means on.

    Each task multiplies blocks of rows and gives ``4 d²`` sums; these are added in two
    levels, by groups of tasks and then for all, a row a column. The result, ``4 d²``
    numbers, comes to the driver.
    """
    numbers = df.select(*(no_nan(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    means = numbers.agg(*(F.avg(c).alias(c) for c in numbers.columns)).first()
    centre = np.array([m or 0.0 for m in means])
    schema = "i int, part int, v array<double>"
    found = numbers.mapInArrow(lambda it: _partial_moments(it, centre), schema)
    fold = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(fold, F.col("part") % fold).mapInArrow(_added_moments, schema)
    found = found.repartition(fold, "i").mapInArrow(_added_moments, schema)
    d = len(columns)
    sums = np.zeros((d, 4, d))
    for r in found.select("i", "v").toLocalIterator():
        sums[r["i"]] = np.array(r["v"]).reshape(4, d)
    return Moments(*(sums[:, k] for k in range(4)))


def _added(terms: Sequence[Column]) -> Column:
    """The sum of many terms as a tree whose depth grows with the logarithm of their number."""
    if len(terms) <= 1:
        return terms[0] if terms else F.lit(0.0)
    return _added(terms[: len(terms) // 2]) + _added(terms[len(terms) // 2 :])


def _spearman(df: DataFrame, columns: Sequence[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Columns without nulls are ranked once for all pairs; a pair with nulls is ranked over the rows that have both."""
    holes = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    whole = [c for c in columns if not holes[c]]
    shared = [(a, b) for a, b in pairs if a in whole and b in whole]
    out = None
    if shared:
        out = _unpivot(average_ranks(df.select(*whole), whole), shared, [safe_corr(F.col(a), F.col(b)) for a, b in shared])
    for a, b in pairs:
        if (a, b) in shared:
            continue
        if a == b:  # one, unless the column doesn't vary
            one = df.agg(F.when(F.min(a) < F.max(a), F.lit(1.0)).alias("corr"))
        else:
            ranked = average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"])
            one = ranked.agg(safe_corr(F.col("a"), F.col("b")).alias("corr"))
        one = one.select(F.lit(a).alias("row"), F.lit(b).alias("col"), "corr")
        out = one if out is None else out.union(one)
    return out


def inversions(values: np.ndarray) -> int:
    """Pairs of which the first is larger than a later one, by halving the value range: each bit sorts stably and counts ones before zeros."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1) if len(rank) else ():
        group, one = rank >> (bit + 1), (rank >> bit) & 1
        ones = np.cumsum(one)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        base = np.repeat(ones[starts] - one[starts], np.diff(np.append(starts, len(rank))))
        total += int((ones - base)[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return total


def _tied(*sorted_columns: np.ndarray) -> int:
    """Pairs of rows that agree in all columns; equal rows stand together."""
    new = np.zeros(len(sorted_columns[0]), bool)
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    sizes = np.diff(np.append(np.flatnonzero(new), len(new))).astype(object)
    return int((sizes * (sizes - 1) // 2).sum()) if len(sizes) else 0


def concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Concordant less discordant pairs of rows."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    distinct = n * (n - 1) // 2 - _tied(x) - _tied(np.sort(y)) + _tied(x, y)
    return distinct - 2 * inversions(y)


def _grid_concordance(cells: list[tuple[int, int, int]]) -> int:
    """The same between rows of cells ``(x, y, rows)`` that differ in both, exactly: integers of any size."""
    if not cells:
        return 0
    xs, ys = (sorted({c[k] for c in cells}) for k in (0, 1))
    grid = np.zeros((len(xs), len(ys)), object)
    at = ({v: i for i, v in enumerate(xs)}, {v: i for i, v in enumerate(ys)})
    for x, y, n in cells:
        grid[at[0][x], at[1][y]] += n
    total, seen = 0, np.zeros(len(ys), object)  # rows of smaller x, by y
    for row in grid:
        below = np.cumsum(seen) - seen
        total += int((row * (below - (seen.sum() - below - seen))).sum())
        seen = seen + row
    return total


def _parts(df: DataFrame, column: str, cuts: list[float]) -> Column:
    """The number of a value's range. A cut is a range of its own, so a value that very many rows have stands alone."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*map(F.lit, cuts))
    return F.size(F.filter(listed, lambda c: c < F.col(column))) * 2 + F.array_contains(listed, F.col(column)).cast("int")


def kendall_tau(df: DataFrame, x: str, y: str, *, range_rows: int = KENDALL_ROWS, most_cuts: int = KENDALL_CUTS) -> float | None:
    """Kendall's tau-b over the rows that have both values; None where a column doesn't vary.

    Both columns are cut at quantiles. Pairs of rows in different ranges of both are
    told by the ranges: they are counted from the grid of rows by ranges, a table of
    ``(2 most_cuts + 1)²`` cells at most, with sums over smaller ones. Pairs in one range
    of x are counted inside it, by a sort and a count of inversions, pairs in one range
    of y but different ones of x likewise. A range of one value has no pair to count and
    is left out, so only ranges of about ``range_rows`` rows come together in a task.
    """
    rows = df.select(no_nan(F.col(x).cast("double")).alias("x"), no_nan(F.col(y).cast("double")).alias("y")).where("x is not null and y is not null")
    n = rows.count()
    parts = min(most_cuts, max(2, -(-n // range_rows)))
    found = rows.approxQuantile(["x", "y"], [i / parts for i in range(1, parts)], 0.1 / parts) if n else [[], []]
    cuts = [sorted(set(c)) for c in found]
    marked = rows.select("x", "y", _parts(rows, "x", cuts[0]).alias("px"), _parts(rows, "y", cuts[1]).alias("py"))
    ties = {c: rows.groupBy(c).agg(F.count("*").cast("decimal(38,0)").alias("t")).agg(F.coalesce(F.sum(F.expr("t * (t - 1) / 2")), F.lit(0)).cast("decimal(38,0)").alias("n")).first()["n"] for c in ("x", "y")}
    total = _grid_concordance([tuple(r) for r in marked.groupBy("px", "py").agg(F.count("*").alias("n")).collect()])

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [str(concordance(batch["u"].to_numpy(), batch["v"].to_numpy()))]})

    # A cut's own range (odd) holds one value: its pairs tie in that column.
    within = marked.where("px % 2 = 0").select("px", F.col("x").alias("u"), F.col("y").alias("v")).groupBy("px").applyInPandas(one, "s string")
    across = marked.where("py % 2 = 0").select("py", F.col("px").cast("double").alias("u"), F.col("y").alias("v")).groupBy("py").applyInPandas(one, "s string")
    total += sum(int(r["s"]) for r in within.union(across).collect())  # a row a range
    pairs = n * (n - 1) // 2
    untied = [pairs - int(ties[c]) for c in ("x", "y")]
    return total / (math.sqrt(untied[0]) * math.sqrt(untied[1])) if all(untied) else None


def correlation_matrix(df: DataFrame, *, features: Sequence[str] | None = None, exclude: Sequence[str] = (), method: str = "pearson", key: str | None = None) -> DataFrame:
    """``(row, col, corr)`` for the lower triangle and the diagonal, pairwise complete.

    ``spearman`` ranks columns without nulls once; ``kendall`` is tau-b by inversion
    counting (``kendall_tau``), whose figures come from jobs run here. ``key`` is not
    needed any more.
    """
    columns = numeric_columns(df, features, exclude)
    if len(columns) < 2:
        raise ValueError("at least two numeric features are needed")
    pairs = [(columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1)]
    if method == "pearson" and len(columns) > GRAM_COLUMNS:
        found = moments(df, columns).correlation()
        cells = [(columns[i], columns[j], None if np.isnan(found[i, j]) else float(found[i, j])) for i in range(len(columns)) for j in range(i + 1)]
        return df.sparkSession.createDataFrame(cells, "row string, col string, corr double")
    if method == "pearson":
        return _unpivot(df, pairs, [safe_corr(F.col(a), F.col(b)) for a, b in pairs])
    if method == "spearman":
        return _spearman(df, columns, pairs)
    if method != "kendall":
        raise ValueError(f"unknown method {method}")
    varies = df.agg(*(F.coalesce(F.min(no_nan(F.col(c).cast("double"))) < F.max(no_nan(F.col(c).cast("double"))), F.lit(False)).alias(c) for c in columns)).first()
    found = [(a, b, (1.0 if varies[a] else None) if a == b else kendall_tau(df, a, b)) for a, b in pairs]
    return df.sparkSession.createDataFrame(found, "row string, col string, corr double")


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, by their population deviation, or by one where that is zero."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).drop(*stats.columns)


@dataclass
class Pca:
    embedding: DataFrame
    components: np.ndarray
    explained_variance_ratio: np.ndarray


def pca(df: DataFrame, columns: Sequence[str], n_components: int, keep: Sequence[str] = ()) -> Pca:
    """Principal components of z-scored columns; each component's largest loading is positive.

    The covariance of the scaled columns comes from one aggregate, or of many columns
    from blocked products (``moments``); the projection of every row is a DataFrame expression.
    """
    d = len(columns)
    if not 1 <= n_components <= d:
        raise ValueError(f"n_components must be between 1 and {d}")
    if set(keep) & set(columns):
        raise ValueError("columns to keep must not be among those to project")
    scaled = zscores(df.select(*keep, *columns), columns)
    if d > GRAM_COLUMNS:
        cov = moments(scaled, columns).covariance()
    else:
        pairs = [(i, j) for i in range(d) for j in range(i + 1)]
        row = scaled.agg(*(F.covar_pop(F.col(columns[i]), F.col(columns[j])) for i, j in pairs)).first()
        cov = np.zeros((d, d))
        for (i, j), v in zip(pairs, row):
            cov[i, j] = cov[j, i] = v or 0.0
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    vectors *= np.where(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)] < 0, -1, 1)[:, None]
    parts = vectors[:n_components]
    projected = [_added([F.col(c) * float(parts[k, i]) for i, c in enumerate(columns)]).alias(f"pc{k + 1}") for k in range(n_components)]
    return Pca(scaled.select(*keep, *projected), parts, values[:n_components] / max(values.sum(), 1e-300))


def umap_embedding(df: DataFrame, columns: Sequence[str], *, n_neighbors: int = 15, min_dist: float = 0.1, n_components: int = 2, seed: int = 42) -> np.ndarray:
    """UMAP by the optional umap-learn library, on the driver; RuntimeError without it."""
    if n_neighbors < 2:
        raise ValueError("n_neighbors must be at least 2")
    if min_dist < 0:
        raise ValueError("min_dist must be zero or more")
    try:
        import umap
    except ImportError as e:
        raise RuntimeError("umap-learn is not installed") from e
    data = df.select(*columns).dropna().toPandas().to_numpy(float)
    return umap.UMAP(n_neighbors=n_neighbors, min_dist=min_dist, n_components=n_components, random_state=seed).fit_transform(data)


def heatmap_cells(df: DataFrame, **options) -> DataFrame:
    """The cells of a correlation heatmap: the lower triangle in long form."""
    return correlation_matrix(df, **options)


def line_series(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """The points of a line plot over time, in order."""
    missing = [c for c in (x, y, color) if c and c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(color).alias("color")] if color else [])).orderBy("x")
