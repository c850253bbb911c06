"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Vectors are dealt to shards of bounded size and each shard's tree is built once, in
one shuffle; rows go to a table in order of the leaves, the tree beside them.
Queries then pass over that table in blocks of bounded size, sent with the tasks: a
task searches its shards one after another and keeps the best of all so far, so a
later shard is searched with the radius that the earlier ones left. Only each
task's best rows are shuffled.

Unit vectors' distances obey the triangle inequality, so a subtree is skipped when
its distances from the vantage point rule out anything nearer than the worst kept.
``factor`` shrinks that radius: one is exact, less is faster and approximate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch, row_batches

LEAF = 128
SLACK = 1e-9
SHARD_ROWS = 10_000
SHARD_BYTES = 32_000_000
QUERY_BYTES = 16_000_000


@dataclass
class Node:
    rows: np.ndarray | None  # of a leaf
    vantage: int = -1
    near: Node | None = None
    far: Node | None = None
    middle: float = 0.0
    reach: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # least and most distance of near, of far


def build(unit: np.ndarray, rows: np.ndarray, seed: int = 1) -> Node:
    """Tree over ``unit[rows]``; a set of equal distances becomes one leaf."""
    if len(rows) <= LEAF:
        return Node(rows)
    vantage = int(rows[(seed * 2654435761) % len(rows)])
    d = distance(unit[rows], unit[vantage])
    middle = float(np.median(d))
    near = d <= middle
    if near.all():
        near = d < middle
        if not near.any():
            return Node(rows)
    reach = (float(d[near].min()), float(d[near].max()), float(d[~near].min()), float(d[~near].max()))
    return Node(None, vantage, build(unit, rows[near], seed * 2 + 1), build(unit, rows[~near], seed * 2 + 2), middle, reach)


def distance(unit: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ point)))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that norms and products neither overflow nor vanish and no digit changes."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors score equally wherever they lie."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Search:
    """The ``k`` nearest rows of a tree for each query, given the cosines of the ``k`` best met elsewhere."""

    def __init__(self, unit: np.ndarray, queries: np.ndarray, best: np.ndarray, factor: float) -> None:
        self.unit, self.queries, self.factor = unit, queries, factor
        self.best = best  # highest cosines so far, ascending; updated in place
        self.k = best.shape[1]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.home = np.full(len(queries), -1, np.int64)

    def run(self, root: Node) -> tuple[np.ndarray, np.ndarray]:
        everyone = np.arange(len(self.queries))
        self._descend(root, everyone)
        self._visit(root, everyone)
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, row, cosine = (np.concatenate(x) for x in zip(*self.found))
        keep = cosine >= self.best[q, 0] - SLACK
        return q[keep], row[keep]

    def _descend(self, node: Node, who: np.ndarray) -> None:
        """First each query looks where it would lie itself, which gives it a radius."""
        if not len(who):
            return
        if node.rows is not None:
            self.home[who] = id(node)
            self._scan(node.rows, who)
            return
        near = distance(self.queries[who], self.unit[node.vantage]) <= node.middle
        self._descend(node.near, who[near])
        self._descend(node.far, who[~near])

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            self._scan(node.rows, who[self.home[who] != id(node)])
            return
        d = distance(self.queries[who], self.unit[node.vantage])
        for child, low, high in ((node.near, *node.reach[:2]), (node.far, *node.reach[2:])):
            worst = self.best[who, 0]
            radius = np.where(np.isfinite(worst), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst)) * self.factor, np.inf) + np.sqrt(SLACK)
            self._visit(child, who[(d - radius <= high) & (d + radius >= low)])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        if not len(who):
            return
        cosine = self.queries[who] @ self.unit[rows].T
        merged = np.concatenate([self.best[who], cosine], axis=1)
        self.best[who] = np.sort(np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        q, r = np.nonzero(cosine >= self.best[who, 0][:, None] - SLACK)
        self.found.append((who[q], rows[r], cosine[q, r]))


def _index(key: tuple, table: pa.Table) -> pa.Table:
    """One shard as one row: its ids, its vectors and the tree over them."""
    dim = key[0].as_py()
    v = scaled(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    ids = table["id"].to_numpy()
    tree = build(units(v), np.arange(len(ids)))
    packed = [ids.tobytes(), v.tobytes(), pickle.dumps(tree)]
    return pa.Table.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["dim", "ids", "vectors", "tree"])


class Best:
    """The ``k`` best rows of each query of one dimension so far, over all shards of a task."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        self.ids, self.v, self.unit, self.k = ids, v, units(v), k
        self.cosine = np.full((len(ids), k), -np.inf)
        self.q = self.vec = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.own = np.zeros(0, bool)

    def add(self, ids: np.ndarray, v: np.ndarray, tree: Node, factor: float) -> None:
        q, r = Search(units(v), self.unit, self.cosine, factor).run(tree)
        score, own = np.empty(len(q)), np.empty(len(q), bool)
        for i in range(0, len(q), 100_000):
            a, b = self.v[q[i : i + 100_000]], v[r[i : i + 100_000]]
            score[i : i + 100_000] = cosines(a, b)
            own[i : i + 100_000] = (self.ids[q[i : i + 100_000]] == ids[r[i : i + 100_000]]) & (a == b).all(axis=1)
        q, vec, score, own = (np.concatenate(x) for x in ((self.q, q), (self.vec, ids[r]), (self.score, score), (self.own, own)))
        order = np.lexsort((vec, -score, q))
        q = q[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.vec, self.score, self.own = q[top], vec[order][top], score[order][top], own[order][top]


def _searched(batches: Iterator[pa.RecordBatch], blocks: dict, k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """``blocks``: for each number of components, the queries' places, ids and vectors."""
    best: dict[int, Best] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            dim = batch.column(0)[i].as_py()
            if dim not in blocks:
                continue
            _, ids, v = blocks[dim]
            found = best.setdefault(dim, Best(ids, v, k))
            own_ids, vectors, tree = (batch.column(c)[i].as_buffer() for c in (1, 2, 3))
            found.add(np.frombuffer(own_ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim), pickle.loads(tree), factor)
    for dim, found in best.items():
        place, ids, _ = blocks[dim]
        yield pa.RecordBatch.from_arrays([pa.array(place[found.q]), pa.array(ids[found.q]), pa.array(found.vec), pa.array(found.score), pa.array(found.own)], ["place", "query_id", "vec_id", "score", "own"])


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest cosine for each query.

    A query's candidates are the rows of ``vectors`` with as many components, less
    one row that equals the query in id and vector: its own. Fewer than ``k`` give
    fewer rows. Equal scores rank by smaller id. Every row of ``queries`` is
    answered, also ones that share an id. ``score`` is the cosine in double
    precision, whatever the vectors' magnitudes.

    Rows with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component take no part. A row repeated in ``vectors`` can be found
    repeatedly. Empty tables give an empty result; extra columns are ignored.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        fine = "id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
        return v.where(f"coalesce({fine}, false)").withColumn("dim", F.size("v"))

    spark = vectors.sparkSession
    scratch = Scratch(spark, "vptree")
    pool, asked = valid(vectors), valid(queries)
    rows, widest = pool.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(1, -(-rows // max(1, min(shard_rows, SHARD_BYTES // (8 * widest)))))
    # A row's place in the scan spreads rows that are repeated many times.
    pool = pool.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    index = pool.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInArrow(_index, "dim int, ids binary, vectors binary, tree binary")
    index = scratch.save(index, "index")
    size = asked.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-size // query_bytes))
    asked = asked.withColumn("place", F.monotonically_increasing_id())
    asked = scratch.save(asked.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")), "queries")
    # All blocks' finds go under one folder, which is read once.
    kinds = "place bigint, query_id bigint, vec_id bigint, score double, own boolean"
    for b in range(blocks):
        table = asked.where(F.col("block") == b).select("dim", "place", "id", "v").toArrow()
        sent = spark.sparkContext.broadcast(_by_dim(table))
        with row_batches(spark, 1):
            index.mapInArrow(lambda it, sent=sent: _searched(it, sent.value, k + 1, factor), kinds).write.mode("append").parquet(scratch.path("found"))
        sent.destroy()
    found = spark.read.schema(kinds).parquet(scratch.path("found"))
    of_query = "over (partition by place"
    ranked = found.withColumn("n", F.expr(f"row_number() {of_query} order by score desc, vec_id, own)"))
    ranked = ranked.withColumn("itself", F.expr(f"coalesce(min(if(own, n, null)) {of_query}), {k + 2})")).where("n <> itself")
    ranked = ranked.withColumn("rank", (F.col("n") - F.when(F.col("n") > F.col("itself"), 1).otherwise(0)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_dim(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    dims = table["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        mine = table.filter(pa.array(dims == dim))
        v = mine["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        out[dim] = (mine["place"].to_numpy(), mine["id"].to_numpy(), scaled(v))
    return out
