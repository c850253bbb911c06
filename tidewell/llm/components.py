"""Connected components with DataFrame joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is one node of its component.

    Each round every node points at its smallest neighbour (itself included),
    pointer jumping turns the resulting trees into stars, and the edges are
    contracted to the roots. A round at least halves the nodes that still have
    edges. ``a`` and ``b`` must be of one orderable type; null ends and loops are
    ignored. A hub with very many edges is pre-aggregated before the shuffle when
    minima are taken, and is a splittable side of the joins otherwise.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    live = scratch.save(both.union(both.select("b", "a")).distinct(), "edges0")
    roots, k = live.select(F.col("a").alias("node"), F.col("b").alias("root")), 0
    while not live.isEmpty():
        up = _stars(live, scratch, f"up{k}")
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if k == 0:
            roots = up
        else:
            roots = scratch.save(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"roots{k}")
        of_a, of_b = (up.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
        shrunk = live.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        k += 1
        live = scratch.save(shrunk, f"edges{k}")
        scratch.drop(f"edges{k - 1}")
    return roots


def _stars(live: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, root)``: where chains of smallest neighbours end."""
    up = live.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
    up, j = scratch.save(up, f"{name}.0"), 0
    while True:
        # Two jumps at once, so a chain of 2 ** 2 steps ends in one pass.
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        once = up.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        twice = once.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.coalesce(F.col("next") < F.col("root"), F.lit(False)).alias("moved"))
        j += 1
        jumped = scratch.save(twice, f"{name}.{j}")
        scratch.drop(f"{name}.{j - 1}")
        up = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return up
