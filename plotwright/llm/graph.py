"""Connected components by hooking and contraction, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; root is the smallest node of its component.

    Each round every root hooks onto its smallest neighbouring root, chains of hooks are shortened by pointer
    jumping, and the edges are rewritten between roots; at least half of the roots that still have an edge
    and aren't local minima go, so the rounds grow with the logarithm of the graph. Groups are only ever
    aggregated with partial sums (min), never collected. Self loops, repeated and reversed edges are allowed;
    null ends are dropped; no edges give an empty table.
    """
    edges = edges.where("a is not null and b is not null")
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    live = edges.where("a <> b")
    while live.take(1):
        hooks = live.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("p"))
        hooks = scratch.save(hooks, "hooks")
        while True:
            up = hooks.select(F.col("r").alias("p"), F.col("p").alias("q"))
            jumped = scratch.save(hooks.join(up, "p", "left").select("r", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "jumped")
            scratch.drop(hooks)
            hooks = jumped.select("r", "p")
            hooks._scratch_path = jumped._scratch_path
            if not jumped.where("moved").take(1):
                break
        new = scratch.save(labels.join(hooks, labels.root == hooks.r, "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        ha, hb = hooks.select(F.col("r").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("r").alias("b"), F.col("p").alias("pb"))
        moved = live.join(ha, "a", "left").join(hb, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        moved = scratch.save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for old in (labels, edges, hooks):
            scratch.drop(old)
        labels, edges, live = new, moved, moved
    return labels
