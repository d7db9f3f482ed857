"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.plans.store import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node points the neighbours larger than it (large) or not larger (small) at its least neighbour."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(materialize(least, "least"), "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = linked.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(linked.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return out.where(F.col("src") != F.col("dst")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge table (src, dst): root is the smallest node of the component. The key's type
    is free as long as it has an order (longs, strings, structs). Self-loops count only as nodes that stand alone."""
    edges = materialize(edges.select("src", "dst"), "edges")
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.col("dst").alias("root"))
    now = materialize(edges.where(F.col("src") != F.col("dst")).distinct(), "star")
    for _ in range(rounds):
        if now.isEmpty():
            break
        new = materialize(_star(materialize(_star(now, True), "star"), False), "star")
        done = new.count() == now.count() and new.join(now, ["src", "dst"], "left_anti").isEmpty()
        now = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root"))
    return members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("root").alias("root"))
