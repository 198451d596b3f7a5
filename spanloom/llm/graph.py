"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a groupBy with partial aggregates and a join on the same key, which adaptive
execution splits where one vertex has very many edges. Each round's edges are written to the
shared folder, so lineage stays short and a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import drop_table, write_table

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Large: neighbours above u are tied to the least of u and its neighbours.
    Small: neighbours below u, and u, are tied to the least of them."""
    if large:
        rows = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = rows.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    tied = rows.join(low, rows["u"] == low["k"])
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (u long, v long). Returns (id, component) for every vertex of an edge, component
    being the smallest id reachable. Loops and repeated edges are allowed."""
    now = write_table(edges.select("u", "v").filter("u <> v").distinct(), "cc-edges")
    seen = None
    for i in range(MAX_ROUNDS):
        after = write_table(_star(_star(now, True), False), f"cc-{i}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    ids = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
