"""Connected components by alternating large-star and small-star steps: joins and minima only, no collected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import Workspace


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame, work: Workspace, name: str = "stars", most: int = 50) -> DataFrame:
    """edges(u, v) -> (node, comp) for every node with an edge; comp is the smallest node of its component.

    Each step is written to the workspace, so lineage stays short and a lost executor costs one step.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = work.table(now, f"{name}-0")
    mark = _mark(now)
    for step in range(1, most + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.table(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
