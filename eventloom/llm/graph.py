"""Connected components of an edge table, by alternating large and small stars; no node's edges meet in one place unsplit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, tidy, written

#: Rounds at most; they grow with the logarithm of the longest path, so this is out of reach.
ROUNDS = 60


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """For each u the least of u and its neighbours. A table of its own, so that the join with it can split hot nodes."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", rows=rows)


def _loose(edges: DataFrame) -> tuple[int, int]:
    """The edges (u > v), and the nodes that keep them from being stars around least nodes: with several v, or with one and a u of their own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    found = nodes.agg(F.sum("below"), F.count_if((F.col("below") > 1) | (F.col("below") == 1) & (F.col("above") == 1))).first()
    return found[0] or 0, found[1]


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it can reach) of every node of edges (u, v: long, u <> v, any direction; counted first, so cheap to read)."""
    rows = edges.count()  # no table of a round has more, but those of both directions
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", rows=rows)
    rows, loose = _loose(now)
    for _ in range(ROUNDS):
        if not loose:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both, 2 * rows)
        large = written(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", rows=rows)
        least = _least(large, rows)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", rows=rows)
        dropped(last, near, large, least)
        tidy(edges.sparkSession)
        rows, loose = _loose(now)
    if loose:
        raise RuntimeError("components did not settle")
    roots = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components", rows=2 * rows)
    dropped(now)
    return roots
