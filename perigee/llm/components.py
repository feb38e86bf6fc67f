"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm._spark import discard, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).collect()[0])


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component), written, for every node of the links (a, b) that is not its component's least.

    Each round moves edges, not groups: a node's neighbours are never gathered.  Nulls and loops
    are dropped; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(rounds if mark[0] else 0):
        before, edges = edges, written(_small(_large(edges)), "stars")
        discard(before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out._scratch = edges._scratch
    return out
