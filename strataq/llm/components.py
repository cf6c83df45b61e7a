"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import attached, staged, unstage

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)")).alias("h")).collect()[0]
    return row["n"], row["h"]


def roots(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, root: the least node of its component, for every node of a link between two nodes.

    Each round is written to the shared folder, and the one before it deleted. A node's links meet its least neighbour, which
    is counted out by partial sums, in a join on the node; a hub's links meet it in a broadcast (see attached), so they are
    never gathered in one task. Loops (u = v) and links with a null end are ignored.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        if (state := _state(edges)) == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, total = state, 2 * state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = staged(attached(both, least, ["u"], "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attached(large, down, ["u"], "n", total)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        found = staged(small.distinct(), "links")
        unstage(edges), unstage(large)
        edges = found
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
