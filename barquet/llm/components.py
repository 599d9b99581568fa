"""Connected components of links by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each linked node reaches; `links` has a, b.

    Every round points nodes at smaller neighbours, first from the larger side, then
    from the smaller, until nothing changes; the number of rounds grows with the
    logarithm of the nodes. A node with a large share of all links only meets unique
    minima in a join, which adaptive execution splits. Rounds are stored tables.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found` (stored, as `components` returns it) after further links.

    Links are first mapped through the components that are known: only what joins two of them is
    searched, and where nothing does, no search runs and `found` comes back with the new nodes' rows.
    """
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = materialize(
        links.join(a, "a", "left").join(b, "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct(),
        "between",
    )
    if between.isEmpty():
        return found
    merged = materialize(components(between), "merged")
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = found.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    # Nodes that had no link before are their own components in `merged`.
    new = merged.join(found.select("node"), "node", "left_anti")
    return materialize(moved.unionByName(new), "components")
