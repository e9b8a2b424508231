"""Connected components of a link table, by hooking each component to its smallest neighbour and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import Scratch


def _flatten(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """node -> root from node -> smaller parent (a root is its own parent), by doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), (F.col("next") < F.col("parent")).alias("moved"))
        after, moved = scratch.keep_counted(jumped, F.col("moved"))
        scratch.drop(parents)
        parents = after
        if not moved:
            return parents


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the links (a, b), as a written table; the root is some node of the component, the same for all.

    Each round hooks every component to the smallest of its neighbours if that is smaller than itself, and contracts; links
    inside a component go. A component that neither hooks nor is hooked to lost its neighbours to smaller ones, so it hooks
    in the next round: two rounds leave at most half of the components that have links. Nothing is gathered on the driver.
    """
    edges, left = scratch.keep_counted(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), F.lit(True))
    roots = None
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        hooked = _flatten(scratch, scratch.keep(least.select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))))
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        if roots is None:
            after = scratch.keep(hooked.select("node", "parent"))
        else:
            after = scratch.keep(roots.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent")))
            scratch.drop(roots)
        roots = after
        to = lambda c: hooked.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        between = (
            edges.join(to("a"), "a")
            .join(to("b"), "b")
            .where(F.col("a_root") != F.col("b_root"))
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .distinct()
        )
        after, left = scratch.keep_counted(between, F.lit(True))
        scratch.drop(edges, hooked)
        edges = after
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.select("node", F.col("parent").alias("root"))
