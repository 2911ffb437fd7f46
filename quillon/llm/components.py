"""Connected components of link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.runtime import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a bigint, b bigint): root is the smallest node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest it sees; rounds grow with the
    logarithm of a component's width. Links never leave the cluster: a round's table is written to the shared folder, and
    the driver sees its row count and checksum alone. Minimums are taken map-side, so a node of many links is no hot key.
    Callers give few links for each node (a node's links to one component are one), as all of them are dealt each round.
    """
    stars, state = _told(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        before = stars, state
        stars, state = _told(small)
        forget(before[0])
        if state == before[1]:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _told(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and their number and checksum, observed as they are."""
    seen = Observation()
    out = cut(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")), "links")
    return out, (seen.get["n"], seen.get["s"])


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after `links` (a, b) are added to `roots`: only the roots that links connect are searched anew.

    Before, each link is told by the roots of its ends, and links between the same two are one. So however many links
    lead from one class to others, the search sees a link for each pair of classes at most.
    """
    if roots is None:
        return cut(components(links), "roots")
    of = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = cut(components(ends.where("a != b").distinct()), "moved")
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots.select("node"), "node", "left_anti")
    return cut(old.union(new), "roots")
