"""Connected components by contraction; every round is stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.storage import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of the undirected ``links`` (columns ``a, b``).

    Each round, every node points to its least neighbour or itself, pointers are followed twice, and the
    links are redrawn between what they point to; rounds go on until no link is left.  Links are
    distinct at every round, so a group of any size is aggregated map-side and never gathered.
    """
    links = scratch.table(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    roots = scratch.table(roots, "roots")
    while links.limit(1).count():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y"))
        hop = step.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step2 = scratch.table(step.join(hop, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "hop")
        to = lambda c: step2.select(F.col("x").alias(c), F.col("y").alias(f"{c}_to"))
        redrawn = links.join(to("a"), "a").join(to("b"), "b").where("a_to != b_to")
        next_links = scratch.table(redrawn.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        next_roots = scratch.table(roots.join(to("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "roots")
        scratch.drop(links, roots, step2)
        links, roots = next_links, next_roots
    return roots


def extended(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` after more ``links``: only the roots that they join are contracted."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = scratch.table(both.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")), "more")
    joined = components(both.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), scratch).select(F.col("node").alias("root"), F.col("root").alias("to"))
    ends = both.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_root").alias("root")), F.struct(F.col("b").alias("node"), F.col("b_root").alias("root")))).alias("e"))
    every = roots.unionByName(ends.select("e.node", "e.root")).distinct()
    return scratch.table(every.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
