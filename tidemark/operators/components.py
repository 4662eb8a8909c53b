"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", work: Workspace | None = None) -> DataFrame:
    """``(node, component)`` of every node of an edge; component is the smallest node of it.

    Each round is two group-bys with a minimum, combined before the shuffle, so a hub costs no more than its edges;
    the rounds grow with the logarithm of the graph, not with its diameter. Every round is a table in the shared
    folder, dropped once the next is there; the answer is a table of ``work``, or without it one that stays. Rows with a null end are no
    edges; a loop gives a component of one node."""
    spark = edges.sparkSession
    with Workspace(spark) as own:
        linked = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
        raw = own.table(linked.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
        now, before, old = raw.where("src <> dst"), None, None
        while (state := _state(now)) != before:
            both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
            large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
            least = large.groupBy("src").agg(F.min("dst").alias("m"))
            small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            before, new = state, own.table(small.union(least.select("src", F.col("m").alias("dst"))).distinct())
            if old is not None:
                own.drop(old)
            now = old = new
        members = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        alone = raw.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        out = alone.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        return (work.table if work else own.result)(out)
