"""Connected components by contraction, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowdeck.session import durable


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge list; ``component`` is the smallest node.

    Each round hangs every node on the smallest node it touches, follows those pointers to
    their ends, and keeps only the edges between what is still apart. Whatever is no local
    minimum disappears, so few rounds are needed. Every round is checkpointed; the driver
    learns only whether edges remain. NULL ends and loops are ignored, repeated edges are
    harmless, no edges give no rows.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    edges = durable(edges.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    names = None
    while True:
        both = edges.union(edges.select("v", "u"))
        parents = _settled(durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component"))))
        names = parents if names is None else durable(_renamed(names, parents))
        start = parents.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        end = parents.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        edges = durable(
            edges.join(start, "u").join(end, "v").where("cu <> cv")
            .select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
        )
        if edges.isEmpty():
            return names


def _renamed(names: DataFrame, parents: DataFrame) -> DataFrame:
    tops = parents.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return names.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _settled(parents: DataFrame) -> DataFrame:
    """Follow pointers until every node points at a root; each step halves the way."""
    while True:
        tops = parents.select(F.col("node").alias("component"), F.col("component").alias("top"))
        step = durable(parents.join(tops, "component").select("node", "top", (F.col("top") != F.col("component")).alias("moved")))
        parents = step.select("node", F.col("top").alias("component"))
        if step.where("moved").isEmpty():
            return parents
