"""Connected components by repeated contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.base import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id reachable, for every id that has an edge.

    Each round points a node at its smallest neighbour, follows the pointers
    to their end by doubling, contracts the edges and drops loops, so rounds
    and doublings are few even for long chains. Smallest neighbours are partial
    aggregates, so a hub costs a row for each task; the joins have one row a
    node on one side. Every step is cut to the shared checkpoint folder, so a
    lost executor costs one step at most. Repeated edges and loops count once
    or not at all; a loop alone gives no row. Edges with a null end are left
    out. No edges: no rows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mapping = None
    while True:
        both = edges.select(F.col("b").alias("id"), F.col("a").alias("other")).unionByName(edges.select(F.col("a").alias("id"), F.col("b").alias("other")))
        step = both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("root"))
        jumped = cut(step)
        while True:
            further = jumped.join(jumped.select(F.col("id").alias("root"), F.col("root").alias("next")), "root")
            further = cut(further.select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            jumped = further.select("id", "root")
            if further.filter("moved").isEmpty():
                break
        if mapping is None:
            mapping = jumped
        else:
            mapping = cut(mapping.join(jumped.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        left = jumped.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = jumped.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = cut(edges)
        if edges.isEmpty():
            return mapping.select("id", F.col("root").alias("component"))
