"""Connected components by alternating large and small stars, in DataFrame operations only.

Every round is two aggregations and two joins of edges; hubs are met by aggregates that combine
before the shuffle and by joins whose skewed side adaptive execution can split. No neighbour
list, link or component is ever gathered anywhere. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, label for every node that has an edge to another; label is the component's smallest node.

    Null ends and loops are dropped; repeated edges count once. No edges: an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    mark = None
    for _ in range(most_rounds):
        e = materialise(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. In e, u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()
