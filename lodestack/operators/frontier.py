"""Traversal level by level: what a queue with depth, duplicate and budget limits lets through.

The order of a level is (depth, seq); the first of equal canonical urls wins, by a window per url.
Where a level has more new urls than the budget allows, the last one that fits is found by a
top-k of the budget's size; a level within its budget is not ordered at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.urls import canonical_url, same_site

#: Budgets beyond this are compared with the level's count before anything is ordered.
TOP_ROOM = 1_000_000


@dataclass
class FrontierStats:
    queued: int = 0
    popped: int = 0
    duplicates: int = 0
    too_deep: int = 0
    over_budget: int = 0
    max_depth_reached: int = 0

    def merge(self, other: FrontierStats) -> FrontierStats:
        sums = {k: getattr(self, k) + getattr(other, k) for k in ("queued", "popped", "duplicates", "too_deep", "over_budget")}
        return FrontierStats(**sums, max_depth_reached=max(self.max_depth_reached, other.max_depth_reached))


def admit(candidates: DataFrame, seen: DataFrame, max_depth: int = 2, room: int = 1000) -> DataFrame:
    """candidates (url, depth, seq, ...) with canon and verdict: queued, too_deep, over_budget or duplicate.

    Checks apply in that order of a sequential queue: depth, then budget, then duplicates. A url
    counts against the budget only if it was queued, so rows after the last queued one are over
    budget, duplicates or not. seen holds canonical urls (canon).
    """
    df = candidates.withColumn("canon", canonical_url(F.col("url")))
    deep = F.col("depth") > max_depth
    df = df.join(seen.select("canon").distinct().withColumn("_seen", F.lit(True)), "canon", "left")
    first = Window.partitionBy("canon", deep).orderBy("depth", "seq")
    df = df.withColumn("_fresh", ~deep & F.col("_seen").isNull() & (F.row_number().over(first) == 1))
    full = F.lit(room <= 0)
    if 0 < room <= TOP_ROOM or (room > TOP_ROOM and df.where("_fresh").count() > room):
        last = df.where("_fresh").orderBy("depth", "seq").limit(room).agg(F.max(F.struct("depth", "seq")).alias("_last"), F.count("*").alias("_n"))
        df = df.crossJoin(F.broadcast(last))  # one row
        full = (F.col("_n") >= room) & (F.struct("depth", "seq") > F.col("_last"))
    verdict = F.when(deep, "too_deep").when(full, "over_budget").when(F.col("_fresh"), "queued").otherwise("duplicate")
    return df.withColumn("verdict", verdict).drop("_seen", "_fresh", "_last", "_n")


def stats(admitted: DataFrame) -> FrontierStats:
    """Counters of a level, in one pass."""
    v = F.col("verdict")
    r = admitted.agg(*[F.count_if(v == k).alias(k) for k in ("queued", "duplicate", "too_deep", "over_budget")], F.max(F.when(v == "queued", F.col("depth"))).alias("deepest")).first()
    return FrontierStats(r["queued"], 0, r["duplicate"], r["too_deep"], r["over_budget"], r["deepest"] or 0)


def on_site(follows: DataFrame, url: str = "url", base: str = "base_url", depth: str = "depth") -> DataFrame:
    """Follow-ups below the seeds that stay on the site of their base."""
    return follows.where((F.col(depth) == 0) | same_site(F.col(url), F.coalesce(F.col(base), F.col(url))))


def traverse(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame], max_depth: int = 2, max_items: int = 1000) -> tuple[DataFrame | None, FrontierStats]:
    """Breadth-first traversal from seeds (url). expand maps admitted rows to follow-ups (url, seq, ...).

    keep writes a level and gives it back with its lineage cut; it gets a label. Returns all
    admitted rows and the counters.
    """
    level = seeds.withColumn("depth", F.lit(0))
    if "seq" not in level.columns:
        level = level.withColumn("seq", F.xxhash64("url"))
    total, found, seen = FrontierStats(), None, None
    for depth in range(max_depth + 2):
        past = seen if seen is not None else level.select(canonical_url(F.col("url")).alias("canon")).limit(0)
        admitted = keep(admit(level, past, max_depth, max_items - total.queued), f"level-{depth}")
        total = total.merge(stats(admitted))
        queued = admitted.where("verdict = 'queued'").drop("verdict")
        found = queued if found is None else found.unionByName(queued, allowMissingColumns=True)
        seen = found.select("canon")
        if queued.isEmpty():
            break
        level = expand(queued).withColumn("depth", F.lit(depth + 1))
    total.popped = total.queued
    return found, total


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, depth of all nodes within max_depth steps of the seeds (node) over edges (src, dst)."""
    found = keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reach-0")
    level = found
    for depth in range(1, max_depth + 1):
        step = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        level = keep(step.withColumn("depth", F.lit(depth)), f"reach-{depth}")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def chain(links: DataFrame, seeds: DataFrame, max_depth: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, depth of all nodes within max_depth links of the seeds (node), where a node has one link (src, dst) at most.

    Links are doubled in each round, so that the rounds grow with the logarithm of the depth.
    """
    found, hops, span = keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "chain-0"), links.select("src", "dst"), 1
    n = found.count()
    while span <= max_depth:
        further = found.withColumnRenamed("node", "src").join(hops, "src").select(F.col("dst").alias("node"), (F.col("depth") + span).alias("depth"))
        found = keep(found.unionByName(further).groupBy("node").agg(F.min("depth").alias("depth")), f"chain-{span}")
        before, n = n, found.count()
        if n == before:
            break
        hops = keep(hops.join(hops.select(F.col("src").alias("dst"), F.col("dst").alias("_dst")), "dst").select("src", F.col("_dst").alias("dst")), f"hops-{span}")
        span *= 2
    return found.where(F.col("depth") <= max_depth)
