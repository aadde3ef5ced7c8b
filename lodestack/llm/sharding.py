"""A uniform shuffle into shards whose sizes differ by one row at most.

Rows are dealt to buckets by a hash. A matrix says how many rows of each bucket go to each shard;
it is drawn from the multivariate hypergeometric law that a uniformly random permutation of all
rows would give it, with the exact shard sizes as column sums. Each bucket permutes its rows and
hands the first ones to shard 0, the next ones to shard 1 and so on (exchange), then each shard
permutes again, in sub-shards, so no task holds a whole shard.

All orders are settled on narrow keys, which are written once: a hash of the row and its number
among equal rows. What the rows themselves need to know is the last key that each bucket hands to
each shard. These ends are broadcast (BROADCAST_BYTES bounds the number of buckets), so rows move
once, straight to their sub-shard. Every order is a hash with a seed, so a lost task that runs
again gives the same rows, and the result does not depend on the layout of the input.

Edge cases: repeated rows each get a place of their own, spread like all others; ids and texts may
be null, as no order asks for them; all columns of the input travel along, whatever their names,
but those called shard or slot are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.shared import materialise, numbered, partitions

#: numpy draws hypergeometric numbers for urns below this size.
NUMPY_URN = 10**9
#: Size of the broadcast ends, at about END_BYTES for a bucket and shard.
BROADCAST_BYTES = 64 << 20
END_BYTES = 80


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones there are among n drawn without replacement."""
    if good == 0 or n == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(good, n)
    if good + bad < NUMPY_URN:
        return int(rng.hypergeometric(good, bad, n))
    return _ratio_of_uniforms(rng, good, bad, n)


def _ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same law for large urns: ratio of uniforms under a table mountain hat, accepted by exact logarithms."""
    total = good + bad
    mean = n * good / total
    spread = math.sqrt(max(0.0, mean * (1 - good / total) * (total - n) / (total - 1)))
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(0, n - bad), min(n, good)

    def log_p(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))

    top, wide = log_p(mode), 2 * math.sqrt(2 / math.e) * math.sqrt(spread * spread + 0.5) + (3 - 2 * math.sqrt(3 / math.e))
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(mean + 0.5 + wide * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts [bucket, shard]; row sums as given, column sums one apart at most."""
    rng, total = np.random.default_rng(seed), sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = np.zeros((len(rows), shards), np.int64)
    for b, n in enumerate(rows):
        left, rest = n, sum(room)
        for s in range(shards):
            rest -= room[s]
            k = _hypergeometric(rng, room[s], rest, left)
            drawn[b, s], left, room[s] = k, left - k, room[s] - k
    return drawn


def _hash(seed: int, step: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(step), "_h", "_n")


def _key() -> Column:
    """The place of a row in its bucket's order; no two rows share it."""
    return F.struct(F.col("_o"), F.col("_h"), F.col("_n"))


def keys_of(rows: DataFrame, buckets: int, subs: int, seed: int) -> DataFrame:
    """rows (with _h and _n) with _bucket, _o (the order within it) and _sub."""
    bucket = F.pmod(_hash(seed, 0), F.lit(buckets)).cast("int")
    return rows.withColumns({"_bucket": bucket, "_o": _hash(seed, 1), "_sub": F.pmod(_hash(seed, 2), F.lit(subs)).cast("int")})


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 20240501) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 within its shard)."""
    spark = df.sparkSession
    buckets = max(1, min(4 * partitions(spark), BROADCAST_BYTES // (END_BYTES * shards)))  # several to a task, which evens tasks out
    subs = max(1, -(-8 * partitions(spark) // shards))
    rows = keys_of(numbered(df.drop("shard", "slot")), buckets, subs, seed)
    keys = materialise(rows.select("_bucket", "_o", "_h", "_n", "_sub"), "keys")
    counted = {r["_bucket"]: r["count"] for r in keys.groupBy("_bucket").count().collect()}  # a row per bucket
    ends = communication_matrix([counted.get(b, 0) for b in range(buckets)], shards, seed).cumsum(axis=1)
    matrix = F.broadcast(spark.createDataFrame([(b, ends[b].tolist()) for b in range(buckets)], "_bucket int, _ends array<long>"))

    local = Window.partitionBy("_bucket").orderBy(_key())
    ranked = keys.withColumn("_rank", F.row_number().over(local)).join(matrix, "_bucket")
    dealt = ranked.select("_bucket", "_o", "_h", "_n", "_sub", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).alias("shard"))
    last = dealt.groupBy("_bucket", "shard").agg(F.max(_key()).alias("last")).groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("_last"))
    below = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))  # a row per sub-shard
    starts = sizes.select("shard", "_sub", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))

    to = rows.join(F.broadcast(materialise(last, "ends")), "_bucket").withColumn("_at", _key())
    to = to.withColumn("shard", F.try_element_at(F.filter("_last", lambda e: e["last"] >= F.col("_at")), F.lit(1))["shard"])
    within = Window.partitionBy("shard", "_sub").orderBy(_hash(seed, 3), "_h", "_n")
    placed = to.select("_all", "_h", "_n", "_sub", "shard").withColumn("_row", F.row_number().over(within)).join(F.broadcast(materialise(starts, "starts")), ["shard", "_sub"])
    return placed.select("_all.*", "shard", (F.col("_before") + F.col("_row") - 1).alias("slot"))
