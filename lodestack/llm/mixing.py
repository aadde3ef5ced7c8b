"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of n rows that should give a share w of a mix of T rows has the repetition rate wT/n.
Every row draws its number of copies from the Poisson law of that mean, by inversion of a uniform
number that a hash gives: of the seed, of all the row holds, and of its number among equal rows.
So the draw needs no state, is the same in every run and layout, and no task has to see a source
as a whole. A rate above MOST_RATE is the sum of several such draws, which bounds the table of
cumulative probabilities by some 800 numbers a source. Copies are then dealt by a hash of the
same and of the copy, and sorted by it within their partition: a uniform shuffle of the whole mix.

Edge cases: rows without a source are a source of their own; a source without a target weight
(when weights are given) gets rate 0; ids play no part, so rows without an id, or with the id of
another, draw on their own, and so do rows that are equal in all columns; an empty table gives an
empty result. The added columns are copy, copies, rate and shuffle_key; columns of these names in
the input are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.shared import materialise, numbered, partitions

#: Rates and probabilities of all sources are broadcast up to this size.
BROADCAST_BYTES = 32 << 20
#: Parts into which a source is cut for a join without broadcast.
SALTS = 64
#: The largest mean of one draw.
MOST_RATE = 512
ADDED = ("copy", "copies", "rate", "shuffle_key")


def _unit(text: Column) -> Column:
    """52 bits of an MD5 as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(df: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, size: int | None = None) -> DataFrame:
    """source, n, rate. Without weights a source's share is n to the power temperature, normalised."""
    counts = df.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(share)
    totals = counts.agg(F.sum(share).alias("_shares"), F.sum("n").alias("_rows")).first()
    if not totals["_rows"]:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    if not totals["_shares"]:
        raise ValueError("no source of the table has a weight")
    target = float(totals["_rows"] if size is None else size)
    return counts.select("source", "n", (share / F.lit(totals["_shares"]) * F.lit(target) / F.col("n")).alias("rate"))


def _thresholds(rate: DataFrame) -> DataFrame:
    """source, rate, draws (how many make a count) and the cumulative Poisson probabilities of 0, 1, 2, ... of one draw to where the tail is below 2^-52."""
    each = rate.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    steps = each.select("source", "rate", "draws", "mean", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    by = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(by)
    term = F.when(F.col("mean") > 0, F.exp(F.col("k") * F.log("mean") - F.col("mean") - log_factorial)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    summed = steps.withColumn("_term", term).withColumn("_cdf", F.sum("_term").over(by))
    return summed.groupBy("source", "rate", "draws").agg(F.array_sort(F.collect_list("_cdf")).alias("_cdf"))


def replicate(df: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, size: int | None = None, seed: int = 17) -> DataFrame:
    """The mix: rows of df, each as often as it was drawn, in shuffled order."""
    spark = df.sparkSession
    df = df.drop(*ADDED)
    table = materialise(_thresholds(rates(df.select("source"), weights, temperature, size)).withColumnRenamed("source", "_source"), "rates")
    room = table.agg(F.coalesce(F.sum(8 * F.size("_cdf") + F.octet_length(F.coalesce("_source", F.lit(""))) + 64), F.lit(0))).first()[0]
    rows = numbered(df).select("_all", F.col("_all")["source"].alias("_from"), F.concat(F.lit(f"{seed}:"), F.lower(F.hex("_h")), F.lit(":"), F.col("_n").cast("string")).alias("_name"))
    same = F.col("_from").eqNullSafe(F.col("_source"))
    if room <= BROADCAST_BYTES:
        drawn = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("_part", F.pmod(F.xxhash64("_name"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_part") == F.col("_salt")))
    draw = lambda i: F.size(F.filter("_cdf", lambda c: c <= _unit(F.concat(F.col("_name"), F.lit(":draw"), i.cast("string")))))
    first = F.col("_u")
    more = F.when(F.col("draws") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("draws"))), F.lit(0), lambda n, i: n + draw(i))).otherwise(0)
    drawn = drawn.withColumn("_u", _unit(F.concat(F.col("_name"), F.lit(":draw1"))))
    drawn = drawn.withColumn("copies", F.size(F.filter("_cdf", lambda c: c <= first)) + more).where("copies > 0")
    each = drawn.select("_all", "_name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "copies", "rate")
    each = each.withColumn("shuffle_key", F.md5(F.concat(F.col("_name"), F.lit(":"), F.col("copy").cast("string"))))
    return each.repartition(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key").select("_all.*", "copy", "copies", "rate", "shuffle_key")


#: Rows of replicate() with its defaults over documents, where no rate is above MOST_RATE.
SQL = """
    WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    t AS (SELECT sum(sqrt(CAST(n AS DOUBLE))) AS shares, sum(n) AS total FROM n),
    r AS (SELECT source, sqrt(CAST(n AS DOUBLE)) / shares * CAST(total AS DOUBLE) / n AS rate FROM n, t),
    k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM r),
    c AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
    x AS (SELECT doc_id, source, text, lang, n_chars, CAST(doc_id AS VARCHAR) AS d, CAST(n_chars AS VARCHAR) AS w FROM documents),
    h AS (SELECT *, sha256(coalesce(strlen(d) || ':' || d, 'n') || coalesce(strlen(text) || ':' || text, 'n') || coalesce(strlen(lang) || ':' || lang, 'n') || coalesce(strlen(source) || ':' || source, 'n') || coalesce(strlen(w) || ':' || w, 'n')) AS h FROM x),
    m AS (SELECT *, '17:' || h || ':' || row_number() OVER (PARTITION BY h) AS name FROM h),
    u AS (SELECT *, CAST('0x' || substr(md5(name || ':draw1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM m),
    d AS (SELECT u.doc_id, u.source, name, any_value(rate) AS rate, count(*) FILTER (cdf <= u) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source, name)
    SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, round(rate, 6) AS rate, md5(name || ':' || copy) AS shuffle_key
    FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM d)
"""
