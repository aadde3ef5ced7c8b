"""Change tracking: classify a batch against a table, merge it, flag what is gone.

All functions take and return DataFrames; sources.tables publishes the results.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import hashing
from lodestack.schemas import JOB_ITEMS, conform

KEY = ["source", "external_id"]
#: Columns that a changed row takes from the batch; id and first_seen_at stay.
UPDATED = [f.name for f in JOB_ITEMS if f.name not in ("id", "source", "external_id", "first_seen_at")]


def to_rows(items: DataFrame, seen_at: datetime, run_id: int | None = None) -> DataFrame:
    """Items as rows of the table, without an id."""
    c = F.col
    df = items.withColumns(
        {
            "run_id": F.lit(run_id).cast("long"),
            "search_text": hashing.search_text(c("title"), c("company"), c("location"), c("employment_type"), c("tags"), c("description")),
            "content_hash": hashing.content_hash(),
            "first_seen_at": F.lit(seen_at).cast("timestamp"),
            "last_seen_at": F.lit(seen_at).cast("timestamp"),
            "is_active": F.lit(True),
        }
    )
    return conform(df, JOB_ITEMS)


def last_of_each(batch: DataFrame, order: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per key: the one that comes last by order, or the one with the greatest hash."""
    keys = keys or KEY
    if order:
        ranked = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
        return ranked.where("_n = 1").drop("_n", order)
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns if c not in keys]), "content_hash").alias("_r")).select(*keys, "_r.*").select(*batch.columns)


def outcome(stored_hash: Column, new_hash: Column) -> Column:
    """new, unchanged or changed."""
    return F.when(stored_hash.isNull(), "new").when(stored_hash == new_hash, "unchanged").otherwise("changed")


def classify(target: DataFrame, batch: DataFrame, keys: list[str] | None = None, content: str = "content_hash") -> DataFrame:
    """batch with a column outcome; one join, of which the table gives key and hash only."""
    keys = keys or KEY
    stored = target.select(*keys, F.col(content).alias("_stored"))
    return batch.join(stored, keys, "left").withColumn("outcome", outcome(F.col("_stored"), F.col(content))).drop("_stored")


def write_stats(classified: DataFrame) -> DataFrame:
    """One row: new, changed, unchanged, total."""
    return classified.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "changed", "unchanged")], F.count("*").alias("total"))


def merge(target: DataFrame, batch: DataFrame, touch_unchanged: bool = False, top: int | None = None) -> DataFrame:
    """The table after an upsert of a batch with one row per key.

    Unchanged rows stay as they are, which includes last_seen_at and is_active, unless
    touch_unchanged. Changed rows keep id and first_seen_at. New rows get ids after top, or after the largest of target.
    """
    t, b = target.alias("t"), batch.alias("b")
    joined = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer")
    is_new, is_old = F.col("t.source").isNull(), F.col("b.source").isNull()
    change = ~is_old & (is_new | ~F.col("t.content_hash").eqNullSafe(F.col("b.content_hash")))
    columns = []
    for f in JOB_ITEMS:
        old, new = F.col(f"t.{f.name}"), F.col(f"b.{f.name}")
        if f.name == "id":
            c = old
        elif f.name in KEY:
            c = F.coalesce(old, new)
        elif f.name == "first_seen_at":
            c = F.when(is_new, new).otherwise(old)
        elif touch_unchanged and f.name in ("last_seen_at", "is_active", "run_id"):
            c = F.when(is_old, old).otherwise(new)
        else:
            c = F.when(change, new).otherwise(old)
        columns.append(c.alias(f.name))
    return assign_ids(joined.select(*columns), top=top)


def number(fresh: DataFrame, top: Column | int, keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """fresh with ids from top + 1 on, by hash bucket and key; no task sees all rows."""
    keys = keys or KEY
    spread = fresh.drop("id").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = spread.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per bucket
    within = Window.partitionBy("_bucket").orderBy(*keys)
    numbered = spread.withColumn("_row", F.row_number().over(within)).join(F.broadcast(before), "_bucket")
    top = F.lit(top) if isinstance(top, int) else top
    return numbered.withColumn("id", top + F.col("_before") + F.col("_row")).select(*fresh.columns)


def assign_ids(df: DataFrame, keys: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Fill null ids with numbers after top, or after the largest id of df."""
    fresh = df.where("id is null")
    if top is not None:
        return df.where("id is not null").unionByName(number(fresh, top, keys))
    largest = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = number(fresh.crossJoin(F.broadcast(largest)), F.col("_top"), keys).drop("_top")  # one row
    return df.where("id is not null").unionByName(numbered)


def mark_stale(target: DataFrame, source: str, seen: DataFrame, run_id: int | None = None) -> DataFrame:
    """The table with the source's active rows inactive whose external_id is not in seen; none seen means all of them."""
    present = seen.select("external_id").distinct().withColumn("_seen", F.lit(True))
    df = target.join(present, "external_id", "left")
    gone = (F.col("source") == source) & F.col("is_active") & F.col("_seen").isNull()
    columns = [F.when(gone, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_active" else F.when(gone, F.lit(run_id).cast("long")).otherwise(F.col(c)).alias(c) if c == "run_id" and run_id is not None else F.col(c) for c in target.columns]
    return df.select(*columns)


def stale_count(before: DataFrame, after: DataFrame) -> int:
    """How many rows turned inactive."""
    return before.where("is_active").count() - after.where("is_active").count()
