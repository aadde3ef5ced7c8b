"""What a service or a dashboard asks of the tables, one function per question."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.errors import LodestackError
from lodestack.functions import display
from lodestack.operators import filters, metrics, rollups
from lodestack.plans.pipeline import Store

LISTING = "id bigint, title string, company string, location string, remote boolean, employment_type string, salary_min double, salary_max double, salary_currency string, posted_at string, tags array<string>, url string"


class NotFound(LodestackError):
    """No row has this id."""


class Service:
    def __init__(self, store: Store):
        self.store = store

    def items(self, **conditions) -> tuple[list, str | None]:
        """A page of summaries and the next cursor. conditions are those of ItemFilters."""
        return filters.page(self.store.read("job_items"), filters.ItemFilters(**conditions))

    def item(self, row_id: int) -> DataFrame:
        return self._one(filters.by_id(self.store.read("job_items"), row_id), row_id)

    def companies(self, include_inactive: bool = False, limit: int = 100) -> DataFrame:
        """As published: include_inactive asks for inactive items only."""
        return rollups.company_rollup(self.store.read("job_items"), not include_inactive, limit)

    def facets(self, column: str, limit: int = 50) -> DataFrame:
        return rollups.facet(self.store.read("job_items"), column, limit)

    def stats(self, as_of: datetime, days: int = 30) -> dict[str, DataFrame]:
        items = self.store.read("job_items")
        return {"totals": rollups.overview(items, as_of), "by_source": rollups.source_map(items), "daily": rollups.daily_series(items, "first_seen_at", as_of, days)}

    def runs(self, limit: int = 20) -> DataFrame:
        return rollups.recent_runs(self.store.read("crawl_runs"), limit).select(*filters.RUN_SUMMARY)

    def run(self, run_id: int) -> DataFrame:
        found = rollups.run_with_errors(self.store.read("crawl_runs"), self.store.read("fetch_errors"), run_id)
        return self._one(found.select(*filters.RUN_DETAIL, "errors"), run_id)

    def ready(self) -> DataFrame:
        """The newest run that succeeded; no row before the first."""
        return rollups.latest_successful(self.store.read("crawl_runs"))

    def metrics(self) -> DataFrame:
        return metrics.exposition(metrics.counters(self.store.read("crawl_runs")))

    @staticmethod
    def _one(df: DataFrame, row_id: int) -> DataFrame:
        if df.isEmpty():
            raise NotFound(f"no row {row_id}")
        return df


def parse_listing(payload: Column) -> Column:
    """A listing from its JSON; a date that is none is null."""
    row = F.from_json(payload, LISTING)
    return row.withField("posted_at", F.replace(row["posted_at"], F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"))


def listing_frame(items: DataFrame) -> DataFrame:
    """Listings as a table shows them."""
    return items.select(
        F.col("title").alias("Title"), F.col("company").alias("Company"), F.coalesce("location", F.lit(display.NOTHING)).alias("Location"), F.when(F.col("remote"), "yes").otherwise("no").alias("Remote"),
        F.coalesce("employment_type", F.lit(display.NOTHING)).alias("Type"), display.salary_display(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")).alias("Salary"), display.posted_display(F.col("posted_at")).alias("Posted"),
    )


def company_frame(rollup: DataFrame, limit: int = 15) -> DataFrame:
    """The first companies of a rollup as a table shows them."""
    return rollup.select(F.col("company").alias("Company"), F.col("n_items").alias("Listings"), F.col("n_remote").alias("Remote"), display.money_display(F.col("max_salary")).alias("Top salary"), display.posted_display(F.col("latest_posted")).alias("Latest")).limit(limit)


def run_frame(runs: DataFrame) -> DataFrame:
    return runs.select("id", "adapter", "status", "started_at", "pages_fetched", "items_seen", "items_new", "items_changed", "failures", F.round("duration_seconds", 1).alias("seconds"))
