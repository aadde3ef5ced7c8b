"""Sources by name. An adapter says where to start and what a level of pages leads to.

start() gives follow-ups (url, kind, base_url, seq, meta columns). parsed(pages) reads pages, which
carry the columns of the follow-ups they answer, once; items() and follows() look at its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.errors import ConfigError
from lodestack.functions.urls import same_site
from lodestack.operators import board, frontier, thread
from lodestack.schemas import RECORD
from lodestack.session import spread
from lodestack.sources.board_config import BoardConfig
from lodestack.sources.recorded import FixtureBundle, Recorded

_FACTORIES: dict[str, Callable] = {}


def register(name: str):
    def add(factory):
        _FACTORIES[name] = factory
        return factory

    return add


def available() -> list[str]:
    return sorted(_FACTORIES)


def get_adapter(name: str, /, **settings):
    if name not in _FACTORIES:
        raise ConfigError(f"no adapter {name!r}; there are {', '.join(available())}")
    return _FACTORIES[name](**settings)


@register("htmlboard")
class BoardAdapter:
    """Index pages, detail pages, next pages."""

    FOLLOW = f"url string, kind string, base_url string, page int, seq string, seed {RECORD}"

    def __init__(self, config: BoardConfig, compat: bool = True):
        self.config, self.name, self.compat = config, config.name, compat

    def start(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.config.start_urls[0], "list", self.config.base, 1, "", None)], self.FOLLOW)

    def parsed(self, pages: DataFrame) -> DataFrame:
        """pages with r, what they hold, and error where the parser failed; the text is no longer needed."""
        base = F.coalesce("base_url", F.lit(self.config.base))
        df = pages.withColumn("base_url", base).withColumn("r", board.parse_pages(F.col("kind"), F.col("text"), F.col("base_url"), self.config))
        return df.withColumn("error", F.col("r.error")).drop("text")

    def follows(self, parsed: DataFrame) -> DataFrame:
        """Follow-ups of index pages; seq is the order within the level: the parent's, then the place on its page, the next page last.

        All pages of a level are as many links away from their start, so that seq holds one mark for all these links.
        A depth is carried on, if there is one.
        """
        most, deep = self.config.pagination.max_pages, [(F.col("depth") + 1).alias("depth")] if "depth" in parsed.columns else []
        found = parsed.where("kind = 'list' and error is null")
        cards = found.select("base_url", "page", "seq", *deep, F.posexplode("r.details").alias("pos", "d"))
        details = cards.select("d.url", F.lit("detail").alias("kind"), "base_url", F.col("page"), F.concat("seq", F.format_string(".%08d", "pos")).alias("seq"), "d.seed", *["depth"] * len(deep))
        urls = {n: self._page_url(n) for n in range(2, most + 1)} if most else {}
        made = F.try_element_at(F.create_map(*[x for n, u in urls.items() if u for x in (F.lit(n), F.lit(u))]).cast("map<int,string>"), F.col("page") + 1) if any(urls.values()) else F.lit(None).cast("string")
        seq = F.when(F.endswith("seq", F.lit(".~")), F.col("seq")).otherwise(F.concat("seq", F.lit(".~")))
        more = found.where(F.col("page") < most) if most else found
        following = more.select(F.coalesce("r.next", made).alias("url"), F.lit("list").alias("kind"), "base_url", (F.col("page") + 1).alias("page"), seq.alias("seq"), F.lit(None).cast(RECORD).alias("seed"), *deep)
        out = following.where("url is not null")
        return details.unionByName(out) if self.config.detail else out

    def ahead(self, spark: SparkSession, fetch, max_depth: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
        """The start and the follow-ups of every index page that its links lead to, with their depth; None where only fetching tells.

        Of recorded answers all links are known, so the pages of a board are found in as many joins as
        their number has binary digits, not level by level. A page that a crawl does not queue ends its chain; that is up to the crawl.
        """
        p = self.config.pagination
        if not isinstance(fetch, Recorded) or not p.next_selector or p.page_url or p.page_query_param:
            return None
        pages = fetch.pages()
        if not pages.groupBy("key").count().where("count > 1").isEmpty():
            return None
        found = spread(pages).select("key", board.next_links(F.col("text"), F.lit(self.config.base), self.config).alias("url"))
        links = keep(found.where(F.col("url").isNotNull() & same_site(F.col("url"), F.lit(self.config.base))).select(F.col("key").alias("src"), fetch.key(F.col("url")).alias("dst")), "links")
        start = self.start(spark).withColumn("depth", F.lit(0))
        deepest = max_depth if p.max_pages is None else min(max_depth, p.max_pages - 1)
        chain = frontier.chain(links, start.select(fetch.key(F.col("url")).alias("node")), deepest, keep)
        seq = F.when(F.col("depth") == 0, "").otherwise(".~")
        asked = chain.select(F.col("node").alias("url"), F.lit("list").alias("kind"), F.lit(self.config.base).alias("base_url"), (F.col("depth") + 1).alias("page"), seq.alias("seq"), F.lit(None).cast(RECORD).alias("seed"), "depth")
        read = keep(self.parsed(spread(fetch(asked).where("status_code between 200 and 299"))), "ahead")
        return start.unionByName(self.follows(read))

    def _page_url(self, n: int) -> str | None:
        try:
            return self.config.page_url(n)
        except ConfigError:
            return None

    def items(self, parsed: DataFrame) -> DataFrame:
        """Items of detail pages, or of the index rows if the board has no detail pages."""
        ok = parsed.where("error is null")
        if not self.config.detail:
            cards = ok.where("kind = 'list'").select(F.explode("r.details").alias("d"))
            return board.build_items(cards.select("d.url", "d.seed.fields", "d.seed.lists"), self.config)
        details = ok.where("kind = 'detail'")
        merged = details.select("url", board.overlay(F.col("seed.fields"), F.col("r.record.fields")).alias("fields"), board.overlay_lists(F.col("seed.lists"), F.col("r.record.lists")).alias("lists"))
        return board.build_items(merged, self.config)


@register("fixture")
class FixtureAdapter(BoardAdapter):
    """A recorded board; unknown urls answer 404."""

    def __init__(self, spark: SparkSession, root: str):
        self.bundle = FixtureBundle(spark, root)
        super().__init__(self.bundle.config())

    def recorded(self) -> DataFrame:
        return self.bundle.pages().select("url", "text").where("text is not null")


@register("threads")
class ThreadAdapter:
    """Hiring threads of a discussion site with a JSON interface: search, thread, comment, replies."""

    FOLLOW = "url string, kind string, base_url string, stage string, thread_id long, posted_at timestamp, reply int, seq string"

    def __init__(self, search_api: str, item_base: str, web: str, name: str = "threads", threads: int = 2, hits_per_page: int = 30, query: str = "who is hiring", most_comments: int = 400, descend_replies: bool = False, include_seekers: bool = True):
        self.name, self.search_api, self.item_base, self.web = name, search_api, item_base.rstrip("/"), web
        self.threads, self.hits, self.query, self.most, self.replies, self.seekers = threads, hits_per_page, query, most_comments, descend_replies, include_seekers

    def start(self, spark: SparkSession) -> DataFrame:
        url = f"{self.search_api}?{urlencode({'query': self.query, 'tags': 'story', 'hitsPerPage': self.hits})}"
        return spark.createDataFrame([(url, "json", None, "search", None, None, 0, "")], self.FOLLOW)

    def _follow(self, df: DataFrame, stage: str, reply: str = "0") -> DataFrame:
        return df.select("url", F.lit("json").alias("kind"), F.lit(None).cast("string").alias("base_url"), F.lit(stage).alias("stage"), "thread_id", "posted_at", F.expr(reply).cast("int").alias("reply"), F.concat_ws(".", "thread_id", F.format_string("%08d", "pos")).alias("seq"))

    def parsed(self, pages: DataFrame) -> DataFrame:
        """pages with error; JSON that is none holds nothing and is no error."""
        return pages.withColumn("error", F.lit(None).cast("string"))

    def follows(self, pages: DataFrame) -> DataFrame:
        at = lambda stage: pages.where(F.col("stage") == stage)
        out = self._follow(thread.search_stage(at("search"), self.item_base, self.threads, self.seekers), "thread")
        out = out.unionByName(self._follow(thread.thread_stage(at("thread"), self.item_base, self.most), "comment", "1"))
        if self.replies:
            asked = at("comment").withColumn("depth", F.col("reply"))
            out = out.unionByName(self._follow(thread.reply_stage(asked, self.item_base, self.most), "comment", "depth"))
        return out

    def items(self, pages: DataFrame) -> DataFrame:
        return thread.comment_stage(pages.where("stage = 'comment'"), self.name, self.web)
