"""Recorded sources: fixture bundles, url maps and JSON answers; and a recorder."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.errors import ConfigError
from lodestack.functions.urls import strip_query
from lodestack.sources.archive import build_pages
from lodestack.sources.board_config import BoardConfig

MANIFEST = "config string, notes string, pages array<struct<url:string,file:string,kind:string,base_url:string,seed:map<string,string>>>"


class FixtureBundle:
    """A folder with manifest.json, a board description and a file per page, read by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        try:
            self._manifest = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(f"{self.root}/manifest.json")
            first = self._manifest.select("config").first()
        except Exception as e:
            raise ConfigError(f"no manifest in {root}") from e
        self.config_name = (first and first["config"]) or "board.yml"
        self.overrides: dict[str, str] = {}

    def config(self) -> BoardConfig:
        import yaml

        try:
            text = self.spark.read.text(f"{self.root}/{self.config_name}", wholetext=True).first()["value"]
        except Exception as e:
            raise ConfigError(f"no board description {self.config_name} in {self.root}") from e
        return BoardConfig.from_mapping(yaml.safe_load(text))

    def override(self, url: str, markup: str) -> None:
        """Answer a url with other markup from now on."""
        self.overrides[url] = markup

    def pages(self) -> DataFrame:
        """url, kind, base_url, seed, text."""
        listed = self._manifest.select(F.explode("pages").alias("p")).select("p.url", "p.file", F.coalesce("p.kind", F.lit("list")).alias("kind"), "p.base_url", "p.seed")
        files = self.spark.read.text(self.root, wholetext=True, pathGlobFilter="*.html").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
        df = listed.join(files, "file", "left").drop("file")
        if self.overrides:
            other = self.spark.createDataFrame([*self.overrides.items()], "url string, _text string")
            df = df.join(F.broadcast(other), "url", "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
        return df


def key_of(url: Column, ignore_query: bool = False) -> Column:
    """What requests and records are compared by."""
    bare = F.substring_index(url, "#", 1)
    return strip_query(bare) if ignore_query else bare


class Recorded:
    """A fetch from recorded answers (url, text), all of which are there to look at before they are asked for."""

    def __init__(self, known: DataFrame, ignore_query: bool = False):
        self.known, self.ignore_query = known, ignore_query

    def __call__(self, requests: DataFrame) -> DataFrame:
        return answer(requests, self.known, self.ignore_query)

    def key(self, url: Column) -> Column:
        return key_of(url, self.ignore_query)

    def pages(self) -> DataFrame:
        """key, text of what answers 2xx."""
        found = self.known.where("text is not null")
        if "status_code" in found.columns:
            found = found.where("coalesce(status_code, 200) between 200 and 299")
        return found.select(self.key(F.col("url")).alias("key"), "text")


def answer(requests: DataFrame, recorded: DataFrame, ignore_query: bool = False) -> DataFrame:
    """Pages for requests (url, kind, ...) from recorded (url, text); unknown urls get a 404 with an empty body. Fragments are not part of a request.

    Columns of requests other than url and kind are kept beside those of a page.
    """
    known = recorded.select(key_of(F.col("url"), ignore_query).alias("_key"), F.col("text").alias("_text"), *([F.col("status_code").alias("_status")] if "status_code" in recorded.columns else [F.lit(200).alias("_status")]))
    df = requests.withColumn("_key", key_of(F.col("url"), ignore_query)).join(known, "_key", "left")
    df = df.withColumns({"status_code": F.when(F.col("_text").isNull(), 404).otherwise(F.coalesce("_status", F.lit(200))), "text": F.coalesce("_text", F.lit(""))})
    return df.drop("_key", "_text", "_status")


def record(pages: DataFrame, out: str, config_yaml: str, notes: str = "") -> int:
    """Write pages (url, kind, base_url, text) as a fixture bundle on the driver's disk; returns how many.

    Bundles are test inputs of a few hundred pages; rows are streamed one by one.
    """
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    listed = []
    for k, r in enumerate(pages.select("url", "kind", "base_url", "text").orderBy("url").toLocalIterator(), 1):
        name = f"page-{k:04d}.html"
        (folder / name).write_text(r["text"] or "", encoding="utf-8")
        listed.append({"url": r["url"], "file": name, "kind": r["kind"], "base_url": r["base_url"]})
    (folder / "board.yml").write_text(config_yaml, encoding="utf-8")
    (folder / "manifest.json").write_text(json.dumps({"config": "board.yml", "pages": listed, "notes": notes}, indent=2), encoding="utf-8")
    return len(listed)


class MemoryStore:
    """Keeps the newest page of each url as a DataFrame; NullStore forgets everything."""

    def __init__(self, spark: SparkSession):
        from lodestack.schemas import PAGES

        self.kept = spark.createDataFrame([], PAGES)

    def save(self, pages: DataFrame) -> None:
        every = self.kept.unionByName(build_pages(pages))
        newest = every.groupBy("url").agg(F.max_by(F.struct(*[c for c in every.columns if c != "url"]), "fetched_at").alias("_r"))
        self.kept = newest.select("url", "_r.*").select(*self.kept.columns)

    def load(self, url: str) -> DataFrame:
        return self.kept.where(F.col("url") == url).withColumn("from_snapshot", F.lit(True))

    def count(self) -> int:
        return self.kept.count()


class NullStore(MemoryStore):
    def save(self, pages: DataFrame) -> None:
        pass
