"""Versioned tables: Parquet segments and a pointer file that lists them, so a reader sees a whole version.

An append adds a segment and rewrites nothing. A replacement of some partitions (values of the
partition column) writes those only. Either way a new list is renamed over the old one. One writer
at a time: a lock file is made exclusively and a second writer is refused. All of it goes through
Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestack.errors import LodestackError
from lodestack.schemas import conform


class Table:
    """A segment is a folder v-...; of a partitioned table the list has each partition's folder, v-.../column=value."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: str | None = None):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    # the list ----------------------------------------------------------------

    def segments(self) -> list[str]:
        """What the current version consists of."""
        if not self._fs.exists(self._at("CURRENT")):
            return []
        stream = self._fs.open(self._at("CURRENT"))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")[:-1]
        finally:
            stream.close()

    def _point(self, segments: Iterable[str]) -> None:
        fresh = self._at(f"CURRENT.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray("".join(f"{s}\n" for s in segments).encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._at("CURRENT")), options)

    def _value(self, segment: str) -> str:
        """The partition's value, as text."""
        return str(self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(segment.partition("/")[2].partition("=")[2]))

    def _write(self, df: DataFrame) -> list[str]:
        """A new segment: its entries of the list."""
        name = f"v-{uuid.uuid4().hex}"
        df = conform(df, self.schema)
        if not self.partition_by:
            df.write.parquet(f"{self.path}/{name}")
            return [name]
        # rebalance gives files of even size: small partitions are joined, hot ones are split
        df.hint("rebalance", self.partition_by).write.partitionBy(self.partition_by).parquet(f"{self.path}/{name}")
        found = (str(s.getPath().getName()) for s in self._fs.listStatus(self._at(name)))
        return sorted(f"{name}/{f}" for f in found if f.startswith(f"{self.partition_by}="))

    # reading and writing -----------------------------------------------------

    def read(self, values: Iterable[str] | None = None) -> DataFrame:
        """The current version, or its partitions of these values."""
        segments = self.segments()
        if values is not None and self.partition_by:
            wanted = set(values)
            segments = [s for s in segments if self._value(s) in wanted]
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        by: dict[str, list[str]] = {}
        for s in segments:
            by.setdefault(s.partition("/")[0] if self.partition_by else "", []).append(f"{self.path}/{s}")
        reader = lambda base: self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{base}") if base else self.spark.read.schema(self.schema)
        return reduce(DataFrame.unionByName, [conform(reader(base).parquet(*paths), self.schema) for base, paths in by.items()])

    @contextmanager
    def lock(self):
        """Refuses a second writer."""
        try:
            self._fs.create(self._at("LOCK"), False).close()
        except Exception as e:
            raise LodestackError(f"another writer holds {self.path}") from e
        try:
            yield self
        finally:
            self._fs.delete(self._at("LOCK"), False)

    def publish(self, df: DataFrame) -> None:
        """df becomes the table. Old segments stay for their readers until vacuum()."""
        self._point(self._write(df))

    def append(self, df: DataFrame) -> None:
        """df's rows come to the table; nothing is rewritten."""
        self._point(self.segments() + self._write(df))

    def replace(self, df: DataFrame, values: Iterable[str]) -> None:
        """df becomes the partitions of these values; the others stay as they are."""
        if not self.partition_by:
            raise LodestackError("only partitioned tables replace partitions")
        gone = set(values)
        fresh = self._write(df)
        self._point([s for s in self.segments() if self._value(s) not in gone] + fresh)

    def compact(self) -> None:
        """One segment in place of many."""
        self.publish(self.read())

    def vacuum(self) -> int:
        """Delete segments that the current version does not list."""
        used, gone = {s.partition("/")[0] for s in self.segments()}, 0
        for status in self._fs.listStatus(self._path(self.path)):
            name = str(status.getPath().getName())
            if name.startswith("v-") and name not in used:
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone
