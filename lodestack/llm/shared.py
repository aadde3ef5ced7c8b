"""Small things that the operators of this folder share."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are Python objects at one time.
ROWS = 1000
#: Rows of an Arrow batch while a stage is written: 10,000, the session's default, take 20 MB and more on both sides.
BATCH_ROWS = 1000
#: Hashes of rows that repeat are broadcast up to this number (40 bytes each before hashing).
BROADCAST_REPEATS = 200_000
#: Numbers of equal rows that are made in one step.
CHUNK = 1 << 16
#: Words are separated by exactly these characters, as bytes.split() does.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster session is refused,
    as no folder of one machine may stand in for a shared one.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = current.get() if current.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(place)
    return place


_made: list[str] = []
_lock = threading.Lock()
_writing: dict[int, list] = {}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS at most while a write runs; the session's own value comes back after the last one."""
    name, key = "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark._jsparkSession)
    with _lock:
        held = _writing.setdefault(key, [0, spark.conf.get(name, None)])
        held[0] += 1
        if not 0 < int(held[1] or 0) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writing[key]
                spark.conf.unset(name) if held[1] is None else spark.conf.set(name, held[1])


def materialise(df: DataFrame, label: str, small: bool = True) -> DataFrame:
    """Write df to a new Parquet folder in the shared place and read it back; small=False leaves Arrow batches at the session's size.

    This cuts lineage: a lost executor costs a reread of the file and no recomputation. The folder
    stays until release(), as results are read when their caller wants them.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with _small_batches(df.sparkSession) if small else nullcontext():
        df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders materialise() has made that are still there."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete what materialise() made in this process after the first since folders, but for the last keep of them; results that read them are lost."""
    own = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    gone = 0
    for place in own:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def stable(df: DataFrame, label: str) -> DataFrame:
    """df, if a task that runs again meets the same rows in the same order, which scans without a shuffle above them do; else df, written."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialise(df, label) if re.search(r"Exchange|Sample|ShuffleQueryStage", plan) else df


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark's hashes take: those without maps and variants."""
    return [f.name for f in df.schema if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]


def _text_of(name: str, kind: T.DataType, hashed: bool) -> Column:
    """A column as text that tells its values apart: the length in bytes, a colon and the value; n for null."""
    c = F.col(f"`{name}`")
    text = c.cast("string")
    if hashed and not isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.BinaryType, T.DateType)):
        text = F.concat(text, F.lit("/"), F.hex(F.xxhash64(c)))  # text alone may not tell moments apart
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of all that a row holds, as 64 hexadecimal digits."""
    known = set(hashable(df))
    return F.sha2(F.concat(F.lit(""), *[_text_of(f.name, f.dataType, f.name in known) for f in df.schema]), 256)


def numbered(df: DataFrame) -> DataFrame:
    """The rows of df as _all (struct), with _h, a hash of all they hold (binary), and _n, a number among equal rows from 1.

    So every row has a name of its own that no layout changes. Hashes are counted first, which
    shuffles nothing wider. Equal rows are folded to one with a count before anything else moves,
    and unfolded in chunks, so a row that repeats without bound meets no task as a whole. Which
    rows repeat is broadcast up to BROADCAST_REPEATS of them; with more, all rows are folded in
    one aggregation.
    """
    packed = df.select(F.unhex(row_hash(df)).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"))
    twice = materialise(packed.groupBy("_h").agg(F.count("*").alias("_c")).where("_c > 1"), "repeats")
    n = twice.count()
    if not n:
        return packed.select("_all", "_h", F.lit(1).cast("long").alias("_n"))
    if n > BROADCAST_REPEATS:
        return _unfold(packed.groupBy("_h").agg(F.first("_all").alias("_all"), F.count("*").alias("_c")))
    some = F.broadcast(twice)
    single = packed.join(some, "_h", "left_anti").select("_all", "_h", F.lit(1).cast("long").alias("_n"))
    return single.union(_unfold(packed.join(some, "_h").groupBy("_h").agg(F.first("_all").alias("_all"), F.first("_c").alias("_c"))))


def _unfold(folded: DataFrame) -> DataFrame:
    """_all, _h and _n = 1, ..., _c of rows (_h, _all, _c), by chunks that are dealt to tasks."""
    spread = folded.select("*", F.explode(F.expr(f"sequence(0L, (_c - 1) div {CHUNK})")).alias("_k")).repartition(partitions(folded.sparkSession), "_h", "_k")
    return spread.select("_all", "_h", F.explode(F.expr(f"sequence(_k * {CHUNK} + 1, least(_c, (_k + 1) * {CHUNK}))")).alias("_n"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def append_columns(df: DataFrame, fields: dict[str, str], fn: Callable[[list[str | None]], dict[str, pa.Array]], text: str = "text") -> DataFrame:
    """df with columns that fn makes of its texts, batch by batch; columns of df with these names are replaced."""
    base = df.drop(*fields)
    schema = T.StructType([*base.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in fields.items())).fields])
    at, names = base.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                made = fn(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(made[c] for c in fields)], names=names)
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % n


def shield(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names renamed, and what gives a result df's columns back, as they were."""
    taken = {c: f"_own_{k}_{c}" for k, c in enumerate(df.columns) if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed(taken), lambda out: out.select(*[F.col(taken.get(c, c)).alias(c) for c in df.columns])
