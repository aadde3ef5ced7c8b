"""Exact top-k inner products by elimination with a pivot table.

Every vector's distances to many pivots (rows of the table itself, and the origin) are computed
once and stored with it. For a query and a candidate the largest difference of their distances to
a pivot is a lower bound of their own distance d, and as the inner product is (|q|^2 + |x|^2 -
d^2) / 2, an upper bound of the score. Candidates are evaluated in the order of that bound and the
search stops once the bound is below the k-th best score found; pivots that are candidates give a
first such score. Bounds carry a margin above their rounding error, scores are exact integers, so
the result is exact.

Vectors are packed into blocks of BLOCK rows, which stay where they are: a task reads the blocks of
its partition one after the other and carries the k best of every query along, so what earlier
blocks found bounds the search of later ones. Queries are handed to the tasks in groups of
GROUP_BYTES at most; each group is one pass over the blocks. A task reports k rows for each query,
and a window keeps the k best of those; nothing else is shuffled.

Edge cases: rows without an id, with a null or empty vector, or with a null or non-finite component
take no part; vectors are compared with those of the same length only; repeated rows are candidates
each; a query id that repeats is searched once, with its smallest vector, and no row of that id is
a candidate of it, since the id is what makes a row the query's own; ties go to the smaller vec_id;
other columns are ignored; an empty table gives an empty result. Scores beyond a long are cut to
its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.shared import materialise

PIVOTS = 48
BLOCK = 4096
#: Queries that are handed to the tasks at one time, with their pivot distances.
GROUP_BYTES = 32 << 20
SCALE = 1024
#: Floating point sums of integers are exact below this.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def integers(rows: list) -> np.ndarray:
    """floor(SCALE x) as whole doubles."""
    return np.floor(np.array(rows, np.float64) * SCALE)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows with q, as int64."""
    if len(x) and np.abs(x).max() * np.abs(q).max() * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of rows to pivots and to the origin."""
    squares = (x * x).sum(axis=1)
    out = np.empty((len(x), len(pivots) + 1))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((x - p) ** 2).sum(axis=1))
    out[:, -1] = np.sqrt(squares)
    return out


class _Pivots:
    """Pivots by the length of their vectors."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.ids: dict[int, np.ndarray] = {}
        self.vectors: dict[int, np.ndarray] = {}
        for dim in {len(v) for _, v in rows}:
            self.ids[dim] = np.array([i for i, v in rows if len(v) == dim], np.int64)
            self.vectors[dim] = integers([v for _, v in rows if len(v) == dim])

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids.get(dim, np.array([], np.int64)), self.vectors.get(dim, np.empty((0, dim)))


def search(ids: np.ndarray, x: np.ndarray, table: np.ndarray, query_id: int, q: np.ndarray, row: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (ids, scores) of a block for one query, or those of them that reach least; and how many were evaluated.

    table and row are the pivot distances of the block and of the query.
    """
    far, step_of = np.zeros(len(ids)), np.empty(len(ids))
    for c, r in zip(table.T, row, strict=True):
        np.subtract(c, r, out=step_of)
        np.abs(step_of, out=step_of)
        np.maximum(far, step_of, out=far)
    squares = table[:, -1] ** 2 + row[-1] ** 2
    bound = (squares - far * far) / 2 + 1e-9 * squares + 1e-6
    todo = np.flatnonzero((ids != query_id) & ((bound >= least) if least is not None else True))
    todo = todo[np.argsort(-bound[todo], kind="stable")]
    best_ids, best, at, step = ids[:0], np.array([], np.int64), 0, 4 * k
    while at < len(todo) and (len(best) < k or bound[todo[at]] >= best[-1]):
        own = todo[at : at + step]
        best_ids, best = merged(best_ids, best, ids[own], _products(x[own], q), k)
        at, step = at + len(own), 2 * step
    return best_ids, best, at


def merged(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, best first; ties by id."""
    ids, scores = np.concatenate((ids, more_ids)), np.concatenate((scores, more))
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _pivot_rows(rows: DataFrame, n: int) -> list[tuple[int, list[float]]]:
    """n rows by a hash of their content: a bounded pick, the same in every run."""
    picked = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id", "embedding").limit(n).collect()
    return [(r["vec_id"], list(r["embedding"])) for r in picked]


def _packed(rows: DataFrame, pivots) -> DataFrame:
    """Blocks (key, dim, ids, vectors, distances) of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), BLOCK):
                    pick = own[at : at + BLOCK]
                    x = integers(flat[starts[pick][:, None] + np.arange(dim)])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array([(part << 32) + seq], pa.int64()),
                            "dim": pa.array([dim], pa.int32()),
                            "ids": pa.array([ids[pick].tobytes()], pa.binary()),
                            "vectors": pa.array([x.tobytes()], pa.binary()),
                            "distances": pa.array([_distances(x, pivots.value.of(dim)[1]).T.tobytes()], pa.binary()),
                        }
                    )
                    seq += 1

    return rows.mapInArrow(run, "key long, dim int, ids binary, vectors binary, distances binary")


class _Queries:
    """A group of queries by the length of their vectors, with their pivot distances."""

    def __init__(self, rows: list, pivots: _Pivots):
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {len(r["embedding"]) for r in rows}:
            own = [r for r in rows if len(r["embedding"]) == dim]
            x = integers([r["embedding"] for r in own])
            self.by[dim] = (np.array([r["vec_id"] for r in own], np.int64), x, _distances(x, pivots.of(dim)[1]))


def _searched(blocks: DataFrame, queries, pivots, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each task for every query of a group; evaluated: products of the query in that task, on its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                if dim not in queries.value.by:
                    continue
                q_ids, q, to = queries.value.by[dim]
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, dim)
                table = np.frombuffer(r["distances"]).reshape(-1, len(ids)).T
                pivot_ids, pivot = pivots.value.of(dim)
                if dim not in best:
                    seen = [np.sort(_products(pivot[pivot_ids != i], own)) for i, own in zip(q_ids.tolist(), q, strict=True)]
                    best[dim] = [(ids[:0], np.array([], np.int64), 0, int(s[-k]) if len(s) >= k else None) for s in seen]
                for at, (i, own, row) in enumerate(zip(q_ids.tolist(), q, to, strict=True)):
                    own_ids, scores, done, least = best[dim][at]
                    found, more, n = search(ids, x, table, i, own, row, least, k)
                    own_ids, scores = merged(own_ids, scores, found, more, k)
                    if len(scores) == k and (least is None or scores[-1] > least):
                        least = int(scores[-1])
                    best[dim][at] = own_ids, scores, done + n, least
        for dim, found in best.items():
            sizes = [len(f[0]) for f in found]
            count = np.zeros(sum(sizes), np.int64)
            starts = np.cumsum(sizes) - sizes
            for at, n, f in zip(starts.tolist(), sizes, found, strict=True):
                if n:
                    count[at] = f[2]
            columns = {"query_id": np.repeat(queries.value.by[dim][0], sizes), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found]), "evaluated": count}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns.items()})

    return blocks.select("dim", "ids", "vectors", "distances").mapInArrow(run, "query_id long, vec_id long, score long, evaluated long")


def candidates(vectors: DataFrame, is_query: Column, k: int = 10, n_pivots: int = PIVOTS) -> DataFrame:
    """What tasks report: query_id, vec_id, score, evaluated."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    pivots = spark.sparkContext.broadcast(_Pivots(_pivot_rows(rows, n_pivots)))  # n_pivots rows at most
    tasks = spark.sparkContext.defaultParallelism
    spread = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
    blocks = materialise(_packed(spread, pivots), "pivot-table", small=False)
    asked = materialise(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    size = asked.agg(F.coalesce(F.sum(8 * (F.size("embedding") + n_pivots + 2)), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    out = None
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(groups)) == g).collect()  # about GROUP_BYTES
        found = _searched(blocks, spark.sparkContext.broadcast(_Queries(some, pivots.value)), pivots, k)
        found = found if groups == 1 else materialise(found, "group")
        out = found if out is None else out.union(found)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = candidates(vectors, is_query, k, n_pivots).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
