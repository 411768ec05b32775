"""Exact top-k by inner product with a three-phase uniform threshold.

The components of the vectors are cut into lists; the score is the sum of the local
scores of all lists. Phase 1 gathers the best local scores of every list; the full scores of
those vectors bound the k-th best score from below. Phase 2 sends the cutoff (that bound over
the number of lists) to every list and gathers all entries that reach it: what reaches it
nowhere cannot be among the best. Phase 3 resolves the candidates that are
left exactly. Local scores are counted from the lowest of their list, so none is negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import bounded_batches, table
from priceloom.llm.vectors import longest, matrix, query_blocks, usable

LISTS = 2
SCALE = 1024
# Phase 1 gathers this many times as many entries from a list as are asked for.
DEPTH = 4
TOP = 10
EVERY = 100
# Scores are exact up to this size.
LARGEST = 2**60
_ROWS = 1024
_ENTRY = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("vec_id", pa.int64()), ("local", pa.int64())])
_ENTRY_DDL = "query_id long, list int, vec_id long, local long"


def whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers: floor(1024 x)."""
    return np.floor(SCALE * x)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: by doubles where all sums stay exact, else by Python integers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if bound < 2**53:
        return np.rint(q @ x.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in q], dtype=object) @ np.array([[int(c) for c in r] for r in x], dtype=object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def _entries(vectors: DataFrame, column: int, ids: np.ndarray, q: np.ndarray, emit) -> DataFrame:
    """Entries of one list that ``emit(state, local, vec_ids)`` keeps, batch by batch, and at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = emit()
        for batch in batches:
            vec_ids, x = matrix(batch, q.shape[1])
            for at in range(0, len(vec_ids), _ROWS):
                part = vec_ids[at:at + _ROWS]
                local = products(q, whole(x[at:at + _ROWS]))
                yield from keep.add(local, part)
        yield from keep.end()

    return vectors.mapInArrow(run, _ENTRY_DDL)


def _batch(query_ids, column, vec_ids, local) -> pa.RecordBatch:
    n = len(query_ids)
    return pa.RecordBatch.from_arrays([
        pa.array(query_ids), pa.array(np.full(n, column, dtype=np.int32)), pa.array(vec_ids), pa.array(local)], schema=_ENTRY)


class _Best:
    """Phase 1: the ``top`` best entries of each query, and the lowest local score as vec_id null."""

    def __init__(self, ids, column, top):
        self.ids, self.column, self.top = ids, column, top
        self.local = np.zeros((len(ids), 0), dtype=np.int64)
        self.vec = np.zeros((len(ids), 0), dtype=np.int64)
        self.low = np.full(len(ids), np.iinfo(np.int64).max)

    def add(self, local, vec_ids):
        own = vec_ids[None, :] == self.ids[:, None]
        self.low = np.minimum(self.low, local.min(axis=1))
        local = np.where(own, np.iinfo(np.int64).min, local)
        self.local = np.concatenate([self.local, local], axis=1)
        self.vec = np.concatenate([self.vec, np.broadcast_to(vec_ids, local.shape)], axis=1)
        if self.local.shape[1] > self.top:
            at = np.argpartition(-self.local, self.top - 1, axis=1)[:, : self.top]
            self.local, self.vec = np.take_along_axis(self.local, at, 1), np.take_along_axis(self.vec, at, 1)
        return iter(())

    def end(self):
        if self.local.shape[1]:
            real = self.local != np.iinfo(np.int64).min
            rows = np.repeat(self.ids, real.sum(axis=1))
            yield _batch(rows, self.column, self.vec[real], self.local[real])
            n = len(self.ids)
            low = pa.RecordBatch.from_arrays([
                pa.array(self.ids), pa.array(np.full(n, self.column, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.array(self.low)], schema=_ENTRY)
            yield low


class _Reaching:
    """Phase 2: every entry that reaches its query's cutoff in this list."""

    def __init__(self, ids, column, cut):
        self.ids, self.column, self.cut = ids, column, cut

    def add(self, local, vec_ids):
        hit = (local >= self.cut[:, None]) & (vec_ids[None, :] != self.ids[:, None])
        q, v = np.nonzero(hit)
        if len(q):
            yield _batch(self.ids[q], self.column, vec_ids[v], local[hit])

    def end(self):
        return iter(())


def _kth(scores: DataFrame, value: str, k: int) -> DataFrame:
    """The k-th largest value of each query that has k."""
    order = Window.partitionBy("query_id").orderBy(F.col(value).desc())
    return scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("query_id").agg(
        F.max("_r").alias("_n"), F.min(value).alias("bound")
    ).where(F.col("_n") == k).drop("_n")


def _resolve(pairs: DataFrame, vectors: DataFrame, ids: np.ndarray, q: np.ndarray) -> DataFrame:
    """Full scores of the ``pairs`` (query_id, vec_id)."""
    place = {v: n for n, v in enumerate(ids.tolist())}
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_ids, x = matrix(pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["vec_id", "v"]), q.shape[1])
            rows = [place[v] for v in batch.column(0).to_pylist()]
            x = whole(x)
            score = np.array([products(q[r:r + 1], x[n:n + 1])[0, 0] for n, r in enumerate(rows)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec_ids), pa.array(score)], schema=schema)

    return pairs.join(vectors, "vec_id").select("query_id", "vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def best_of_block(vectors: DataFrame, slices: list[DataFrame], bounds: list[tuple[int, int]], ids: np.ndarray, q: np.ndarray, top: int) -> DataFrame:
    """Candidates with their full scores that hold the exact ``top`` of one bounded block of queries: query_id, vec_id, score."""
    spark, lists = vectors.sparkSession, len(slices)
    parts = [q[:, a:b] for a, b in bounds]
    depth = DEPTH * top
    first = settle(_union([_entries(s, i, ids, parts[i], lambda i=i: _Best(ids, i, depth)) for i, s in enumerate(slices)]), "phase1")
    order = Window.partitionBy("query_id", "list").orderBy(F.col("local").desc(), "vec_id")
    leading = first.where("vec_id is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= depth)
    low = first.where("vec_id is null").groupBy("query_id", "list").agg(F.min("local").alias("low"))
    known = settle(_resolve(leading.select("query_id", "vec_id").distinct(), vectors, ids, q), "phase1-scores")
    # one row per query of the block, and per list
    position = {v: n for n, v in enumerate(ids.tolist())}
    lowest = np.zeros((lists, len(ids)), dtype=np.int64)
    for r in low.collect():
        lowest[r["list"], position[r["query_id"]]] = r["low"]
    bound = np.zeros(len(ids), dtype=np.int64)
    for r in _kth(known, "score", top).collect():
        at = position[r["query_id"]]
        bound[at] = max(r["bound"] - int(lowest[:, at].sum()), 0)
    share = -(-bound // lists)
    second = _union([_entries(s, i, ids, parts[i], lambda i=i: _Reaching(ids, i, lowest[i] + share)) for i, s in enumerate(slices)])
    per_query = spark.createDataFrame(
        [(int(v), int(share[n]), int(bound[n]), [int(x) for x in lowest[:, n]]) for n, v in enumerate(ids.tolist())],
        "_q long, share long, bound long, lows array<long>",
    )
    # an unseen local score is below the share, so the sum of all cannot exceed this
    most = F.col("known") + (lists - F.col("lists")) * F.col("share")
    hopeful = second.join(F.broadcast(per_query), F.col("query_id") == F.col("_q")).groupBy("query_id", "vec_id").agg(
        F.sum(F.col("local") - F.get("lows", F.col("list"))).alias("known"), F.count(F.lit(1)).alias("lists"),
        F.first("share").alias("share"), F.first("bound").alias("bound"),
    ).where(most >= F.col("bound")).select("query_id", "vec_id")
    return _resolve(hopeful, vectors, ids, q)


def top_k(vectors: DataFrame, every: int = EVERY, top: int = TOP, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the exact best of every query by integer inner product.

    ``vectors`` has vec_id and embedding. Ties go to the smaller vec_id. See ``usable`` for rows that
    take no part; vectors shorter than the longest count as zero in the rest; tables with
    fewer candidates return them all; an empty table gives no rows; other columns are not read. Scores are exact up to 2^60.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors)
    dims = longest(rows)
    edges = np.linspace(0, dims, min(lists, max(dims, 1)) + 1).astype(int).tolist()
    bounds = list(zip(edges, edges[1:]))
    slices = [rows.select("vec_id", F.slice("v", a + 1, b - a).alias("v")) for a, b in bounds]
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for ids, x in query_blocks(rows, every, dims):
        found = found.union(settle(best_of_block(rows, slices, bounds, ids, whole(x), top), "resolved"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of every 100th vector among all."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
