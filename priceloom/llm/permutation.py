"""Permutation index: vectors as ordered lists of their nearest pivots, posted in pivot inverted files.

A vector is represented by its ``PREFIX`` nearest pivots in order of angle. For a query
the postings of its own pivots are added up, which ranks vectors by the footrule distance of
the two prefixes (absent pivots count as placed after the prefix). The best are
reranked by exact cosine.
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

# Pivots are a sample of the vectors of this size, whatever the table.
PIVOTS = 512
PREFIX = 64
# Vectors in one block of the index, and how many of a block are reranked for a query.
BLOCK_ROWS = 8192
RERANK = 768
TOP = 5
EVERY = 50


def choose_pivots(vectors: DataFrame, dims: int, pivots: int = PIVOTS) -> np.ndarray:
    """Unit pivots: the distinct vectors first in the order of a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vec_id", "v").toArrow()
    if not rows.num_rows:
        return np.zeros((0, dims))
    _, x = matrix(rows.combine_chunks().to_batches()[0], dims)
    x = np.unique(x, axis=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the smaller pivot."""
    near = x @ pivots.T
    prefix = min(prefix, len(pivots))
    few = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    few.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, few, axis=1), axis=1, kind="stable")
    return np.take_along_axis(few, order, axis=1)


def build(vectors: DataFrame, pivots: np.ndarray, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: one row per block with its ids, vectors and inverted files (starts, rows, places by pivot).

    Equal vectors of a block are posted once, with the ids that share them, so copies
    do not crowd out other vectors; ``members`` says where the ids of each begin.
    """
    schema = pa.schema([(n, pa.binary()) for n in ("ids", "members", "x", "starts", "rows", "places")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block(parts):
            ids = np.concatenate([p[0] for p in parts])
            x = np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
            by_first = np.argsort(first)
            group = np.argsort(by_first)[same.ravel()]
            order = np.argsort(group, kind="stable")
            ids, x = ids[order], x[first[by_first]]
            members = np.searchsorted(group[order], np.arange(len(x) + 1))
            perms = permutations(x, pivots)
            by_pivot = np.argsort(perms.ravel(), kind="stable")
            rows, places = np.divmod(by_pivot, perms.shape[1])
            starts = np.searchsorted(perms.ravel()[by_pivot], np.arange(len(pivots) + 1))
            data = (ids, members.astype(np.int32), x, starts.astype(np.int32), rows.astype(np.int32), places.astype(np.int16))
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], type=pa.binary()) for a in data], schema=schema)

        for batch in batches:
            ids, x = matrix(batch, dims)
            for at in range(0, len(ids), block_rows):
                part = (ids[at:at + block_rows], x[at:at + block_rows])
                if count + len(part[0]) > block_rows:
                    yield block(held)
                    held, count = [], 0
                held.append(part)
                count += len(part[0])
        if held:
            yield block(held)

    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, members binary, x binary, starts binary, rows binary, places binary")


def search(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """The ``top`` nearest that every block finds for one bounded block of queries: query_id, vec_id, score."""
    dims = queries.shape[1]
    perms = permutations(queries, pivots)
    prefix = perms.shape[1]
    query_norms = np.sqrt((queries * queries).sum(axis=1))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                ids, members, x, starts, rows, places = (
                    np.frombuffer(batch.column(c)[b].as_py(), t)
                    for c, t in enumerate((np.int64, np.int32, np.float64, np.int32, np.int32, np.int16))
                )
                n = len(members) - 1
                x = x.reshape(n, dims)
                norms = np.sqrt((x * x).sum(axis=1))
                found = []
                later = np.arange(n - 1, -1, -1, dtype=np.int64)
                for q in range(len(query_ids)):
                    shared = np.zeros(n, dtype=np.int64)
                    for i, p in enumerate(perms[q]):
                        at = slice(starts[p], starts[p + 1])
                        shared[rows[at]] += prefix - np.maximum(i, places[at])
                    # vectors stand by their smallest id, so equal distances go to the smaller id
                    ranked = shared * n + later
                    best = np.argpartition(-ranked, rerank - 1)[:rerank] if n > rerank else np.arange(n)
                    score = (x[best] * queries[q]).sum(axis=1) / (norms[best] * query_norms[q])
                    lead = np.lexsort((ids[members[best]], -score))[: top + 1]
                    ends = [ids[members[g]:min(members[g + 1], members[g] + top + 1)] for g in best[lead]]
                    near, score = np.concatenate(ends), np.repeat(score[lead], [len(e) for e in ends])
                    near, score = near[near != query_ids[q]], score[near != query_ids[q]]
                    order = np.lexsort((near, -score))[:top]
                    found.append((np.full(len(order), query_ids[q]), near[order], score[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors of every query by cosine.

    ``vectors`` has vec_id and embedding. A search reranks the ``RERANK`` nearest prefixes of
    each block, so at least those nearest over the whole table. Ties go to the smaller
    vec_id. See ``usable`` for the rows that take no part; vectors shorter than the
    longest count as zero in the rest; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, zero=False)
    dims = longest(rows)
    pivots = choose_pivots(rows, dims)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    if len(pivots):
        index = settle(build(rows, pivots, dims), "permutation-index")
        for ids, x in query_blocks(rows, every, dims):
            found = found.union(settle(search(index, ids, x, pivots, top), "found"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all."""
    return nearest(table(spark, sf_dir, "embeddings"))
