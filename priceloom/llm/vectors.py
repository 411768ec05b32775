"""Vector tables shared by the search operators: usable rows, query blocks, batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scale import settle

# Queries are answered in blocks of at most about this many, and of at most this many bytes of components.
BLOCK_QUERIES = 2048
BLOCK_BYTES = 16 << 20


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """A written table vec_id, v (array of doubles) of the vectors that take part, one row per vec_id.

    Null and empty vectors and those with a null or non-finite component take no part, nor
    do null ids; with ``zero`` false, zero vectors neither. A repeated id counts once, with its
    smallest vector.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & (F.lit(True) if zero else some))
    return settle(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")


def longest(vectors: DataFrame) -> int:
    return vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]


def query_blocks(vectors: DataFrame, every: int, dims: int):
    """The queries (vec_id divisible by ``every``) as (ids, matrix), one bounded block at a time."""
    queries = vectors.where(F.col("vec_id") % every == 0)
    size = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * max(dims, 1))))
    blocks = -(-queries.count() // size)
    slotted = settle(queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))), "query-blocks")
    for block in range(blocks):
        rows = slotted.where(F.col("_block") == block).select("vec_id", "v").orderBy("vec_id").toArrow()
        if rows.num_rows:
            for batch in [rows.combine_chunks().to_batches()[0]]:
                yield matrix(batch, dims)


def matrix(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of a batch (vec_id, v); shorter vectors count as zero in the components they lack."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return ids, flat.reshape(-1, dims)
    out = np.zeros((len(ids), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return ids, out
