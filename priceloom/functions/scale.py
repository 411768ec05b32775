"""Materialisation and skew-safe joins.

``settle`` writes a frame to the shared checkpoint folder and reads it back, so
that a plan which uses it several times neither rescans its inputs nor depends
on executors staying alive. ``join_lookup`` adds columns of a keyed table to a
fact frame: the table is broadcast only when its measured row count is small;
beyond that the join is shuffled, with hot keys spread over salts.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup of at most this many rows and written bytes may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
# A key holding more than 1/HOT_SHARE of the rows is hot; there are fewer than
# HOT_SHARE such keys, whatever the data.
HOT_SHARE = 1_000
# A piece of a hot key has about this many rows at most.
PIECE_ROWS = 1_000_000
# Rows without a key match nothing and are spread over this many salts.
NULL_PIECES = 4_096

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder in local mode when unset."""
    folder = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CHECKPOINT_CONF} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="priceloom-")
    spark.conf.set(_CHECKPOINT_CONF, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bound the bytes of a batch sent to Python, so that very long rows do not pile up; a set bound is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, str(limit))


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores by ``keys`` if the table it comes from (``source``, a plain read) has fewer pieces than that.

    A small table in one row group is otherwise worked on by one task, whatever follows. Large tables have more pieces than
    there are cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if source.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def written_bytes(df: DataFrame) -> int:
    """Spark's size of the plan: the bytes of the files where it reads a written table."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes a type: no maps and variants, at any depth."""
    if isinstance(kind, T.StructType):
        return all(_hashable(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{field.name}`") for field in df.schema.fields if _hashable(field.dataType)])


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys above 1/HOT_SHARE of the rows with the number of pieces to cut each into."""
    counts = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") * HOT_SHARE > total).select(
        *keys, F.ceil(F.greatest(F.col("_n") * HOT_SHARE / total, F.col("_n") / PIECE_ROWS)).cast("int").alias("_pieces")
    )


def join_salted(fact: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Shuffled equi-join in which every hot key of ``fact`` is spread over salts."""
    # fewer than HOT_SHARE rows by construction, hence the broadcast
    hot = F.broadcast(settle(hot_keys(fact, keys), "hot-keys"))
    left = fact.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.pmod(_row_hash(fact), F.lit(NULL_PIECES)).cast("int"))
        .when(F.col("_pieces").isNull(), F.lit(0)).otherwise(
            F.pmod(_row_hash(fact), F.col("_pieces")).cast("int")
        ),
    )
    right = (
        lookup.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return left.drop("_pieces").join(right, [*keys, "_salt"], how).drop("_salt")


def join_lookup(
    fact: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    settled_rows: int | None = None,
) -> DataFrame:
    """Join ``fact`` with ``lookup``, which has one row per key.

    ``lookup`` is settled and counted first, so that neither the size check nor
    the join computes it twice. A caller that reads a written table passes its
    row count instead. Wide rows are held against a limit in bytes.
    """
    table, rows = lookup, settled_rows
    if rows is None:
        table = settle(lookup, "lookup")
        rows = table.count()
    if rows <= broadcast_rows and written_bytes(table) <= BROADCAST_BYTES:
        return fact.join(F.broadcast(table), keys, how)
    return join_salted(fact, table, keys, how)
