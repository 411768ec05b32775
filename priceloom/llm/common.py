"""Helpers shared by the text operators: table reading, words, exact distributed ranks, packed integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.functions.scale import bounded_batches, join_lookup, settle  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# At most this many rows of one key are ranked in one task.
RANK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_slot(column: str, slots: int) -> Column:
    """crc32 of a column written as text, modulo ``slots``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % slots


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, keys: list[str], tie_break: list[str], rank: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 in the order of a hash of ``tie_break``.

    ``df`` must be a written table (it is read three times). A key may hold any
    share of the rows: it is cut into ranges of the hash of at most about
    ``RANK_ROWS`` rows, ranges are counted, and a rank is the rows before its range
    plus the place within it. The order does not depend on the number of ranges.
    Rows equal in ``tie_break`` get adjacent ranks in any order.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_u", F.shiftrightunsigned(F.xxhash64(*tie_break), 33))
    sizes = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "rank-sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    per_range = max(1, min(RANK_ROWS, total // (4 * parallelism(spark))))
    # a key with few rows has one range and needs no look-up: fewer than total / per_range keys remain
    cut = sizes.where(F.col("_n") > per_range).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.ceil(F.col("_n") / per_range).cast("long").alias("_ranges"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ranged = (
        hashed.join(cut, same, "left")
        .withColumn("_range", F.floor(F.col("_u") * F.coalesce("_ranges", F.lit(1)) / F.lit(2**31)).cast("long"))
        .drop("_ranges", *[f"_k{i}" for i in range(len(keys))])
    )
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
        (F.sum("_rows").over(_window(keys, ["_range"])) - F.col("_rows")).alias("_before"),
    )
    placed = ranged.withColumn("_place", F.row_number().over(_window([*keys, "_range"], ["_u", *tie_break])) - 1)
    return (
        placed.join(before, [*same, F.col("_range") == F.col("_r")], "left")
        .withColumn(rank, (F.col("_before") + F.col("_place")).cast("long"))
        .drop("_u", "_range", "_r", "_place", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(docs: DataFrame) -> DataFrame:
    """``_row``, ``doc`` (all columns): the rows of a table that is read straight from files, with a number each.

    The number is made of the place of the row's file among the paths and of the row's place in the
    file. It is the same in every scan, however files are dealt to tasks and whichever executors there are.
    Inside ``doc`` the columns may have any names.
    """
    where = docs.metadataColumn("_metadata")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), where.getField("file_path").alias("_file"),
        where.getField("row_index").alias("_index"),
    )
    # as many rows as files, a list that Spark's own file index holds too
    order = Window.orderBy("_file")
    files = rows.select("_file").distinct().withColumn("_number", F.row_number().over(order).cast("long"))
    return join_lookup(rows, files, ["_file"], "inner").select((F.shiftleft("_number", 40) + F.col("_index")).alias("_row"), "doc")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(written: DataFrame) -> None:
    """Remove a settled table once nothing reads it any more."""
    spark, files = written.sparkSession, written.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
