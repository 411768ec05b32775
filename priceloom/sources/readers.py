"""Reading extracts and relations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom import schema as S


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files under a path with their sizes; raises when the path is missing."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise FileNotFoundError(f"File not found: {path}")
    found, listing = [], fs.listFiles(target, True)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen()))
    return found


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema; a missing path is an error."""
    _files(spark, path)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def scan_validated(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    max_file_mb: int | None = None,
) -> DataFrame:
    """Read by file type; reject missing, empty, unknown and, with a limit, oversize inputs."""
    files = _files(spark, path)
    if not files or not any(size for _, size in files):
        raise ValueError(f"Empty file: {path}")
    for name, size in files:
        if max_file_mb is not None and size > max_file_mb * 1024 * 1024:
            raise ValueError(f"File too large: {size / 1024 / 1024:.2f} MB > {max_file_mb} MB ({name})")
    kinds = {PurePosixPath(name.removesuffix(".gz")).suffix.lower() for name, _ in files}
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kinds == {".parquet"}:
        df = reader.parquet(path)
    elif kinds == {".csv"}:
        df = reader.option("header", True).csv(path)
    elif kinds == {".json"}:
        df = reader.json(path)
    else:
        raise ValueError(f"Unsupported file format: {sorted(kinds)}")
    if df.isEmpty():
        raise ValueError(f"Empty file: {path}")
    return df


def scan_relations(
    spark: SparkSession,
    locations: Mapping[str, str],
    mandatory: Iterable[str] = tuple(S.MANDATORY_RELATIONS),
    jdbc: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Open the source relations; fail when a mandatory one has no location.

    With ``jdbc`` options the locations are table names of that database.
    """
    missing = sorted(set(mandatory) - set(locations))
    if missing:
        raise ValueError(f"Missing mandatory relations: {missing}")
    if jdbc:
        return {
            name: spark.read.format("jdbc").options(**jdbc).option("dbtable", table).load()
            for name, table in locations.items()
        }
    return {name: spark.read.parquet(path) for name, path in locations.items()}


def scan_dumps_with_provenance(
    spark: SparkSession, paths: list[str], schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read extracts in one scan; every row knows its source, file and rank.

    ``source_rank`` follows the order of ``paths`` (an earlier extract wins a
    later keep-first). Extracts without rows vanish by themselves.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    roots = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        roots.append(place.getFileSystem(conf).makeQualified(place).toUri().getPath())
    df = spark.read.schema(schema).format(fmt).option("recursiveFileLookup", True).load(list(paths))
    file = F.col("_metadata.file_path")
    # the path of a file without its scheme and host, as the roots are
    inside = F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    rank = F.lit(None).cast("int")
    # the longest root that holds the file, so that nested extracts keep their rows
    for i in sorted(range(len(roots)), key=lambda i: (len(roots[i]), -i)):
        held = F.startswith(inside, F.lit(roots[i].rstrip("/") + "/")) | (inside == roots[i])
        rank = F.when(held, F.lit(i)).otherwise(rank)
    names = F.array(*[F.lit(PurePosixPath(p.rstrip("/")).name) for p in paths])
    return df.select("*", F.get(names, rank).alias("source"), file.alias("source_file"), rank.alias("source_rank"))


def rows_per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "source_rank").agg(F.count(F.lit(1)).alias("n_rows"))


def require_columns(df: DataFrame, required: Iterable[str] = tuple(S.REQUIRED_CLEAN)) -> DataFrame:
    """Pass the frame through, or fail naming the missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def scan_client_features(spark: SparkSession, path: str) -> DataFrame:
    """Saved client features, or an empty frame of the same shape."""
    try:
        files = _files(spark, path)
    except FileNotFoundError:
        files = []
    if not files:
        return spark.createDataFrame([], S.CLIENT_FEATURES)
    return spark.read.schema(S.CLIENT_FEATURES).parquet(path)
