"""Writing tables, reports and the run ledger; fingerprints and text audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceloom import schema as S


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a layer as Parquet, or as gzip CSV for exchange."""
    if fmt == "csv":
        df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)
    return path


def sink_report_json(df: DataFrame, path: str) -> str:
    """Reports are small aggregates; one JSON object per line."""
    df.write.mode("overwrite").json(path)
    return path


def append_runs(runs: DataFrame, path: str) -> None:
    runs.select(*S.RUN_LEDGER.fieldNames()).write.mode("append").parquet(path)


def run_ledger(runs: DataFrame) -> DataFrame:
    """One row: runs, success rate, times, retries and the last five errors."""
    totals = runs.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if("succeeded").alias("successful_runs"),
        F.count_if(~F.col("succeeded")).alias("failed_runs"),
        F.coalesce(F.sum(F.when(F.col("succeeded"), F.col("seconds"))), F.lit(0.0)).alias("total_execution_time"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries_used"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_processed"),
    )
    last = runs.where(~F.col("succeeded")).orderBy(F.desc("finished_at"), F.desc("run_id")).limit(5)
    errors = last.agg(
        F.sort_array(F.collect_list(F.struct("finished_at", "run_id", "error", "retries"))).alias("recent")
    ).scalar()
    return totals.select(
        "*",
        (F.col("successful_runs") / F.greatest("files_processed", F.lit(1))).alias("success_rate"),
        (F.col("total_execution_time") / F.greatest("successful_runs", F.lit(1))).alias("average_execution_time"),
        errors.alias("recent_errors"),
    )


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of every file below a path (whole content; files up to 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.col("_metadata.file_name")
    return files.where(~name.startswith(".") & ~name.endswith(".tmp")).select(
        "path", "length", F.md5("content").alias("content_md5")
    )


def table_fingerprint(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Order-free fingerprint of a table: row count and the sum of row hashes."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("row_hash_sum"))


def text_pattern_audit(df: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """Add the messages of all rules the whole text breaks, and whether it is accepted."""
    rules = S.FORBIDDEN_PATTERNS if rules is None else rules
    hits = [F.when(F.rlike(F.col(text), F.lit(f"(?i){p}")), F.lit(m)) for p, m in rules.items()]
    hits.append(F.when(F.contains(F.col(text), F.lit("\x00")), F.lit("File appears to be binary")))
    return df.withColumn("violations", F.array_compact(F.array(*hits))).withColumn(
        "accepted", F.size("violations") == 0
    )


def last_errors(runs: DataFrame, per: str, k: int = 5) -> DataFrame:
    """The last ``k`` failures per value of ``per``."""
    latest = Window.partitionBy(per).orderBy(F.desc("finished_at"), F.desc("run_id"))
    return (
        runs.where(~F.col("succeeded"))
        .withColumn("recency", F.row_number().over(latest))
        .where(F.col("recency") <= k)
    )
