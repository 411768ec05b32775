"""Pick up new files, drop repeated content, refresh the layers, keep a run ledger.

Progress lives in the query checkpoint, so a restart continues where a lost
driver stopped; every output is keyed by the batch and overwritten on a replay.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from priceloom import schema as S
from priceloom.operators import clients

# Names the arrivals skip.
IGNORED_FILES = ["current_source.sql", "mysql_db_dump.sql"]
WHOLE_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_file_arrivals(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.sql",
    ignored: Iterable[str] = tuple(IGNORED_FILES),
    max_file_mb: int | None = None,
    files_per_batch: int = 1,
) -> DataFrame:
    """Every file as it arrives: name, size, time, ``accepted``, ``reason``; content and its MD5 of accepted ones.

    Ignored files, and oversize ones where a limit is given, stay as rows with the
    reason and without content, so dedup is for accepted ones; a path is announced once.
    Spark's file source announces no file of length 0.
    """
    files = (
        spark.readStream.schema(WHOLE_FILE).format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    reason = F.when(name.isin(list(ignored)), "ignored")
    if max_file_mb is not None:
        reason = reason.when(F.col("length") > max_file_mb * 1024 * 1024, "oversize")
    content = F.when(F.col("reason").isNull(), F.col("content"))
    return files.withColumn("reason", reason).select(
        "path", name.alias("file_name"), "length", "modificationTime", F.col("reason").isNull().alias("accepted"), "reason",
        content.alias("content"), F.md5(content).alias("content_md5"),
    )


def stream_rows(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1
) -> DataFrame:
    """Rows of arriving extracts with the file they came from."""
    rows = (
        spark.readStream.schema(schema).format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


def stream_dedup_content(
    arrivals: DataFrame, key: str = "content_md5", time_column: str | None = None, horizon: str = "7 days"
) -> DataFrame:
    """Each content once.

    With a time column the state is bounded by the horizon; without it every
    hash is remembered.
    """
    if time_column is None:
        return arrivals.dropDuplicates([key])
    return arrivals.withWatermark(time_column, horizon).dropDuplicatesWithinWatermark([key])


def _failures(spark: SparkSession, ledger: str, batch: int) -> int:
    """Failed attempts of a batch that the ledger holds."""
    try:
        runs = stream_run_metrics(spark, ledger)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0  # nothing has ended yet
    return runs.where((F.col("run_id") == str(batch)) & ~F.col("succeeded")).count()


def _recorded(spark: SparkSession, ledger: str, batch_id: int, work: Callable[[], int]) -> None:
    """Run ``work``, which returns the rows it took in, and write a ledger row; its retries are the earlier failures of the batch."""
    started, retries = time.time(), _failures(spark, ledger, batch_id)

    def write(part: str, rows: int, error: str | None) -> None:
        record = [(str(batch_id), error is None, time.time() - started, rows, retries, error)]
        frame = spark.createDataFrame(record, "run_id string, succeeded boolean, seconds double, rows bigint, retries bigint, error string")
        frame.withColumn("finished_at", F.current_timestamp()).select(*S.RUN_LEDGER.fieldNames()).write.mode("overwrite").parquet(f"{ledger}/{part}")

    try:
        rows = work()
    except Exception as exc:
        write(f"{batch_id}-failed-{retries}", 0, str(exc))
        raise
    write(str(batch_id), rows, None)


def _keep(batch: DataFrame, path: str) -> int:
    """Write a batch and return its rows, counted while they are written."""
    seen = Observation()
    batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def stream_run_metrics(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger a refreshing stream has written so far."""
    return spark.read.schema(S.RUN_LEDGER).option("recursiveFileLookup", True).parquet(ledger)


def stream_refresh_features(
    arrivals: DataFrame,
    folder: str,
    refresh: Callable[[DataFrame, str], None],
    once: bool = True,
) -> StreamingQuery:
    """Every batch joins the history, and the layers are refreshed from the whole history.

    ``refresh(history, target)`` writes the layers of one batch below
    ``target``. History and ledger parts are named after the batch, so a
    replayed batch replaces its own output.
    """
    spark = arrivals.sparkSession
    history, ledger = f"{folder}/history", f"{folder}/ledger"

    def run(batch: DataFrame, batch_id: int) -> None:
        def work() -> int:
            rows = _keep(batch, f"{history}/batch={batch_id}")
            refresh(spark.read.schema(batch.schema).parquet(history), f"{folder}/layers/{batch_id}")
            return rows

        _recorded(spark, ledger, batch_id, work)

    return _started(arrivals, run, folder, once)


def _started(arrivals: DataFrame, run: Callable[[DataFrame, int], None], folder: str, once: bool) -> StreamingQuery:
    writer = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_client_features(arrivals: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Client features and enriched orders after every batch, from the batch and the clients' moments only.

    A batch of orders is written to ``orders/batch=N``, its moments are merged with those of the
    batch before into ``moments/N``, from which ``client_features/N`` follows; the orders of the batch are
    enriched into ``enriched/batch=N`` with the features known then. No earlier order is read, so the
    work follows the batch and the number of clients; every client's features are written
    anew because their recency counts from the latest order of all. Outputs are named after the batch and made from the state of
    the batch before, so a replayed batch replaces its own output and counts nothing twice.
    Orders without ``siren`` are enriched with defaults and belong to no client.
    """
    spark = arrivals.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        def work() -> int:
            part = f"{folder}/orders/batch={batch_id}"
            rows = _keep(batch, part)
            orders = spark.read.schema(batch.schema).parquet(part)
            moments = clients.client_moments(orders)
            if batch_id > 0:
                moments = clients.merge_moments(spark.read.schema(moments.schema).parquet(f"{folder}/moments/{batch_id - 1}"), moments)
            moments.write.mode("overwrite").parquet(f"{folder}/moments/{batch_id}")
            state = spark.read.schema(moments.schema).parquet(f"{folder}/moments/{batch_id}")
            features = clients.features_of_moments(state)
            features.write.mode("overwrite").parquet(f"{folder}/client_features/{batch_id}")
            known = spark.read.schema(features.schema).parquet(f"{folder}/client_features/{batch_id}")
            clients.join_enrich_orders(orders, known).write.mode("overwrite").parquet(f"{folder}/enriched/batch={batch_id}")
            return rows

        _recorded(spark, f"{folder}/ledger", batch_id, work)

    return _started(arrivals, run, folder, once)
