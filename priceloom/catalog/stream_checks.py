"""Streams over extracts derived from the driver tables, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.catalog import register
from priceloom.catalog.client_checks import FEATURES, ROUND_FEATURES, priced_input, rounded
from priceloom.catalog.mart import fixed, table
from priceloom.functions.scale import fresh_path
from priceloom.streaming import arrivals as A


def finished(stream, spark, label, **options):
    """Run a stream over what is there and return what it wrote."""
    path = fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, f"{label}-progress"))
        .trigger(availableNow=True).start(path, **options)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@register("stream_file_arrivals", """
SELECT o_orderstatus AS status, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def stream_file_arrivals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder = fresh_path(spark, "arrivals")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.format_string("%.2f", "o_totalprice"))
    # one extract file per range of orders, so files stay of one size as the table grows
    orders.select(line.alias("value")).write.option("maxRecordsPerFile", 100_000).text(folder)
    seen = finished(A.stream_file_arrivals(spark, folder, "*.txt", files_per_batch=4), spark, "announced")
    rows = seen.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    fields = F.split("line", ",")
    return rows.groupBy(F.get(fields, F.lit(1)).alias("status")).agg(
        F.count(F.lit(1)).alias("n_orders"), fixed(F.sum(F.get(fields, F.lit(2)).cast("double")), 2).alias("total")
    )


@register("stream_dedup_content", "SELECT DISTINCT md5(text) AS content_md5 FROM documents")
def stream_dedup_content(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "documents")
    documents.write.parquet(folder)
    rows = A.stream_rows(spark, folder, documents.schema, files_per_batch=1000).withColumns(
        {"content_md5": F.md5("text"), "arrived_at": F.current_timestamp()}
    )
    return finished(A.stream_dedup_content(rows, time_column="arrived_at"), spark, "distinct").select("content_md5")


def refreshed(spark, sf_dir):
    """Orders arrive in about two batches; every batch refreshes the client features from its own orders and the clients' moments."""
    orders = priced_input(spark, sf_dir).select("order_id", "siren", "quantity", "unit_price", "tva", "reception_date")
    source, folder = fresh_path(spark, "extracts"), fresh_path(spark, "refresh")
    orders.write.parquet(source)
    half = max(1, len(spark.read.parquet(source).inputFiles()) // 2)

    query = A.stream_client_features(A.stream_rows(spark, source, orders.schema, files_per_batch=half), folder)
    query.awaitTermination()
    return folder, query.lastProgress["batchId"]


@register("stream_refresh_features", f"WITH {FEATURES} SELECT {ROUND_FEATURES} FROM features")
def stream_refresh_features(spark, sf_dir):
    folder, last = refreshed(spark, sf_dir)
    return rounded(spark.read.parquet(f"{folder}/client_features/{last}"))


@register("stream_run_metrics", "SELECT 0 AS failed_runs, count(*) AS rows_processed FROM lineitem")
def stream_run_metrics(spark, sf_dir):
    folder, _ = refreshed(spark, sf_dir)
    return A.stream_run_metrics(spark, f"{folder}/ledger").agg(
        F.count_if(~F.col("succeeded")).alias("failed_runs"), F.sum("rows").alias("rows_processed")
    )
