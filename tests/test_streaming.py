"""Arrivals run to completion on small folders."""

import pytest
from pyspark.sql import functions as F

from priceloom.operators import clients
from priceloom.streaming import arrivals as A


def drain(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_same_content_is_handled_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("sample.sql", "copy.sql", "current_source.sql", "note.txt"):
        (folder / name).write_text("SELECT 1;")
    (folder / "empty.sql").write_text("")
    (folder / "other.sql").write_text("SELECT 2;")
    every = A.stream_file_arrivals(spark, str(folder))
    stream = A.stream_dedup_content(every.where("accepted"))
    first = drain(stream.select("file_name", "content_md5"), tmp_path)
    assert first.count() == 2
    (folder / "late.sql").write_text("SELECT 2;")
    assert drain(A.stream_dedup_content(A.stream_file_arrivals(spark, str(folder)).where("accepted")).select("file_name", "content_md5"), tmp_path).count() == 2


def test_rejected_files_stay_as_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "fine.sql").write_text("SELECT 1;")
    (folder / "current_source.sql").write_text("SELECT 1;")
    (folder / "large.sql").write_text("x" * (2 << 20))
    stream = A.stream_file_arrivals(spark, str(folder), max_file_mb=1)
    seen = {r["file_name"]: r for r in drain(stream, tmp_path).collect()}
    assert {n: r["reason"] for n, r in seen.items()} == {"fine.sql": None, "current_source.sql": "ignored", "large.sql": "oversize"}
    assert {n: r["content"] is not None for n, r in seen.items()} == {"fine.sql": True, "current_source.sql": False, "large.sql": False}


def test_refresh_and_ledger(spark, tmp_path):
    source = tmp_path / "rows"
    spark.range(10).repartition(2).write.parquet(str(source))

    def totals(history, target):
        history.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(target)

    rows = A.stream_rows(spark, str(source), spark.range(1).schema)
    query = A.stream_refresh_features(rows, str(tmp_path / "run"), totals)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert spark.read.parquet(f"{tmp_path}/run/layers/{last}").first()["n"] == 10
    ledger = A.stream_run_metrics(spark, f"{tmp_path}/run/ledger")
    assert ledger.where("succeeded").count() == last + 1 and ledger.agg(F.sum("rows")).first()[0] == 10


def test_failure_is_recorded(spark, tmp_path):
    source = tmp_path / "rows"
    spark.range(3).coalesce(1).write.parquet(str(source))

    def broken(history, target):
        raise RuntimeError("no layers today")

    query = A.stream_refresh_features(A.stream_rows(spark, str(source), spark.range(1).schema), str(tmp_path / "run"), broken)
    with pytest.raises(Exception, match="no layers today"):
        query.awaitTermination()
    failed = A.stream_run_metrics(spark, f"{tmp_path}/run/ledger").first()
    assert not failed["succeeded"] and "no layers today" in failed["error"]


ORDERS = "order_id long, siren long, quantity double, unit_price double, tva double, reception_date date"


def orders_in_batches(spark, source, batches=3):
    """Clients of one or many orders, equal prices, missing values; one file per batch."""
    import datetime
    import random

    draw = random.Random(8)
    rows = []
    for i in range(240):
        siren = draw.choice([1, 1, 1, 2, 3, 4, None, 100 + i])
        price = 0.1 if siren == 2 else draw.choice([None, 0.0, draw.uniform(1, 90)])
        day = draw.choice([None, datetime.date(2020, 1, 1) + datetime.timedelta(days=draw.randrange(900))])
        rows.append((i, siren, draw.choice([None, -1.0, float(draw.randrange(1, 30))]), price, 0.2, day))
    for b in range(batches):
        spark.createDataFrame(rows[b::batches], ORDERS).coalesce(1).write.mode("append").parquet(source)
    return spark.read.parquet(source)


def rounded(features):
    return sorted(
        ({k: round(v, 8) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in features.collect()), key=lambda r: r["siren"]
    )


def test_batches_of_orders_equal_the_whole(spark, tmp_path):
    source, folder = str(tmp_path / "orders"), str(tmp_path / "run")
    whole = orders_in_batches(spark, source)
    query = A.stream_client_features(A.stream_rows(spark, source, whole.schema), folder)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last == 2
    want = clients.client_features(whole)
    got = spark.read.parquet(f"{folder}/client_features/{last}")
    assert rounded(got.select(*want.columns)) == rounded(want)
    enriched = spark.read.parquet(f"{folder}/enriched")
    assert enriched.count() == 240 and enriched.where("siren is null").where("client_nb_orders <> 0").count() == 0
    ledger = A.stream_run_metrics(spark, f"{folder}/ledger")
    assert ledger.agg(F.sum("rows"), F.sum("retries")).first()[:] == (240, 0)


def test_a_batch_reads_no_earlier_orders(spark, tmp_path):
    """The orders of former batches may go: later batches and replays need the moments only."""
    source, folder = str(tmp_path / "orders"), str(tmp_path / "run")
    whole = orders_in_batches(spark, source, 2)
    first = clients.client_moments(whole.where("order_id % 2 = 0"))
    first.write.parquet(folder)
    merged = clients.merge_moments(spark.read.parquet(folder), clients.client_moments(whole.where("order_id % 2 = 1")))
    merged.write.parquet(folder + "-merged")
    state = spark.read.parquet(folder + "-merged")
    assert rounded(clients.features_of_moments(state)) == rounded(clients.client_features(whole).select(*clients.features_of_moments(state).columns))
    nothing = clients.client_moments(whole.limit(0))
    assert rounded(clients.merge_moments(state, nothing)) == rounded(state) == rounded(clients.merge_moments(nothing, state))


def test_a_retried_batch_counts_its_retries(spark, tmp_path):
    source, folder = tmp_path / "rows", str(tmp_path / "run")
    spark.range(5).coalesce(1).write.parquet(str(source))
    failing = [True, True, False]

    def refresh(history, target):
        if failing.pop(0):
            raise RuntimeError("no layers yet")
        history.write.mode("overwrite").parquet(target)

    for _ in range(2):
        with pytest.raises(Exception, match="no layers yet"):
            A.stream_refresh_features(A.stream_rows(spark, str(source), spark.range(1).schema), folder, refresh).awaitTermination()
    A.stream_refresh_features(A.stream_rows(spark, str(source), spark.range(1).schema), folder, refresh).awaitTermination()
    ledger = A.stream_run_metrics(spark, f"{folder}/ledger")
    assert sorted((r["succeeded"], r["retries"], r["rows"]) for r in ledger.collect()) == [(False, 0, 0), (False, 1, 0), (True, 2, 5)]
    assert spark.read.parquet(f"{folder}/layers/0").count() == 5


def test_the_memory_of_contents_is_bounded(spark, tmp_path):
    """Hashes older than the horizon leave the state; a content that comes back later is new again."""
    source = tmp_path / "in"
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    kept = []
    for day in range(1, 7):
        spark.sql(f"SELECT md5('{day % 3}') AS content_md5, timestamp'2024-01-0{day} 00:00:00' AS at").coalesce(1).write.mode("append").parquet(str(source))
        rows = A.stream_rows(spark, str(source), spark.read.parquet(str(source)).schema)
        query = A.stream_dedup_content(rows, time_column="at", horizon="1 days").writeStream.format("parquet").option(
            "checkpointLocation", progress
        ).trigger(availableNow=True).start(out)
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(kept) <= 3 and spark.read.parquet(out).count() == 6
