"""Row numbers stay the same when tables are read in other pieces; stages keep columns of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.llm import common, mixing, order_minhash, registry, substrings

WORDS = [f"w{i}" for i in range(3000)]
CLASHES = ["copies", "_row", "_spans", "_keep", "_of", "_copy", "_text", "doc", "_file", "_copies", "root", "a"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files; every text has a near copy in another file."""
    rng = np.random.default_rng(8)
    texts = [[WORDS[i] for i in rng.integers(0, len(WORDS), 40)] for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, " ".join(t)))
        rows.append((1000 + i, " ".join([*t[:20], "changed", *t[21:]])))
    path = str(tmp_path_factory.mktemp("rows") / "documents.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in CLASHES})
    full = df.withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    full.repartition(3, "doc_id").sortWithinPartitions(F.xxhash64("doc_id")).write.parquet(path)
    return path


def read(spark, folder, pieces):
    spark.conf.set("spark.sql.files.minPartitionNum", pieces)
    try:
        df = spark.read.parquet(folder)
        assert df.rdd.getNumPartitions() >= pieces
        return {r["_row"]: r["i"] for r in common.numbered(df).select("_row", F.col("doc.doc_id").alias("i")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_numbers_do_not_depend_on_the_pieces(spark, folder):
    one, many = read(spark, folder, 1), read(spark, folder, 3)
    assert one == many and len(one) == 120


def test_near_copies_when_the_pieces_change_between_scans(spark, folder, monkeypatch):
    scans = iter([4, 1, 3, 2] * 50)
    settle = order_minhash.settle

    def other_pieces(df, label):
        spark.conf.set("spark.sql.files.minPartitionNum", next(scans))
        return settle(df, label)

    monkeypatch.setattr(order_minhash, "settle", other_pieces)
    try:
        got = order_minhash.near_copies(spark.read.parquet(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert {r["doc_id"]: r["class_id"] for r in got} == {r["doc_id"]: r["doc_id"] % 1000 for r in got} and len(got) == 120


@pytest.mark.parametrize("stage", [order_minhash.stage, substrings.stage, mixing.stage])
def test_stages_keep_clashing_columns(spark, folder, stage):
    docs = spark.read.parquet(folder)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)


def test_classes_merge_over_rounds(spark, tmp_path, monkeypatch):
    """A group whose members are often too far from the leader, in rounds of one pair of two classes at a time."""
    monkeypatch.setattr(order_minhash, "FIRST_PAIRS", 1)
    monkeypatch.setattr(order_minhash, "MORE_PAIRS", 2)
    rng = np.random.default_rng(1)
    base = [WORDS[i] for i in rng.integers(0, len(WORDS), 100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        t = list(base)
        for k in rng.choice(100, 14, replace=False):
            t[k] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = order_minhash.near_copies(spark.read.parquet(path)).collect()
    assert {r["class_id"] for r in got} == {0}


def test_texts_of_a_bucket_that_stay_apart_give_no_rows(spark, tmp_path, monkeypatch):
    """The same words in other orders: every two texts share sketches and all bits, and no two are near copies."""
    monkeypatch.setattr(order_minhash, "TILE", 16)
    rng = np.random.default_rng(4)
    parts = [[f"w{i}x{j}" for j in range(20)] for i in range(10)]
    texts = [sum((parts[i] for i in rng.permutation(10)), []) for _ in range(50)]
    near = list(texts[7])
    near[3] = "changed"
    texts.append(near)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
    written, settle = [], order_minhash.settle

    def counting(df, label="settled"):
        out = settle(df, label)
        if label == "further-pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "settle", counting)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_copies(spark.read.parquet(path)).collect()}
    assert got == {i: i for i in range(50)} | {50: 7}
    assert written and sum(written) < len(texts)


def test_sql_checks_of_the_text_queries():
    assert {"op3_seekable_warc", "op7_uniform_threshold", "op11_value_dictionaries", "op12_permuterm_variants"} == set(registry.CHECKS)
    assert all(isinstance(sql, str) for sql in registry.CHECKS.values())
