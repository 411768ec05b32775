"""Registered queries on tables of their own."""

import datetime as dt
import re

import pytest

from priceloom.catalog import bounds_checks, client_checks, mart, model_checks, quote_checks
from priceloom.models import trees
from priceloom.operators import clients


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of three clients in two families, in the layout of the driver's tables."""
    base, day = str(tmp_path_factory.mktemp("tables")), dt.date(1995, 3, 1)
    lines = [
        (o, n, 1 + (o + n) % 2, 1, float(5 + (7 * o + n) % 40), 1000.0 + 13 * o + 100 * n, 0.04, 0.02, "N", "O", day)
        for o in range(1, 41) for n in range(1, 6)
    ]
    for name, rows, ddl in [
        ("nation", [(0, "KENYA", 0)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        ("customer", [(c, "BUILDING", 0) for c in range(1, 4)], "c_custkey bigint, c_mktsegment string, c_nationkey bigint"),
        ("part", [(1, "P#1", "TIN", 7, 90.0), (2, "P#2", "ZINC", 9, 95.0)],
         "p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double"),
        ("orders", [(o, 1 + o % 3, "O", 500.0, day + dt.timedelta(days=o), "1-URGENT") for o in range(1, 41)],
         "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
         "l_tax double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate date"),
    ]:
        spark.createDataFrame(rows, ddl).write.parquet(f"{base}/{name}.parquet")
    return base


def test_explanations_and_narratives_name_their_drivers(spark, folder):
    explained = quote_checks.quote_explanation(spark, folder).collect()
    assert len(explained) == 200
    assert all("Main drivers from the selected explanation: log_quantity (" in r["key_insights"] for r in explained)
    told = quote_checks.quote_narrative(spark, folder).collect()
    assert len(told) == 200 and all(r["answer"] for r in told)
    assert any("log_quantity" in r["answer"] for r in told if r["intent"] == "driver")


def test_explanations_of_more_clients_than_a_broadcast_holds(spark, folder, monkeypatch):
    """The clients then meet the quotes in a shuffled join, whose salts come from rows with maps inside their structs."""
    few = quote_checks.quote_explanation(spark, folder).collect()
    join = quote_checks.join_lookup
    monkeypatch.setattr(quote_checks, "join_lookup", lambda *a, **k: join(*a, **k, broadcast_rows=0))
    many = quote_checks.quote_explanation(spark, folder).collect()
    assert sorted(map(str, many)) == sorted(map(str, few)) and len(many) == 200
    assert quote_checks.quote_narrative(spark, folder).count() == 200


@pytest.mark.parametrize("query", [
    client_checks.client_aggregate, client_checks.relative_price_index, client_checks.price_volatility,
    bounds_checks.clip_target, model_checks.fallback_median_model,
], ids=lambda q: q.__name__)
def test_rows_read_several_times_are_written_once(spark, folder, query):
    out = query(spark, folder)
    assert out.count() > 0
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_the_registered_race_has_its_full_size(spark, monkeypatch):
    asked = {}

    def race(df, key, numbers, categories, price="unit_price", settings=trees.RaceSettings()):
        asked.update(settings=settings)
        return df, {}

    monkeypatch.setattr(model_checks.W, "global_model_race", race)
    monkeypatch.setattr(model_checks, "training_rows", lambda *a: None)
    model_checks.global_model_race(spark, "")
    full = asked["settings"]
    assert (full.forest_trees, full.depth, full.boost_rounds, full.boost_depth, full.folds) == (200, 15, 300, 5, 5)


def test_models_and_quotes_read_one_written_table(spark, folder):
    for frame in quote_checks.quote_rows(spark, folder):
        assert frame.count() == 200 and not [f for f in frame.inputFiles() if "lineitem" in f]


def test_customers_meet_the_orders_before_the_lines(spark, folder):
    plan = mart.sales(spark, folder, part=True, nation=True)._jdf.queryExecution().analyzed().toString().splitlines()

    def depth(column):
        return next(re.search("Relation", line).start() for line in plan if "Relation" in line and column in line)

    assert depth("c_custkey") > depth("l_orderkey") and depth("n_nationkey") > depth("l_orderkey")


def test_the_price_level_needs_the_mean_price_alone(spark, folder):
    """The rows are written once, and an order line brings no other buffers to its client than those of the mean."""
    out = quote_checks.client_price_level(spark, folder)
    assert out.count() == 200 and not [f for f in out.inputFiles() if "lineitem" in f]
    priced = client_checks.priced_input(spark, folder)
    means = clients.client_mean_price(priced)
    assert "stddev" not in means._jdf.queryExecution().optimizedPlan().toString()
    want = {r["siren"]: r["client_avg_price_ht"] for r in clients.client_features(priced).collect()}
    got = {r["siren"]: r["client_avg_price_ht"] for r in means.collect()}
    assert got == pytest.approx(want, rel=1e-12) and len(got) == 3
