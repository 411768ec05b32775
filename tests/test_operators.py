"""Operators on literal rows, including the odd cases of the rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from priceloom import schema as S
from priceloom.operators import bounds as B
from priceloom.operators import cleaning as K
from priceloom.operators import clients as C
from priceloom.operators import consolidate as M
from priceloom.operators import dialogue as D
from priceloom.operators import formulas as L
from priceloom.operators import quality as Q
from priceloom.operators import quotes as T
from priceloom.operators import ranking as R
from priceloom.operators import requests as P
from priceloom.operators import scenarios as X
from priceloom.operators import texts as N
from priceloom.plans.mart import build_mart, refresh
from priceloom.sources import readers
from priceloom.sources import sinks


def test_client_aggregate_mixed_dates(spark):
    rows = [("A", 10.0, 100, 1.0, 1.0, "2026-01-02"), ("A", 12.0, 120, 1.2, 1.1, None), ("B", 20.0, 90, 0.5, 0.9, "2026-03-14")]
    df = spark.createDataFrame(rows, "siren string, unit_price_ht double, quantity bigint, price_volatility double, relative_price_index double, reception_date string")
    out = {r["siren"]: r for r in C.client_aggregate(df).collect()}
    assert set(out) == {"A", "B"}
    assert out["A"]["client_first_order"] == dt.date(2026, 1, 2)
    assert out["A"]["client_nb_orders"] == 2 and out["A"]["client_avg_price_ht"] == 11.0


def orders(spark):
    rows = [("few", 10.0 + i, 5.0) for i in range(7)]
    rows += [("flat", 10.0, float(i + 1)) for i in range(8)]
    rows += [("narrow", 100.0 + i * 0.5, float(i + 1)) for i in range(8)]
    rows += [("curve", float(p), 1000.0 * p**-1.5) for p in range(1, 9)]
    rows += [("zero", 0.0, 3.0), ("single", 7.0, 2.0), (None, 5.0, 5.0)]
    return spark.createDataFrame(rows, "siren string, unit_price double, quantity double").withColumn(
        "reception_date", F.lit("2024-01-05").cast("date")
    )


def test_elasticity_status_codes(spark):
    rows = orders(spark).withColumnRenamed("unit_price", "unit_price_ht")
    out = {r["siren"]: r for r in C.client_elasticity(rows).collect()}
    assert out["few"]["elasticity_status"] == "insufficient_samples_7"
    assert out["flat"]["elasticity_status"] == "zero_variance"
    assert out["narrow"]["elasticity_status"].startswith("low_price_variation_0.0")
    assert out["curve"]["elasticity_code"] == "success"
    assert math.isclose(out["curve"]["client_price_elasticity"], -1.5, rel_tol=1e-9)
    assert math.isclose(out["curve"]["elasticity_r2"], 1.0, rel_tol=1e-9)
    assert None not in out and "zero" not in out


def test_single_pass_features_equal_the_steps(spark):
    rows = C.client_indicators(C.price_ht(orders(spark)))
    steps = C.join_client_elasticity(C.client_recency_seniority(C.client_aggregate(rows)), C.client_elasticity(rows))
    names = S.CLIENT_FEATURES.fieldNames()
    a = {r["siren"]: r for r in C.client_features(orders(spark)).select(*names).collect()}
    b = {r["siren"]: r for r in steps.select(*names).collect()}
    assert set(a) == set(b) and None not in a
    for siren in a:
        for name in names[1:]:
            x, y = a[siren][name], b[siren][name]
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (siren, name, x, y)


def test_relative_index_averages_to_one(spark):
    rows = C.relative_price_index(C.price_ht(orders(spark)).where("siren is not null"))
    for r in rows.groupBy("siren").agg(F.avg("relative_price_index").alias("m")).collect():
        assert math.isclose(r["m"], 1.0, rel_tol=1e-9)


def test_enrich_fills_by_type(spark):
    features = spark.createDataFrame([("A", 0.2, "success", dt.date(2024, 1, 1))], "siren string, e double, s string, d date")
    out = {r["siren"]: r for r in C.join_enrich_orders(spark.createDataFrame([("A",), ("Z",)], "siren string"), features).collect()}
    assert (out["Z"]["e"], out["Z"]["s"], out["Z"]["d"]) == (0.0, "none", None)
    assert out["A"]["e"] == 0.2


def test_cleaning_order_of_rules(spark):
    rows = [(" saddle stitch ", "none", "YES", "HIGH**"), (None, "White/White", " isbn-st", "nan"), ("card", "", "<na>", "low")]
    df = spark.createDataFrame(rows, "binding_type string, head_and_tail string, label_type string, priority_level string")
    out = [tuple(r) for r in K.map_values(K.str_trim_upper(df)).collect()]
    assert out == [
        ("SS", "MISSING", "STANDARD", "HIGH2"), ("MISSING", "WHITE", "ISBN", "MISSING"), ("CARD", "MISSING", "MISSING", "LOW"),
    ]


def test_flags_with_and_without_tokens(spark):
    df = spark.createDataFrame([("NONE",), (None,), ("METAL",)], "coil_type string")
    loose = [r["has_coil"] for r in K.flag_any_present(df, {"has_coil": ["coil_type"]}).collect()]
    strict = [r["has_coil"] for r in K.flag_any_present(df, {"has_coil": ["coil_type"]}, ["NONE"]).collect()]
    assert loose == [1, 0, 1] and strict == [0, 0, 1]


def test_mode_imputation_counts_missing_by_default(spark):
    rows = [("SS", "MISSING"), ("SS", "MISSING"), ("SS", "A"), ("PB", "MISSING")]
    df = spark.createDataFrame(rows, "binding_type string, cover_size string")
    assert sorted(r[1] for r in K.mode_impute_in_group(df).collect()) == ["A", "MISSING", "MISSING", "MISSING"]
    assert sorted(r[1] for r in K.mode_impute_in_group(df, ignore_tokens=["MISSING"]).collect()) == ["A", "A", "A", "MISSING"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "a", None, None), (1, "b", None, 1)], "c int, v string, n string, half int")
    assert K.constant_columns(df) == ["c", "n"]


def test_empty_target_is_an_error(spark):
    with pytest.raises(ValueError):
        K.filter_training_target(spark.createDataFrame([(0.5,), (0.1,)], "unit_price double"))


def test_dedup_collapses_null_keys(spark):
    rows = [(None, None, 1), (None, None, 2), ("1", "2", 3), ("1", "2", 0), ("1", None, 9)]
    df = spark.createDataFrame(rows, "order_id string, part_id string, o int")
    once = M.dedup_keep_first(df, ["order_id", "part_id"], [F.col("o")])
    found = {(r[0], r[1]): r[2] for r in once.collect()}
    assert found == {("MISSING_order_id", "MISSING_part_id"): 1, ("1", "2"): 0, ("1", "MISSING_part_id"): 9}
    assert M.dedup_keep_first(once, ["order_id", "part_id"], [F.col("o")]).count() == 3
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def relations(spark):
    frame = spark.createDataFrame
    empty = lambda names: frame([], ", ".join(f"{n} string" for n in ["part_id"] + names) + ", active int")
    return {
        "production_parts": frame(
            [("PZ12", 1, 0, "SS"), ("13", 1, 0, "SS"), ("14", 1, 1, "SS"), ("15", 2, 0, "PB"), ("16", 3, 0, "PB")],
            "part_id string, order_id bigint, split int, binding_type string",
        ).withColumn("line_no", F.lit(1)).withColumn("unit_price", F.lit(2.5)),
        "orders": frame([(1, 7, 100, "2024-03-05"), (2, 8, 50, None), (3, 8, 10, "x")], "order_id bigint, client_id bigint, quantity bigint, reception_date string"),
        "clients": frame([(7, "Seven", "S7", 20.0), (8, "Eight", "S8", 5.5)], "client_id bigint, name string, siren string, tva double"),
        "part_coils": frame([("12", "METAL", 1), ("13", "PLASTIC", 0), ("15", "METAL", 1), ("15", "WIRE", 1)], "part_id string, coil_type string, active int"),
        "part_covers": empty(["cover_paper_type", "double_sided_cover", "cover_color", "head_and_tail", "cover_size"]),
        "kits": frame([(3, 1), (1, 0)], "order_id bigint, active int"),
    }


def test_mart_from_relations(spark):
    mart = {r["part_id"]: r for r in build_mart(relations(spark), precedence=["line_no", "coil_type"]).collect()}
    assert set(mart) == {"PZ12", "13", "15"}
    assert mart["PZ12"]["coil_type"] == "METAL" and mart["13"]["coil_type"] == "NONE"
    assert mart["15"]["coil_type"] == "METAL"  # the fan-out is deduplicated in the given order
    assert mart["13"]["siren"] == "S7" and mart["13"]["client_name"] == "Seven"
    assert mart["13"]["tab_size"] == -1 or mart["13"]["tab_size"] == 0


def test_layers_are_written(spark, tmp_path):
    paths = refresh(build_mart(relations(spark), precedence=["line_no", "coil_type"]), str(tmp_path / "layers"))
    features = {r["siren"]: r for r in readers.scan_client_features(spark, paths["client_features"]).collect()}
    assert set(features) == {"S7", "S8"}
    assert features["S7"]["client_last_order"] == dt.date(2024, 3, 5) and features["S7"]["client_recency_days"] == 0
    assert features["S8"]["client_last_order"] is None  # the sentinel is not a date
    assert spark.read.parquet(paths["enriched"]).count() == 3
    assert readers.scan_client_features(spark, str(tmp_path / "absent")).count() == 0


def test_readers_reject(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.scan_validated(spark, str(tmp_path / "nothing.csv"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="Unsupported"):
        readers.scan_validated(spark, str(tmp_path / "a.txt"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="Empty"):
        readers.scan_validated(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError, match="mandatory"):
        readers.scan_relations(spark, {"orders": "x"})
    with pytest.raises(ValueError, match="unit_price"):
        readers.require_columns(spark.range(1).withColumnRenamed("id", "binding_type"))


def test_fingerprints(spark, tmp_path):
    (tmp_path / "one.sql").write_text("SELECT 1;")
    (tmp_path / "two.sql").write_text("SELECT 1;")
    (tmp_path / "skip.tmp").write_text("x")
    found = sinks.file_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == 2 and len({r["content_md5"] for r in found}) == 1


def test_text_audit(spark):
    df = spark.createDataFrame([("ok",), ("x drop  database y",), ("a\x00b",), ("migrants",)], "text string")
    assert [r["accepted"] for r in sinks.text_pattern_audit(df).collect()] == [True, False, False, True]


def test_bounds(spark):
    rows = [("nine", 10.0)] * 9 + [("ten", float(i)) for i in range(1, 11)] + [("out", 10.0 + i / 10) for i in range(20)] + [("out", 900.0)]
    rows += [("same", 40.0)] * 12
    found = {r["family"]: r for r in B.price_bounds_iqr(spark.createDataFrame(rows, "binding_type string, unit_price double")).collect()}
    assert found["nine"]["uses_default"] and found["nine"]["min"] == found["DEFAULT"]["min"]
    assert not found["ten"]["uses_default"]
    assert found["out"]["stats"]["outliers_removed"] == 1
    assert found["same"]["default"] == 40.0 and found["same"]["max"] == 60.0
    assert all(r["min"] <= r["max"] for r in found.values())
    group = {r["group"]: r for r in B.price_bounds_group(spark.createDataFrame(rows, "g string, unit_price double"), "g").collect()}
    assert group["nine"]["n_samples"] == len(rows)


def quote(spark, r2, **other):
    tier = "struct<model_name:string,model_version:bigint,algorithm:string,prediction:double,r2:double,formula:string,feature_importance:map<string,double>,available:boolean,reason:string>"
    block = lambda name, price, fit, ok=True: (name, 1, "Ridge", price, fit, None, {"a": 0.7, "b": 0.2, "c": 0.0}, ok, None)
    row = {
        "siren": "ABC", "global_prediction": block("G", 100.0, 0.5), "family_linear": block("F", 104.0, r2),
        "family_nonlinear": None, "couple_linear": block("C", 90.0, r2), "couple_nonlinear": None, **other,
    }
    schema = "siren string, " + ", ".join(f"{t} {tier}" for t in T.SUMMARY_ORDER)
    return spark.createDataFrame([tuple([row["siren"], *[row[t] for t in T.SUMMARY_ORDER]])], schema)


@pytest.mark.parametrize(
    ("r2", "siren", "strategy", "confidence"),
    [
        (0.59, "ABC", "GLOBAL", "MEDIUM"), (0.60, "ABC", "COUPLE_LINEAR", "MEDIUM"), (0.75, "ABC", "COUPLE_LINEAR", "MEDIUM"),
        (0.90, "ABC", "COUPLE_LINEAR", "HIGH"), (0.90, "NONE", "FAMILY_LINEAR", "HIGH"), (0.90, None, "FAMILY_LINEAR", "HIGH"),
    ],
)
def test_quote_decision(spark, r2, siren, strategy, confidence):
    rows = T.quote_select_tier(T.filter_available_predictions(quote(spark, r2, siren=siren)))
    chosen = F.col("selected")
    out = T.quote_action(T.quote_confidence(rows, chosen["strategy"], F.lit(None).cast("string"), chosen["r2"])).first()
    assert out["selected"]["strategy"] == strategy
    # 0.59: the spread of 90 / 104 / 100 is 14.3 %
    assert out["confidence"] == confidence
    assert out["action"] == {"HIGH": "APPROVE", "MEDIUM": "REVIEW"}[confidence]


def test_quote_without_models(spark):
    void = quote(spark, 0.9, couple_linear=None, family_linear=None, global_prediction=None)
    rows = T.quote_select_tier(T.filter_available_predictions(void))
    out = T.quote_summary(T.quote_action(T.quote_confidence(rows, F.col("selected.strategy"), F.lit(""), F.col("selected.r2")))).first()
    assert out["selected"] is None and out["action"] == "MANUAL_REVIEW" and out["predictions_available"] == 0


def test_explanation_and_narrative(spark):
    rows = T.quote_select_tier(T.filter_available_predictions(quote(spark, 0.9))).withColumns({
        "client_found": F.lit(True), "client_nb_orders": F.lit(3), "client_avg_price_ht": F.lit(80.0), "client_seniority_years": F.lit(1.5),
        "client_recency_days": F.lit(4), "client_price_elasticity": F.lit(-1.0), "confidence": F.lit("HIGH"), "action": F.lit("APPROVE"),
        "intent": F.explode(F.array(*[F.lit(i) for i in ("approval", "client_price_level", "driver", "formula", "analysis")])),
    })
    told = {r["intent"]: r["answer"] for r in N.quote_narrative(N.narrative_context(T.quote_explanation(rows))).collect()}
    assert "This quote looks reliable enough to approve." in told["approval"]
    assert "above the client's historical average price" in told["client_price_level"] and "+12.50%" in told["client_price_level"]
    assert "is a (0.70%)" in told["driver"]
    assert "No explicit linear formula is available for the selected model C." in told["formula"]
    assert all(t.startswith("AI ANALYSIS\n\n") for t in told.values())


def test_scenario_answers(spark):
    base = T.quote_select_tier(T.filter_available_predictions(quote(spark, 0.9))).withColumns({
        "client_found": F.lit(False), "client_nb_orders": F.lit(0), "client_avg_price_ht": F.lit(0.0), "client_seniority_years": F.lit(0.0),
        "client_recency_days": F.lit(0), "client_price_elasticity": F.lit(0.0), "confidence": F.lit("HIGH"), "action": F.lit("APPROVE"),
        "intent": F.lit("scenario"), "q": F.lit("what has the biggest effect"),
    })
    cell = lambda label, pct: F.struct(
        F.lit(label).alias("field_label"), F.lit(10.0).alias("old_value"), F.lit(11.5).alias("new_value"), F.lit(90.0).alias("base_price"),
        F.lit(95.0).alias("scenario_price"), F.lit(5.0).alias("delta_price"), F.lit(pct).alias("delta_percent"),
    )
    rows = N.narrative_context(T.quote_explanation(base)).withColumn("scenarios", F.array(cell("height", 1.0), cell("quantity", -5.0)))
    assert "The biggest impact came from quantity." in N.quote_narrative(rows, "q").first()["answer"]
    single = rows.withColumn("scenarios", F.slice("scenarios", 1, 1))
    assert "- New value: 11.5000" in N.quote_narrative(single, "q").first()["answer"]


def test_formula_round_trip(spark):
    rows = [("m", 0, "intercept", 1.5), ("m", 1, "quantity", -0.25), ("m", 2, "tiny", 0.00005), ("m", 3, "text_color_4/4", 2.0)]
    text = L.render_formula(spark.createDataFrame(rows, "name string, position int, feature string, coefficient double"), ["name"])
    out = L.parse_formula(text.select("name", "formula")).first()
    assert out["formula"] == "unit_price = 1.5000 - 0.2500 × quantity + 2.0000 × text_color_4/4"
    assert [tuple(t) for t in out["terms"]] == [("quantity", -0.25), ("text_color_4/4", 2.0)]
    assert out["strongest"]["feature"] == "text_color_4/4"
    many = [("m", i, f"f{i}", 1.0) for i in range(25)]
    long = L.render_formula(spark.createDataFrame(many, "name string, position int, feature string, coefficient double"), ["name"]).first()
    assert long["formula"].endswith("+ ...") and long["formula"].count("×") == 20


def test_feature_rows(spark):
    request = [("sav", "ss", {"quantity": "500", "production_page": "252", "has_coil": "1", "text_color": "4/4", "cover_size": None})]
    out = P.build_feature_rows(spark.createDataFrame(request, "siren string, binding_type string, features map<string,string>"))
    row = out.first()
    assert out.columns[:30] == S.ALL_FEATURES and row["warnings"] == []
    assert (row["quantity"], row["production_page"], row["has_coil"]) == (500, 252, 1)
    assert (row["siren"], row["binding_type"], row["cover_size"], row["coil_type"]) == ("SAV", "SS", "MISSING", "MISSING")


def test_scenario_moves(spark):
    df = spark.createDataFrame([(100, 0.05, 1)], "quantity int, thickness double, has_tab int")
    moved = {r["field_name"]: r for r in X.scenario_expand(df).collect()}
    assert moved["quantity"]["new_value"] == 150.0 and moved["quantity"]["label"] == "Increase quantity"
    assert moved["thickness"]["new_value"] == 0.25 and moved["has_tab"]["new_value"] == 0.0
    down = {r["field_name"]: r["new_value"] for r in X.scenario_expand(df, direction=F.lit("decrease"), percent=F.lit(10.0)).collect()}
    assert down["quantity"] == 90.0 and down["thickness"] == 0.1


def test_history_is_the_same_for_any_piece_size(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(40)] + [(2, 100 * t, "user", f"u{t}") for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = {(r["conv_id"], r["turn"]): r["history"] for r in D.history_window(df, piece_turns=10**6).collect()}
    for size in (1, 3, 7):
        assert whole == {(r["conv_id"], r["turn"]): r["history"] for r in D.history_window(df, piece_turns=size).collect()}
    assert whole[1, 10] == "t2 t4 t5 t7 t8" and whole[1, 0] == ""


def test_hints(spark):
    df = spark.createDataFrame([("raise pages by 12.5%", "", 1), ("and again", "fewer pages 30%", 2)], "question string, history string, i int")
    out = {r["i"]: r for r in D.match_fields(D.classify_intent(df)).collect()}
    assert out[1]["percent_hint"] == 12.5 and out[1]["matched_fields"] == ["production_page"]
    assert out[2]["percent_hint"] == 30.0 and out[2]["matched_fields"] == ["production_page"] and out[2]["intent"] == "scenario"


def test_split_is_exact_per_stratum(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4 == 0).cast("string").alias("s"))
    parts = {(r["s"], r["part"]): r["n"] for r in R.stratified_split(df, "s", "k").groupBy("s", "part").agg(F.count("*").alias("n")).collect()}
    assert parts == {("true", "test"): 25, ("true", "train"): 75, ("false", "test"): 75, ("false", "train"): 225}


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 90 + [(2.0,)] * 10, "v double")
    assert {r["bin"] for r in R.target_quantile_bins(df, "v").collect()} <= {0, 1}


def test_vif(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 3))
    x[:, 2] = x[:, 0] + 0.5 * x[:, 2]
    found = {r["column"]: r["vif"] for r in Q.vif_table(spark.createDataFrame(x.tolist(), ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert all(abs(found[n] - w) < 1e-6 for n, w in zip("abc", want))
