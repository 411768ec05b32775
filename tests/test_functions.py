"""Values, quantiles and joins against brute force."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceloom.functions import distribution as D
from priceloom.functions import scale as SC
from priceloom.functions import values as V


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_locale_numbers(spark):
    assert one(spark, "12,5", V.locale_number) == 12.5
    assert one(spark, "19,6%", V.locale_number) == 19.6
    assert abs(one(spark, "19,6%", V.vat_rate) - 0.196) < 1e-12
    assert one(spark, "abc", V.locale_number) == 0
    assert one(spark, None, V.locale_number) == 0


def test_vat_divisor(spark):
    price = lambda vat: one(spark, vat, lambda v: V.price_without_vat(F.lit(120.0), v))
    assert price("1") == 60.0
    assert abs(price("0.2") - 100.0) < 1e-9
    assert price("-0.1") == 120.0
    assert abs(price("20%") - 100.0) < 1e-9


def test_dates(spark):
    assert one(spark, "05-03-2024", V.parse_date) == dt.date(2024, 3, 5)
    assert one(spark, "2024-03-05", V.parse_date) == dt.date(2024, 3, 5)
    assert one(spark, "31-12-9999", V.parse_date) == dt.date(9999, 12, 31)
    assert one(spark, "NAN", V.parse_date) is None
    assert one(spark, None, lambda v: V.sentinel(V.parse_date(v))) == dt.date(9999, 12, 31)


def test_request_values(spark):
    flag = lambda t: tuple(one(spark, t, lambda v: V.request_flag(v, "has_coil")))
    assert flag("oui") == (1, None)
    assert flag("faux") == (0, None)
    assert flag("2") == (1, None)
    assert flag("x")[0] == 0 and "has_coil=x" in flag("x")[1]
    assert one(spark, "252", lambda v: V.request_count(v, "production_page"))["value"] == 252
    assert one(spark, "3.9", lambda v: V.request_count(v, "quantity"))["value"] == 3
    assert one(spark, "tall", lambda v: V.request_measure(v, "height"))["warning"] is not None


def test_keys_and_text(spark):
    assert one(spark, "COILHARD-TAB", V.model_key) == "COILHARD_TAB"
    line = "2026-04-21 14:06:38 - HTTP Request: POST http://127.0.0.1:8016/api/logs/"
    assert one(spark, line, V.strip_log_timestamp) == "HTTP Request: POST http://127.0.0.1:8016/api/logs/"
    assert one(spark, None, lambda v: V.pair_key(F.lit("SS"), v)) == "SS__UNKNOWN"
    assert one(spark, "SS", V.pair_client) == ""
    assert abs(one(spark, "42.5", lambda v: V.price_from_log(V.log_price(v.cast("double")))) - 42.5) < 1e-9


VALUES = st.lists(
    st.tuples(st.sampled_from("ab"), st.one_of(st.floats(-1e6, 1e6), st.integers(-3, 3).map(float))), min_size=1, max_size=60
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(VALUES)
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in D.quantiles_of(df, ["g"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.9}).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g]
        for name, q in (("lo", 0.01), ("mid", 0.5), ("hi", 0.9)):
            assert np.isclose(found[g][name], np.quantile(values, q), rtol=1e-9, atol=1e-9)


def test_slots_keep_order(spark):
    values = sorted([-1e300, -5.0, -1e-300, 0.0, 1e-300, 0.999, 1.0, 2.0, 8.0, 1e300])
    slots = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(D.slot_of(F.col("v"))).collect()]
    assert slots == sorted(slots)


def test_salted_join_equals_plain_join(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)]
    fact = spark.createDataFrame(rows, "k string, i int")
    side = spark.createDataFrame([("hot", 1.0), *[(f"k{i}", float(i)) for i in range(40)]], "k string, w double")
    salted = SC.join_lookup(fact, side, ["k"], broadcast_rows=0)
    assert sorted(salted.na.fill(-1.0).collect()) == sorted(fact.join(side, "k", "left").na.fill(-1.0).collect())
    pieces = {r["k"]: r["_pieces"] for r in SC.hot_keys(fact, ["k"]).collect()}
    assert pieces["hot"] > 500
    semi = SC.join_lookup(fact, side.select("k"), ["k"], "left_semi", broadcast_rows=0)
    assert semi.count() == fact.join(side, "k", "left_semi").count()


def test_shared_folder_is_read_from_the_session(spark):
    assert SC.shared_folder(spark) == SC.shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir")
