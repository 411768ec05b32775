"""Requests, tiers, quote decisions, scenarios and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom import schema as S
from priceloom.catalog import register
from priceloom.catalog.cleaning_checks import counted, sql_list
from priceloom.catalog.client_checks import FEATURES, priced_input
from priceloom.catalog.mart import OFF_HALF, SALES, fixed, r6, sales, table
from priceloom.functions import values as V
from priceloom.functions.scale import join_lookup, settle
from priceloom.operators import dialogue as D
from priceloom.operators import formulas as M
from priceloom.operators import quotes as Q
from priceloom.operators import requests as P
from priceloom.operators import scenarios as X
from priceloom.operators import scoring as T
from priceloom.operators import texts as N
from priceloom.operators.clients import client_features, client_mean_price

# --- models with a closed form: ln(1 + price) on ln(quantity), per tier -----


def closed_form_models(rows):
    """One regression per tier and group; the nonlinear tiers hold the mean log price.

    The rows are aggregated once, to moments per pair; the families and the whole
    are sums of these moments.
    """
    y, x = F.log1p("unit_price"), F.ln("quantity")
    moments = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    pairs = settle(rows.groupBy("binding_type", "country").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
    ), "moments")

    def fitted(level, name, keys, minimum=1):
        sums = pairs.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in moments]).where(F.col("n") >= minimum)
        n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
        xx, xy, yy = F.col("sxx") - sx * sx / n, F.col("sxy") - sx * sy / n, F.col("syy") - sy * sy / n
        fit = sums.withColumns({
            "slope": xy / xx, "intercept": sy / n - xy / xx * sx / n, "r2": xy * xy / (xx * yy), "mean": sy / n,
        })
        text = F.format_string("unit_price = %.4f - %.4f × log_quantity", "intercept", F.abs("slope"))
        linear = fit.select(
            name("Linear").alias("model_name"), F.lit(level).alias("level"), F.lit("Ridge").alias("algorithm"), "r2",
            text.alias("formula"), "intercept", F.create_map(F.lit("log_quantity"), F.col("slope")).alias("coefficients"),
        )
        flat = fit.select(
            name("NonLinear").alias("model_name"), F.lit(level).alias("level"), F.lit("Tree").alias("algorithm"),
            F.lit(0.0).alias("r2"), F.lit(None).cast("string").alias("formula"), F.col("mean").alias("intercept"),
            F.create_map(F.lit("log_quantity"), F.lit(0.0)).alias("coefficients"),
        )
        return linear.unionByName(flat) if keys else linear

    family, client = F.col("binding_type"), F.col("country")
    models = fitted("global", lambda kind: F.lit(T.GLOBAL_MODEL), [])
    models = models.unionByName(fitted("family", lambda kind: T.family_model_name(family, kind), ["binding_type"]))
    models = models.unionByName(
        fitted("pair", lambda kind: T.pair_model_name(family, client, kind), ["binding_type", "country"], PAIR_MINIMUM)
    )
    return models.withColumns({
        "model_version": F.lit(1).cast("bigint"),
        "feature_importance": F.map_from_arrays(
            F.map_keys("coefficients"), F.transform(F.map_values("coefficients"), lambda v: F.abs(v))
        ),
    })


# Pairs below this size have no model, so that the fallback is exercised.
PAIR_MINIMUM = 380

MODELS = f"""
{SALES},
fit_g AS (SELECT regr_slope(ln(1 + unit_price), ln(quantity)) AS s, regr_intercept(ln(1 + unit_price), ln(quantity)) AS i, regr_r2(ln(1 + unit_price), ln(quantity)) AS r2 FROM sales),
fit_f AS (SELECT binding_type, avg(ln(1 + unit_price)) AS m, regr_slope(ln(1 + unit_price), ln(quantity)) AS s, regr_intercept(ln(1 + unit_price), ln(quantity)) AS i, regr_r2(ln(1 + unit_price), ln(quantity)) AS r2 FROM sales GROUP BY 1),
fit_p AS (SELECT binding_type, country, avg(ln(1 + unit_price)) AS m, regr_slope(ln(1 + unit_price), ln(quantity)) AS s, regr_intercept(ln(1 + unit_price), ln(quantity)) AS i, regr_r2(ln(1 + unit_price), ln(quantity)) AS r2
          FROM sales GROUP BY 1, 2 HAVING count(*) >= {PAIR_MINIMUM}),
scored AS (
  SELECT s.*, CASE WHEN line_no = 4 THEN NULL WHEN line_no = 5 THEN 'NONE' ELSE s.country END AS client,
         exp(g.i + g.s * ln(quantity)) - 1 AS g_price, g.r2 AS g_r2, exp(f.i + f.s * ln(quantity)) - 1 AS f_price, f.r2 AS f_r2, exp(f.m) - 1 AS fn_price,
         exp(p.i + p.s * ln(quantity)) - 1 AS p_price, p.r2 AS p_r2, exp(p.m) - 1 AS pn_price, p.i IS NOT NULL AS has_pair
  FROM sales s CROSS JOIN fit_g g JOIN fit_f f ON f.binding_type = s.binding_type
       LEFT JOIN fit_p p ON p.binding_type = s.binding_type AND p.country = CASE WHEN line_no = 4 THEN NULL WHEN line_no = 5 THEN 'NONE' ELSE s.country END)"""


def quote_rows(spark, sf_dir):
    """Order lines as quote requests; some without a known client. Written once: models and quotes read them."""
    rows = settle(sales(spark, sf_dir, part=True, nation=True).select(
        "row_key", "order_id", "line_no", "binding_type", "quantity", "unit_price", "country", "siren"
    ), "quote-rows")
    client = F.when(F.col("line_no") == 5, "NONE").when(F.col("line_no") != 4, F.col("country"))
    return rows, rows.select(
        "row_key", "order_id", "line_no", "binding_type", "quantity", "unit_price", client.alias("siren"),
        F.col("siren").alias("custkey"),
        F.ln("quantity").alias("log_quantity"),
    )


def scored_quotes(spark, sf_dir):
    rows, quotes = quote_rows(spark, sf_dir)
    return T.score_quotes(quotes, closed_form_models(rows), ["log_quantity"], [])


TIER_COLUMNS = {"g": "global_prediction", "f": "family_linear", "fn": "family_nonlinear", "p": "couple_linear", "pn": "couple_nonlinear"}


@register("join_model_tiers", """
WITH """ + MODELS + """
SELECT row_key, 'PricingModelGlobal' AS global_prediction, 'PricingModel_' || binding_type || '_Linear' AS family_linear,
       'PricingModel_' || binding_type || '_NonLinear' AS family_nonlinear,
       CASE WHEN has_pair THEN 'PricingModel_' || binding_type || '__' || regexp_replace(country, '[^a-zA-Z0-9_]', '_', 'g') || '_Linear' ELSE 'Model not found' END AS couple_linear,
       CASE WHEN has_pair THEN 'PricingModel_' || binding_type || '__' || regexp_replace(country, '[^a-zA-Z0-9_]', '_', 'g') || '_NonLinear' ELSE 'Model not found' END AS couple_nonlinear
FROM scored""")
def join_model_tiers(spark, sf_dir):
    rows, quotes = quote_rows(spark, sf_dir)
    tiered = T.join_model_tiers(quotes, closed_form_models(rows))
    return tiered.select(
        "row_key", *[F.coalesce(F.col(f"{t}_model")["model_name"], F.lit("Model not found")).alias(t) for t in TIER_COLUMNS.values()]
    )


@register("score_tiers", f"""
WITH {MODELS} SELECT row_key, round(g_price, 5) AS g, round(f_price, 5) AS f, round(fn_price, 5) AS fn,
  round(coalesce(p_price, 0), 5) AS p, round(coalesce(pn_price, 0), 5) AS pn, CAST(has_pair AS BIGINT) AS has_pair FROM scored""")
def score_tiers(spark, sf_dir):
    quotes = scored_quotes(spark, sf_dir)
    prices = [fixed(F.col(t)["prediction"], 5).alias(k) for k, t in TIER_COLUMNS.items()]
    return quotes.select("row_key", *prices, F.col("couple_linear")["available"].cast("bigint").alias("has_pair"))


@register("filter_available_predictions", f"""
WITH {MODELS} SELECT row_key, CASE WHEN has_pair THEN 'couple_linear,family_linear,global_prediction,couple_nonlinear,family_nonlinear'
  ELSE 'family_linear,global_prediction,family_nonlinear' END AS keys FROM scored""")
def filter_available_predictions(spark, sf_dir):
    quotes = Q.filter_available_predictions(scored_quotes(spark, sf_dir))
    return quotes.select("row_key", F.array_join(F.transform("predictions", lambda p: p["key"]), ",").alias("keys"))


SELECTED = MODELS + f""",
chosen AS (
  SELECT *, client IS NOT NULL AND client <> 'NONE' AND has_pair AND p_r2 >= {Q.MIN_R2} AS pick_p, f_r2 >= {Q.MIN_R2} AS pick_f FROM scored),
selected AS (
  SELECT *, CASE WHEN pick_p THEN 'COUPLE_LINEAR' WHEN pick_f THEN 'FAMILY_LINEAR' ELSE 'GLOBAL' END AS strategy,
         CASE WHEN pick_p THEN p_price WHEN pick_f THEN f_price ELSE g_price END AS price,
         CASE WHEN pick_p THEN p_r2 WHEN pick_f THEN f_r2 ELSE g_r2 END AS r2 FROM chosen)"""


@register("quote_select_tier", f"WITH {SELECTED} SELECT row_key, strategy, round(price, 5) AS price, round(r2, 6) AS r2 FROM selected")
def quote_select_tier(spark, sf_dir):
    picked = Q.quote_select_tier(scored_quotes(spark, sf_dir))
    return picked.select(
        "row_key", "selected.strategy", fixed("selected.price", 5).alias("price"), fixed("selected.r2", 6).alias("r2")
    )


# What the caller asked for: a model name on line 1, a strategy on line 2, a price on line 3.
@register("quote_select_override", f"""
WITH {MODELS}, d AS (
  SELECT *, list_sort([struct_pack(d := CASE WHEN has_pair THEN abs(p_price - unit_price) END, i := 1, k := 'couple_linear'),
    struct_pack(d := abs(f_price - unit_price), i := 2, k := 'family_linear'), struct_pack(d := abs(g_price - unit_price), i := 3, k := 'global_prediction'),
    struct_pack(d := CASE WHEN has_pair THEN abs(pn_price - unit_price) END, i := 4, k := 'couple_nonlinear'),
    struct_pack(d := abs(fn_price - unit_price), i := 5, k := 'family_nonlinear')], 'ASC', 'NULLS LAST') AS gaps FROM scored)
SELECT row_key, CASE line_no WHEN 1 THEN 'family_nonlinear' WHEN 2 THEN 'global_prediction'
  WHEN 3 THEN list_filter(gaps, lambda g: g.d IS NOT NULL)[1].k
  ELSE CASE WHEN has_pair THEN 'couple_linear' ELSE 'family_linear' END END AS key FROM d""")
def quote_select_override(spark, sf_dir):
    line = F.col("line_no")
    quotes = Q.filter_available_predictions(scored_quotes(spark, sf_dir)).withColumns({
        "asked_model": F.when(line == 1, F.upper(F.col("family_nonlinear")["model_name"])),
        "asked_strategy": F.when(line == 2, "global").when(line == 4, "unknown"),
        "asked_price": F.when(line == 3, F.col("unit_price")),
    })
    return Q.quote_select_override(quotes).select("row_key", "best_model.key")


@register("closest_prediction", f"""
WITH {MODELS}, g AS (SELECT row_key, abs(f_price - unit_price) AS a, abs(g_price - unit_price) AS b, abs(fn_price - unit_price) AS c,
  CASE WHEN has_pair THEN abs(p_price - unit_price) END AS d, CASE WHEN has_pair THEN abs(pn_price - unit_price) END AS e FROM scored)
SELECT row_key, round(least(a, b, c, coalesce(d, a), coalesce(e, a)), 5) AS gap FROM g""")
def closest_prediction(spark, sf_dir):
    quotes = Q.filter_available_predictions(scored_quotes(spark, sf_dir))
    near = Q.closest_prediction(F.col("predictions"), F.col("unit_price"))
    return quotes.select("row_key", fixed(F.abs(near["prediction"] - F.col("unit_price")), 5).alias("gap"))


CONFIDENCE = SELECTED + """,
spreads AS (
  SELECT *, CASE WHEN has_pair THEN (greatest(g_price, f_price, fn_price, p_price, pn_price) - least(g_price, f_price, fn_price, p_price, pn_price)) / ((p_price + f_price + g_price + pn_price + fn_price) / 5)
         ELSE (greatest(g_price, f_price, fn_price) - least(g_price, f_price, fn_price)) / ((f_price + g_price + fn_price) / 3) END * 100 AS spread FROM selected),
confident AS (
  SELECT *, CASE WHEN r2 >= 0.9 THEN 'HIGH' WHEN r2 >= 0.75 THEN 'MEDIUM' WHEN r2 >= 0.6 THEN 'MEDIUM' WHEN spread <= 5 THEN 'HIGH' WHEN spread <= 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM spreads)"""


def confident_quotes(spark, sf_dir, maps=False):
    # written without what no decision reads, as it reads every price several times; maps are for explanations
    unread = ["model_version", "algorithm", "reason"] + ([] if maps else ["feature_importance"])
    quotes = scored_quotes(spark, sf_dir)
    quotes = quotes.withColumns({t: F.col(t).dropFields(*unread) for t in TIER_COLUMNS.values()})
    quotes = Q.quote_select_tier(Q.filter_available_predictions(settle(quotes, "scored")))
    chosen = F.col("selected")
    formula = F.when(chosen["strategy"] == "GLOBAL", F.col("global_prediction")["formula"]).when(
        chosen["strategy"] == "COUPLE_LINEAR", F.col("couple_linear")["formula"]
    ).otherwise(F.col("family_linear")["formula"])
    return Q.quote_confidence(quotes, chosen["strategy"], formula, chosen["r2"])


@register("quote_confidence", f"WITH {CONFIDENCE} SELECT row_key, strategy, confidence FROM confident")
def quote_confidence(spark, sf_dir):
    return confident_quotes(spark, sf_dir).select("row_key", "selected.strategy", "confidence")


@register("quote_action", f"""
WITH {CONFIDENCE} SELECT binding_type, CASE confidence WHEN 'HIGH' THEN 'APPROVE' WHEN 'MEDIUM' THEN 'REVIEW' ELSE 'MANUAL_REVIEW' END AS action, count(*) AS n_rows
FROM confident GROUP BY 1, 2""")
def quote_action(spark, sf_dir):
    return counted(Q.quote_action(confident_quotes(spark, sf_dir)), "binding_type", "action")


@register("quote_summary", f"""
WITH {MODELS} SELECT row_key, CASE WHEN has_pair THEN 5 ELSE 3 END AS predictions_available,
  CASE WHEN has_pair THEN 'global,family_linear,family_nonlinear,couple_linear,couple_nonlinear' ELSE 'global,family_linear,family_nonlinear' END AS models_used,
  CAST(line_no % 2 = 0 AS BIGINT) AS client_features_found FROM scored""")
def quote_summary(spark, sf_dir):
    quotes = scored_quotes(spark, sf_dir).withColumn("client_found", F.col("line_no") % 2 == 0)
    return Q.quote_summary(quotes).select(
        "row_key", F.col("predictions_available").cast("bigint").alias("predictions_available"),
        F.array_join("models_used", ",").alias("models_used"),
        F.col("client_features_found").cast("bigint").alias("client_features_found"),
    )


def explained_quotes(spark, sf_dir):
    """Selected quotes with their client profile."""
    features = client_features(priced_input(spark, sf_dir)).select(
        F.col("siren").alias("custkey"), "client_nb_orders", "client_avg_price_ht", "client_seniority_years",
        "client_recency_days", "client_price_elasticity", F.lit(True).alias("client_found"),
    )
    quotes = Q.quote_action(confident_quotes(spark, sf_dir, maps=True))
    joined = join_lookup(quotes, features, ["custkey"])
    return joined.withColumn("siren", F.col("custkey"))


@register("quote_explanation")
def quote_explanation(spark, sf_dir):
    e = Q.quote_explanation(explained_quotes(spark, sf_dir))
    return e.select(
        "row_key", "explanation.source_key", "explanation.explanation_type", "explanation.formula",
        "explanation.client_context", F.array_join("explanation.key_insights", " ").alias("key_insights"),
        F.size("explanation.model_summaries").alias("n_summaries"),
    )


@register("quote_narrative")
def quote_narrative(spark, sf_dir):
    quotes = N.narrative_context(Q.quote_explanation(explained_quotes(spark, sf_dir)))
    intents = [*D.INTENT_KEYWORDS, "client", "scenario"]
    pick = F.element_at(F.array(*[F.lit(i) for i in intents]), (F.col("order_id") % len(intents) + 1).cast("int"))
    told = N.quote_narrative(quotes.withColumn("intent", pick))
    return told.select("row_key", "intent", "answer")


@register("client_price_level", f"""
WITH {FEATURES} SELECT row_key, CASE WHEN unit_price < client_avg_price_ht THEN 'below' WHEN unit_price - client_avg_price_ht < 1e-9 THEN 'equal to' ELSE 'above' END AS price_level,
  round((unit_price - client_avg_price_ht) / client_avg_price_ht * 100, 5) AS level_percent FROM sales JOIN features USING (siren)""")
def client_price_level(spark, sf_dir):
    # written once for the means, the key counts and the join
    rows = settle(priced_input(spark, sf_dir).select("row_key", "siren", "unit_price", "tva"), "priced-rows")
    priced = rows.select("row_key", "siren", F.col("unit_price").alias("price"))
    leveled = Q.client_price_level(join_lookup(priced, client_mean_price(rows), ["siren"]))
    return leveled.select("row_key", "price_level", fixed("level_percent", 5).alias("level_percent"))


@register("price_delta", f"""
WITH {MODELS} SELECT row_key, round(round(f_price - CASE WHEN line_no = 7 THEN 0 ELSE g_price END, 6), 4) AS delta_price, coalesce(round((f_price - CASE WHEN line_no = 7 THEN 0 ELSE g_price END) / nullif(CASE WHEN line_no = 7 THEN 0 ELSE g_price END, 0) * 100, 4), -999) AS delta_percent FROM scored""")
def price_delta(spark, sf_dir):
    quotes = scored_quotes(spark, sf_dir).select(
        "row_key", "line_no", F.col("global_prediction")["prediction"].alias("g"), F.col("family_linear")["prediction"].alias("f")
    )
    moved = Q.price_delta(quotes.withColumn("base", F.when(F.col("line_no") == 7, 0.0).otherwise(F.col("g"))), "base", "f")
    return moved.select(
        "row_key", fixed("delta_price", 4).alias("delta_price"),
        F.coalesce("delta_percent", F.lit(-999.0)).alias("delta_percent"),
    )


# --- scenarios --------------------------------------------------------------

FIELDS_SQL = """
base AS (
  SELECT o_orderkey AS quote_id, CAST(o_orderkey % 300 AS DOUBLE) AS production_page, CAST(o_custkey % 900 AS DOUBLE) AS quantity,
         sqrt(o_totalprice) AS height, sqrt(o_totalprice) / 50 AS thickness, o_orderkey % 2 AS has_coil, o_custkey % 2 AS shrinkwrap,
         CASE o_orderstatus WHEN 'F' THEN 'decrease' WHEN 'O' THEN 'increase' ELSE 'disable' END AS direction,
         CASE WHEN o_orderkey % 5 = 0 THEN 12.5::DOUBLE END AS percent, CASE WHEN o_orderkey % 7 = 0 THEN 30.0::DOUBLE END AS absolute
  FROM orders)"""


def scenario_base(spark, sf_dir):
    key, cust, total = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        key.alias("quote_id"),
        (key % 300).cast("int").alias("production_page"),
        (cust % 900).cast("int").alias("quantity"),
        F.sqrt(total).alias("height"),
        (F.sqrt(total) / 50).alias("thickness"),
        (key % 2).cast("int").alias("has_coil"),
        (cust % 2).cast("int").alias("shrinkwrap"),
        F.when(F.col("o_orderstatus") == "F", "decrease").when(F.col("o_orderstatus") == "O", "increase").otherwise("disable").alias("direction"),
        F.when(key % 5 == 0, 12.5).alias("percent"),
        F.when(key % 7 == 0, 30.0).alias("absolute"),
    )


def expanded(spark, sf_dir):
    return X.scenario_expand(
        scenario_base(spark, sf_dir), direction=F.col("direction"), percent=F.col("percent"), absolute=F.col("absolute")
    )


def _numeric_sql(name):
    spec = X.NUMERIC_FIELDS[name]
    sign = "CASE WHEN direction = 'decrease' THEN -1 ELSE 1 END"
    step = f"greatest(abs(coalesce(absolute, {spec['step']})), CASE WHEN {name} > 0 THEN {name} * {spec['percent'] / 100} ELSE 0 END)"
    moved = f"greatest({spec['minimum']}, CASE WHEN percent IS NOT NULL THEN {name} * (1 + {sign} * percent / 100) ELSE {name} + {sign} * {step} END)"
    shaped = f"round_even({moved}, 0)" if spec["integer"] else f"round({moved}, 4)"
    bump = 1 if spec["integer"] else 0.1
    return f"""SELECT quote_id, '{name}' AS field_name, {name} AS old_value, CASE WHEN {shaped} = {name} THEN {name} + {bump} ELSE {shaped} END AS new_value,
      CASE WHEN direction = 'decrease' THEN 'Decrease' ELSE 'Increase' END || ' {spec['label']}' AS label FROM base"""


def _flag_sql(name):
    label = X.FLAG_FIELDS[name]["label"]
    wanted = "CASE WHEN direction IN ('disable', 'decrease') THEN 0 ELSE 1 END"
    new = f"CASE WHEN {wanted} = {name} THEN 1 - {name} ELSE {wanted} END"
    return f"""SELECT quote_id, '{name}', CAST({name} AS DOUBLE), CAST({new} AS DOUBLE), CASE WHEN {new} = 1 THEN 'Enable' ELSE 'Disable' END || ' {label}' FROM base"""


SCENARIOS = FIELDS_SQL + f""",
scen AS ({' UNION ALL '.join([_numeric_sql(n) for n in ('production_page', 'quantity', 'height', 'thickness')] + [_flag_sql(n) for n in ('shrinkwrap', 'has_coil')])})"""


@register("scenario_expand", f"WITH {SCENARIOS} SELECT quote_id, field_name, round(old_value, 6) AS old_value, round(new_value, 4) AS new_value, label FROM scen")
def scenario_expand(spark, sf_dir):
    return expanded(spark, sf_dir).select(
        "quote_id", "field_name", fixed("old_value", 6).alias("old_value"), fixed("new_value", 4).alias("new_value"), "label"
    )


def toy_price(rows):
    """A fixed formula stands in for the models where only the moves matter."""
    return rows.withColumn(
        "price",
        5 + 0.02 * F.col("production_page") + 300 / (F.col("quantity") + 10) + 0.1 * F.col("height")
        + 0.5 * F.col("thickness") + 1.5 * F.col("has_coil") + 0.25 * F.col("shrinkwrap"),
    )


PRICE_SQL = "5 + 0.02 * {production_page} + 300 / ({quantity} + 10) + 0.1 * {height} + 0.5 * {thickness} + 1.5 * {has_coil} + 0.25 * {shrinkwrap}"
_PLAIN = PRICE_SQL.format(**{n: n for n in ("production_page", "quantity", "height", "thickness", "has_coil", "shrinkwrap")})
_MOVED = PRICE_SQL.format(**{
    n: f"(CASE WHEN field_name = '{n}' THEN new_value ELSE {n} END)"
    for n in ("production_page", "quantity", "height", "thickness", "has_coil", "shrinkwrap")
})
EVALUATED = SCENARIOS + f""",
priced_scen AS (SELECT s.quote_id, field_name, {_PLAIN} AS base_price, {_MOVED} AS scenario_price FROM scen s JOIN base USING (quote_id))"""


def evaluated(spark, sf_dir):
    base = toy_price(scenario_base(spark, sf_dir)).withColumnRenamed("price", "base_price")
    return X.scenario_evaluate(
        base, toy_price, direction=F.col("direction"), percent=F.col("percent"), absolute=F.col("absolute")
    )


@register("scenario_evaluate", f"""
WITH {EVALUATED} SELECT quote_id, field_name, round(scenario_price, 4) AS scenario_price, round((scenario_price - base_price) / base_price * 100, 4) AS delta_percent FROM priced_scen""")
def scenario_evaluate(spark, sf_dir):
    return evaluated(spark, sf_dir).select(
        "quote_id", "field_name", fixed("scenario_price", 4).alias("scenario_price"), "delta_percent"
    )


ORDERED_FIELDS = sql_list([*X.NUMERIC_FIELDS, *X.FLAG_FIELDS])


@register("strongest_scenario", f"""
WITH {EVALUATED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY round(abs((scenario_price - base_price) / base_price * 100), 4) DESC, list_position([{ORDERED_FIELDS}], field_name)) AS rn FROM priced_scen)
SELECT quote_id, field_name, round((scenario_price - base_price) / base_price * 100, 4) AS delta_percent FROM r WHERE rn = 1""")
def strongest_scenario(spark, sf_dir):
    return X.strongest_scenario(evaluated(spark, sf_dir), "quote_id").select("quote_id", "field_name", "delta_percent")


# --- requests ---------------------------------------------------------------

REQUEST_FLAGS = ["oui", "faux", "2", "x", "TRUE", "0", "No", "1.0", "", "vrai"]


def quote_requests(spark, sf_dir):
    """Requests whose feature map comes from the orders, in mixed spellings."""
    key = F.col("o_orderkey")
    flag = F.element_at(F.array(*[F.lit(v) for v in REQUEST_FLAGS]), (key % 10 + 1).cast("int"))
    pairs = {
        "quantity": F.when(key % 4 == 0, "many").otherwise(F.concat((key % 500).cast("string"), F.lit(".7"))),
        "production_page": F.concat(F.lit(" "), (F.col("o_custkey") % 400).cast("string")),
        "has_coil": flag,
        "height": F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise((key % 90 + 0.5).cast("double").cast("string")),
        "text_color": F.when(key % 2 == 0, " 4/4 ").otherwise("9/9"),
        "cover_size": F.lit(None).cast("string"),
    }
    features = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values()))
    return table(spark, sf_dir, "orders").select(
        key.alias("quote_id"), F.lower("o_orderpriority").alias("siren"), F.lit("ss").alias("binding_type"), features.alias("features")
    )


FLAG_ITEMS = sql_list(REQUEST_FLAGS)
REQUESTS = f"""
req AS (
  SELECT o_orderkey AS quote_id, o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, lower(([{FLAG_ITEMS}])[o_orderkey % 10 + 1]) AS f FROM orders),
built AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 500 END AS quantity, CASE WHEN f IN ('oui', '2', 'true', '1.0', 'vrai') THEN 1 ELSE 0 END AS has_coil,
         CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE k % 90 + 0.5 END AS height, CASE WHEN k % 2 = 0 THEN '4/4' ELSE '9/9' END AS text_color,
         CAST(k % 4 = 0 AS INT) + CAST(f = 'x' AS INT) + CAST(k % 3 = 0 AS INT) AS n_warnings FROM req)"""


@register("build_feature_rows", f"""
WITH {REQUESTS} SELECT quote_id, quantity, c % 400 AS production_page, has_coil, 0 AS perf, height, 0.0::DOUBLE AS width, text_color,
  'MISSING' AS cover_size, 'MISSING' AS coil_type, 'SS' AS binding_type, upper(p) AS siren, n_warnings FROM built""")
def build_feature_rows(spark, sf_dir):
    rows = P.build_feature_rows(quote_requests(spark, sf_dir))
    ints = [F.col(c).cast("bigint").alias(c) for c in ("quantity", "production_page", "has_coil", "perf")]
    return rows.select(
        "quote_id", *ints, "height", "width", "text_color", "cover_size", "coil_type", "binding_type", "siren",
        F.size("warnings").cast("bigint").alias("n_warnings"),
    )


@register("parse_flag", f"""
WITH {REQUESTS} SELECT f AS spelling, has_coil AS value, CAST(f = 'x' AS BIGINT) AS warned, count(*) AS n_rows FROM built GROUP BY 1, 2, 3""")
def parse_flag(spark, sf_dir):
    raw = F.col("features")["has_coil"]
    parsed = V.request_flag(raw, "has_coil")
    rows = quote_requests(spark, sf_dir).select(
        F.lower(raw).alias("spelling"), parsed["value"].cast("bigint").alias("value"), parsed["warning"].isNotNull().cast("bigint").alias("warned")
    )
    return counted(rows, "spelling", "value", "warned")


@register("parse_count", f"WITH {REQUESTS} SELECT quote_id, quantity AS value, CAST(k % 4 = 0 AS BIGINT) AS warned FROM built")
def parse_count(spark, sf_dir):
    parsed = V.request_count(F.col("features")["quantity"], "quantity")
    return quote_requests(spark, sf_dir).select(
        "quote_id", parsed["value"].cast("bigint").alias("value"), parsed["warning"].isNotNull().cast("bigint").alias("warned")
    )


@register("parse_measure", f"WITH {REQUESTS} SELECT quote_id, height AS value, CAST(k % 3 = 0 AS BIGINT) AS warned FROM built")
def parse_measure(spark, sf_dir):
    parsed = V.request_measure(F.col("features")["height"], "height")
    return quote_requests(spark, sf_dir).select("quote_id", parsed["value"].alias("value"), parsed["warning"].isNotNull().cast("bigint").alias("warned"))


@register("normalize_category", f"""
WITH {REQUESTS} SELECT text_color, CAST(text_color NOT IN ({sql_list(S.KNOWN_CATEGORIES['text_color'])}) AS BIGINT) AS text_color_unknown, count(*) AS n_rows FROM built GROUP BY 1, 2""")
def normalize_category(spark, sf_dir):
    rows = quote_requests(spark, sf_dir).select(F.col("features")["text_color"].alias("text_color"))
    done = P.normalize_category(rows, "text_color")
    return counted(done.select("text_color", F.col("text_color_unknown").cast("bigint").alias("text_color_unknown")), "text_color", "text_color_unknown")


@register("unknown_categories", f"""
WITH {REQUESTS} SELECT 'text_color' AS feature, count(*) FILTER (text_color NOT IN ({sql_list(S.KNOWN_CATEGORIES['text_color'])})) AS n_unknown FROM built
UNION ALL SELECT 'siren', count(*) FROM built
UNION ALL SELECT unnest([{sql_list(c for c in S.CATEGORY_FEATURES if c not in ('text_color', 'siren'))}]), 0""")
def unknown_categories(spark, sf_dir):
    return P.unknown_categories(P.build_feature_rows(quote_requests(spark, sf_dir)))


# --- registry metadata ------------------------------------------------------

# Tags by order key: readable, unreadable, or only in the metadata.
def tagged_models(spark, sf_dir):
    key = F.col("o_orderkey")
    share = F.format_string("%.4f", (key % 1000) / F.lit(1000.0))
    first = F.when(key % 4 == 0, F.create_map(F.lit("r2_test"), F.lit("n/a"), F.lit("cv_r2"), share))
    second = F.when(key % 4 == 1, F.create_map(F.lit("R²"), share, F.lit("performance_rmse"), F.lit("1.5"), F.lit("best_model"), F.col("o_orderpriority")))
    third = F.when(key % 4 == 2, F.create_map(F.lit("rmse"), F.lit("2.25"), F.lit("shap_success"), F.lit("True"), F.lit("linear_formula"), F.lit("y = 1")))
    return table(spark, sf_dir, "orders").select(
        key.alias("version"),
        F.coalesce(first, second, third, F.create_map().cast("map<string,string>")).alias("tags"),
        F.create_map(F.lit("r2_train"), share, F.lit("algorithm"), F.col("o_orderstatus"), F.lit("formula"), F.lit("y = 2")).alias("metadata"),
    )


@register("tag_metric_lookup", """
SELECT o_orderkey AS version, round((o_orderkey % 1000) / 1000.0, 4) AS r2, CASE o_orderkey % 4 WHEN 1 THEN 1.5 WHEN 2 THEN 2.25 ELSE -1 END::DOUBLE AS rmse,
       CASE WHEN o_orderkey % 4 < 3 THEN 1 ELSE 0 END AS n_metrics FROM orders""")
def tag_metric_lookup(spark, sf_dir):
    found = P.tag_metric_lookup(tagged_models(spark, sf_dir))
    return found.select("version", fixed("r2", 4).alias("r2"), F.coalesce(F.col("metrics")["rmse"], F.lit(-1.0)).alias("rmse"), F.size("metrics").alias("n_metrics"))


@register("tag_algorithm_formula", """
SELECT o_orderkey AS version, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE o_orderstatus END AS algorithm,
       CASE WHEN o_orderkey % 4 = 2 THEN 'y = 1' ELSE 'y = 2' END AS formula, CAST(o_orderkey % 4 = 2 AS BIGINT) AS shap_available FROM orders""")
def tag_algorithm_formula(spark, sf_dir):
    found = P.tag_algorithm_formula(tagged_models(spark, sf_dir))
    return found.select("version", "algorithm", "formula", F.col("shap_available").cast("bigint").alias("shap_available"))


@register("parse_importance_json", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE CAST(props->>'k' AS DOUBLE) END AS k, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS n FROM events""")
def parse_importance_json(spark, sf_dir):
    text = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    done = P.parse_importance_json(table(spark, sf_dir, "events").select("event_id", text.alias("importance_json")))
    m = F.col("feature_importance")
    return done.select("event_id", F.coalesce(m["k"], F.lit(-1.0)).alias("k"), F.size(m).alias("n"))


# --- formulas ---------------------------------------------------------------


def coefficient_rows(spark, sf_dir):
    """Coefficients per family: a constant, the quantity slope and one effect per flag level."""
    rows = sales(spark, sf_dir, part=True)
    y, x = F.log1p("unit_price"), F.ln("quantity")
    fits = rows.groupBy("binding_type").agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("log_quantity"),
        (F.avg(F.when(F.col("returnflag") == "A", y)) - F.avg(y)).alias("returnflag_A"), F.lit(0.00005).alias("tiny"),
    )
    names = ["intercept", "log_quantity", "returnflag_A", "tiny"]
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"), F.col(n).alias("coefficient")) for i, n in enumerate(names)])
    return fits.select("binding_type", F.explode(cells).alias("c")).select("binding_type", "c.*")


FORMULAS = SALES + """,
c AS (SELECT binding_type, regr_intercept(ln(1 + unit_price), ln(quantity)) AS i, regr_slope(ln(1 + unit_price), ln(quantity)) AS s,
      avg(ln(1 + unit_price)) FILTER (returnflag = 'A') - avg(ln(1 + unit_price)) AS a FROM sales GROUP BY 1),
t AS (SELECT *, CASE WHEN s > 0 THEN '+ ' ELSE '- ' END || printf('%.4f', abs(s)) || ' × log_quantity' AS st,
      CASE WHEN abs(a) <= 1e-4 THEN '' ELSE CASE WHEN a > 0 THEN ' + ' ELSE ' - ' END || printf('%.4f', abs(a)) || ' × returnflag_A' END AS tail FROM c)"""


@register("render_formula", f"WITH {FORMULAS} SELECT binding_type, 'unit_price = ' || printf('%.4f', i) || ' ' || st || tail AS formula FROM t")
def render_formula(spark, sf_dir):
    return M.render_formula(coefficient_rows(spark, sf_dir), ["binding_type"]).select("binding_type", "formula")


@register("parse_formula", f"""
WITH {FORMULAS} SELECT binding_type, CASE WHEN abs(a) <= 1e-4 THEN 1 ELSE 2 END AS n_terms, 'log_quantity' AS strongest, round(s, 4) AS coefficient FROM t""")
def parse_formula(spark, sf_dir):
    done = M.parse_formula(M.render_formula(coefficient_rows(spark, sf_dir), ["binding_type"]).select("binding_type", "formula"))
    return done.select("binding_type", F.size("terms").alias("n_terms"), "strongest.feature", "strongest.coefficient").withColumnRenamed("feature", "strongest")


# --- questions --------------------------------------------------------------

HISTORY = """
h AS (SELECT conv_id, turn, role, text, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, ' ') OVER
      (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations)"""


@register("history_window", f"WITH {HISTORY} SELECT conv_id, turn, md5(history) AS history_md5, length(history) AS n_chars FROM h")
def history_window(spark, sf_dir):
    rows = D.history_window(table(spark, sf_dir, "conversations"), piece_turns=3)
    return rows.select("conv_id", "turn", F.md5("history").alias("history_md5"), F.length("history").cast("bigint").alias("n_chars"))


# Questions are the conversation texts, with an asked phrase put before some of them.
PHRASES = [
    "", "What is the formula?", "Which driver matters?", "why this model", "Can I approve it", "is it high for this client",
    "what action now", "How reliable is it", "why this price", "and the elasticity of the customer", "reduce pages by 12.5%",
    "what if quantity goes up 200", "same again", "client with more tabs", "with shrinkwrap and coil",
]
_ITEMS = sql_list(PHRASES)


def questions(spark, sf_dir):
    turns = D.history_window(table(spark, sf_dir, "conversations"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    asked = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", phrase, "text")).otherwise(phrase)
    return turns.select("conv_id", "turn", asked.alias("question"), "history")


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


ALL_ALIASES = [a for aliases in X.FIELD_ALIASES.values() for a in aliases]
AMBIGUOUS_SQL = f"(length(q) <= 20 OR {_any('q', D.AMBIGUOUS_REFERENCES)})"
QUESTIONS = HISTORY + f""",
asked AS (SELECT conv_id, turn, lower(trim(CASE WHEN turn % 3 = 0 THEN p || ' ' || text ELSE p END)) AS q, lower(trim(history)) AS past FROM
  (SELECT *, ([{_ITEMS}])[(conv_id + turn) % {len(PHRASES)} + 1] AS p FROM h))"""


@register("classify_intent", f"""
WITH {QUESTIONS}, i AS (SELECT conv_id, turn, CASE
  {' '.join(f"WHEN {_any('q', words)} THEN '{name}'" for name, words in D.INTENT_KEYWORDS.items())}
  WHEN {_any('q', D.SCENARIO_KEYWORDS)} OR {_any('q', ALL_ALIASES)} THEN 'scenario' WHEN {_any('q', D.CLIENT_KEYWORDS)} THEN 'client'
  WHEN {AMBIGUOUS_SQL} AND ({_any('past', D.SCENARIO_KEYWORDS)} OR {_any('past', ALL_ALIASES)}) THEN 'scenario' ELSE 'analysis' END AS intent FROM asked)
SELECT conv_id, turn, intent, CASE WHEN intent = 'scenario' THEN 'pricing_rerun' ELSE 'base_context' END AS answer_source FROM i""")
def classify_intent(spark, sf_dir):
    return D.classify_intent(questions(spark, sf_dir)).select("conv_id", "turn", "intent", "answer_source")


@register("match_fields", f"""
WITH {QUESTIONS}, s AS (SELECT *, CASE WHEN {AMBIGUOUS_SQL} AND NOT {_any('q', ALL_ALIASES)} THEN trim(past || ' ' || q) ELSE q END AS src FROM asked)
SELECT conv_id, turn, concat_ws(',', {', '.join(f"CASE WHEN {_any('src', a)} THEN '{n}' END" for n, a in X.FIELD_ALIASES.items())}) AS matched_fields,
  CASE {' '.join(f"WHEN {_any('src', w)} THEN '{n}'" for n, w in D.DIRECTION_KEYWORDS.items())} ELSE 'increase' END AS direction,
  coalesce(nullif(try_cast(regexp_extract(q, '(-?\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE), 0), try_cast(regexp_extract(past, '(-?\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE), -1) AS percent_hint,
  coalesce(nullif(try_cast(regexp_extract(q, '(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE), 0), -1) AS absolute_hint FROM s""")
def match_fields(spark, sf_dir):
    m = D.match_fields(questions(spark, sf_dir))
    return m.select(
        "conv_id", "turn", F.array_join("matched_fields", ",").alias("matched_fields"), "direction",
        F.coalesce("percent_hint", F.lit(-1.0)).alias("percent_hint"), F.coalesce("absolute_hint", F.lit(-1.0)).alias("absolute_hint"),
    )
