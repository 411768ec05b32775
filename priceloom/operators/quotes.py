"""Quote decisions: tier choice, confidence, action, explanation, texts.

A scored quote has one nullable struct per tier, named as in ``TIERS``::

    struct<model_name, model_version, algorithm, prediction, r2, formula,
           feature_importance, available, reason>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.functions import values as V

# Tier priority, strategies and labels.
TIERS = ["couple_linear", "family_linear", "global_prediction", "couple_nonlinear", "family_nonlinear"]
SUMMARY_ORDER = ["global_prediction", "family_linear", "family_nonlinear", "couple_linear", "couple_nonlinear"]
STRATEGY_OF = {"couple_linear": "COUPLE_LINEAR", "family_linear": "FAMILY_LINEAR", "global_prediction": "GLOBAL"}
SUMMARY_LABELS = {
    "global_prediction": "Global model",
    "family_linear": "Family linear",
    "family_nonlinear": "Family nonlinear",
    "couple_linear": "Client-family linear",
    "couple_nonlinear": "Client-family nonlinear",
}
SUMMARY_NAMES = {**{t: t for t in SUMMARY_ORDER}, "global_prediction": "global"}
MIN_R2 = 0.60

TIER_TYPE = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.LongType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("formula", T.StringType()),
    T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("available", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])


def _available(tier: str) -> Column:
    return F.coalesce(F.col(tier)["available"], F.lit(False))


def filter_available_predictions(quotes: DataFrame) -> DataFrame:
    """Add ``predictions``: the available tiers in priority order."""
    entries = F.array(*[
        F.when(
            _available(t),
            F.struct(
                F.lit(t).alias("key"),
                *[F.col(t)[f].alias(f) for f in ("model_name", "prediction", "r2", "formula")],
            ),
        )
        for t in TIERS
    ])
    return quotes.withColumn("predictions", F.array_compact(entries))


def _candidate(tier: str, needs_r2: bool) -> Column:
    block = F.col(tier)
    usable = _available(tier) & block["prediction"].isNotNull()
    if needs_r2:
        usable = usable & (F.coalesce(block["r2"], F.lit(-1.0)) >= MIN_R2)
    return F.when(
        usable,
        F.struct(
            F.lit(tier).alias("key"),
            F.lit(STRATEGY_OF[tier]).alias("strategy"),
            block["prediction"].alias("price"),
            F.coalesce(block["model_name"], F.lit(tier)).alias("model_name"),
            block["r2"].alias("r2"),
        ),
    )


def siren_known(siren: Column) -> Column:
    text = F.trim(F.coalesce(siren, F.lit("")))
    return (text != "") & (F.upper(text) != "NONE")


def quote_select_tier(quotes: DataFrame) -> DataFrame:
    """Add ``selected``: pair linear for a known client, family linear, then global."""
    couple = F.when(siren_known(F.col("siren")), _candidate("couple_linear", True))
    return quotes.withColumn(
        "selected",
        F.coalesce(couple, _candidate("family_linear", True), _candidate("global_prediction", False)),
    )


def closest_prediction(predictions: Column, price: Column) -> Column:
    """Prediction nearest to a price; the earlier one wins a tie."""
    usable = F.filter(predictions, lambda p: p["prediction"].isNotNull())
    gaps = F.transform(usable, lambda p: F.abs(p["prediction"] - price))
    where = F.array_position(gaps, F.array_min(gaps)).cast("int")
    return F.when(price.isNotNull() & (F.size(usable) > 0), F.try_element_at(usable, where))


def quote_select_override(
    quotes: DataFrame,
    model: str = "asked_model",
    strategy: str = "asked_strategy",
    price: str = "asked_price",
) -> DataFrame:
    """Add ``best_model``: named model, else strategy, else closest price, else the first."""
    p = F.col("predictions")
    named = F.filter(p, lambda x: F.lower(x["model_name"]) == F.lower(F.col(model)))
    key = F.element_at(
        F.create_map(*[F.lit(x) for t, s in STRATEGY_OF.items() for x in (s, t)]), F.upper(F.col(strategy))
    )
    by_strategy = F.filter(p, lambda x: x["key"] == key)
    return quotes.withColumn(
        "best_model",
        F.coalesce(F.get(named, F.lit(0)), F.get(by_strategy, F.lit(0)), closest_prediction(p, F.col(price)), F.get(p, F.lit(0))),
    )


def quote_confidence(quotes: DataFrame, strategy: Column, formula: Column, r2: Column) -> DataFrame:
    """Confidence from the fit of the chosen model, else from the spread of the tiers' prices."""
    # functions of the whole array, not of its elements: the optimizer then works out the five prices once per row
    quotes = quotes.withColumn("_prices", F.array(*[F.when(_available(t), F.col(t)["prediction"]) for t in TIERS]))
    prices = F.col("_prices")
    n = F.size(F.array_compact(prices))
    total = F.aggregate(prices, F.lit(0.0), lambda a, p: a + F.coalesce(p, F.lit(0.0)))
    mean = F.try_divide(total, n)
    spread = F.try_divide(F.array_max(prices) - F.array_min(prices), mean) * 100
    linear = F.coalesce(F.upper(strategy).isin("COUPLE_LINEAR", "FAMILY_LINEAR"), F.lit(False))
    explained = F.coalesce(formula != "", F.lit(False)) | linear
    return quotes.withColumn(
        "confidence",
        F.when(r2 >= 0.90, "HIGH")
        .when(r2 >= 0.75, "MEDIUM")
        .when((r2 >= 0.60) & explained, "MEDIUM")
        .when((n < 2) | (mean == 0), "LOW")
        .when(spread <= 5, "HIGH")
        .when(spread <= 15, "MEDIUM")
        .otherwise("LOW"),
    ).drop("_prices")


def quote_action(quotes: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return quotes.withColumn(
        "action", F.when(c == "HIGH", "APPROVE").when(c == "MEDIUM", "REVIEW").otherwise("MANUAL_REVIEW")
    )


def quote_summary(quotes: DataFrame) -> DataFrame:
    """Number and names of available predictions, client flag, warnings (null when none)."""
    names = F.array_compact(F.array(*[F.when(_available(t), F.lit(SUMMARY_NAMES[t])) for t in SUMMARY_ORDER]))
    found = F.coalesce(F.col("client_found"), F.lit(False)) if "client_found" in quotes.columns else F.lit(False)
    out = {"models_used": names, "predictions_available": F.size(names), "client_features_found": found}
    if "warnings" in quotes.columns:
        out["warnings"] = F.when(F.size("warnings") > 0, F.col("warnings"))
    return quotes.withColumns(out)


def client_price_level(quotes: DataFrame, price: str = "price", mean: str = "client_avg_price_ht") -> DataFrame:
    """Above, below or equal to the client's mean price, with the percent difference."""
    delta = F.col(price) - F.col(mean)
    # the sign is looked at first: a tiny negative difference is still below
    level = F.when(delta < 0, "below").when(delta < 1e-9, "equal to").when(delta >= 1e-9, "above")
    return quotes.withColumns({"price_level": level, "level_percent": F.try_divide(delta, F.col(mean)) * 100})


def price_delta(df: DataFrame, base: str = "base_price", new: str = "scenario_price") -> DataFrame:
    return df.withColumns({
        "delta_price": V.price_delta(F.col(base), F.col(new)),
        "delta_percent": V.percent_delta(F.col(base), F.col(new)),
    })


# --- explanation -----------------------------------------------------------


def _number(value: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", value), F.lit("n/a"))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("n/a"))


def top_drivers(importance: Column, k: int = 6) -> Column:
    """The ``k`` largest positive importances as an array of ``struct<name, importance>``."""
    entries = F.filter(F.map_entries(importance), lambda e: e["value"] > 0)
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    drivers = F.transform(ranked, lambda e: F.struct(e["k"].alias("name"), (-e["v"]).alias("importance")))
    return F.coalesce(F.slice(drivers, 1, k), F.array().cast("array<struct<name:string,importance:double>>"))


def explanation_type(block: Column, shap: Column | None = None) -> Column:
    kind = F.when(F.coalesce(block["formula"] != "", F.lit(False)), "FORMULA")
    if shap is not None:
        kind = kind.when(F.coalesce(shap, F.lit(False)), "SHAP")
    return kind.when(block["feature_importance"].isNotNull(), "FEATURE_IMPORTANCE").otherwise("MODEL_SUMMARY")


def client_context(quotes: DataFrame) -> Column:
    """One sentence about the client; needs the client feature columns and ``client_found``."""
    profile = F.concat(
        F.lit("Client profile found for "), _text(F.col("siren")), F.lit(" with "), _text(F.col("client_nb_orders")),
        F.lit(" historical orders, average price HT "), _number(F.col("client_avg_price_ht")),
        F.lit(", seniority "), _text(F.col("client_seniority_years")), F.lit(" years, recency "),
        _text(F.col("client_recency_days")), F.lit(" days."),
    )
    unknown = F.concat(F.lit("No historical client profile was found for "), F.col("siren"), F.lit("."))
    return (
        F.when(F.coalesce(F.col("client_found"), F.lit(False)), profile)
        .when(F.trim(F.coalesce("siren", F.lit(""))) != "", unknown)
        .otherwise(F.lit("No client-specific context was used."))
    )


def _selected_block() -> Column:
    key = F.coalesce(F.col("selected")["key"], F.lit("global_prediction"))
    return (
        F.when(key == "couple_linear", F.col("couple_linear"))
        .when(key == "family_linear", F.col("family_linear"))
        .otherwise(F.col("global_prediction"))
    )


def quote_explanation(quotes: DataFrame) -> DataFrame:
    """Add ``explanation``: source, type, formula, client context, insights, drivers, summaries."""
    block = F.col("_block")
    rows = quotes.withColumn("_block", _selected_block())
    kind = explanation_type(block)
    drivers = top_drivers(block["feature_importance"], 6)
    picked = F.col("selected")
    lead = F.concat(
        F.lit("Selected strategy: "), _text(picked["strategy"]), F.lit(" via model "), _text(picked["model_name"]),
        F.lit(" with suggested unit price "), _number(picked["price"]), F.lit("."),
    )
    fit = F.when(block["r2"].isNotNull(), F.concat(F.lit("Model fit (R2): "), _number(block["r2"]), F.lit(".")))
    named = F.transform(
        F.slice(drivers, 1, 3), lambda d: F.concat(d["name"], F.lit(" ("), _number(d["importance"]), F.lit(")"))
    )
    main = F.when(
        F.size(drivers) > 0,
        F.concat(F.lit("Main drivers from the selected explanation: "), F.concat_ws(", ", named), F.lit(".")),
    )
    closing = F.when(kind == "FORMULA", "A linear formula is available for this selected model.").when(
        kind == "FEATURE_IMPORTANCE", "The selected model exposes feature-importance style explanations."
    )
    summaries = F.array_compact(F.array(*[
        F.when(
            F.col(t)["model_name"].isNotNull(),
            F.struct(
                F.lit(t).alias("key"),
                F.lit(SUMMARY_LABELS[t]).alias("label"),
                F.col(t)["model_name"].alias("model_name"),
                F.col(t)["prediction"].alias("prediction"),
                F.col(t)["r2"].alias("r2"),
                F.col(t)["available"].alias("available"),
                explanation_type(F.col(t)).alias("explanation_type"),
            ),
        )
        for t in SUMMARY_ORDER
    ]))
    key = F.coalesce(picked["key"], F.lit("global_prediction"))
    return rows.withColumn(
        "explanation",
        F.struct(
            key.alias("source_key"),
            F.coalesce(block["model_name"], key).alias("source_label"),
            kind.alias("explanation_type"),
            block["formula"].alias("formula"),
            client_context(quotes).alias("client_context"),
            F.array_compact(F.array(lead, fit, main, closing)).alias("key_insights"),
            drivers.alias("top_drivers"),
            summaries.alias("model_summaries"),
        ),
    ).drop("_block")
