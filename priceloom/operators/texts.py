"""Answer texts: one deterministic template per intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.operators.formulas import parse_formula

# ---------------------------------------------------------------------------
# Sentences of the answers
# ---------------------------------------------------------------------------

TITLE = "AI ANALYSIS"
MODEL_REASONS = {
    "COUPLE_LINEAR": "The selected model was chosen because the client-specific linear model is prioritized when it is available and its quality threshold is met.",
    "FAMILY_LINEAR": "The selected model was chosen because the family linear model was the best available linear option for this quote.",
    "GLOBAL": "The selected model was chosen because no stronger client or family linear option qualified for this quote.",
}
OTHER_REASON = "The selected model matched the active pricing selection rule."
APPROVE_YES = "This quote looks reliable enough to approve."
APPROVE_REVIEW = "This quote is usable, but it should still be reviewed before approval."
APPROVE_NO = "This quote is not strong enough for direct approval."
FORMULA_AVAILABLE = "A linear pricing formula is available for this selected model."
NO_PROFILE = "No client-specific profile was available for this quote."
NO_COMPARISON = "No client-specific profile was available for this quote, so I cannot say whether the price is high or low for this client."
NO_AVERAGE = "The client profile exists, but the average historical price is missing."
RERUN_REASON = "I reran pricing because this question depends on a changed configuration."
NO_CLIENT = "No client context."
RERUN_ANSWER = "I reran pricing scenarios to answer this question."
DRIVER_RERUN = "I estimated the strongest driver by rerunning comparison scenarios."
DIRECT_DRIVER = "That makes it the strongest direct linear driver among the published formula terms."


def number(value: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", value), F.lit("n/a"))


def signed(value: Column, pattern: str = "%+.4f") -> Column:
    return F.coalesce(F.format_string(pattern, value), F.lit("n/a"))


def signed_percent(value: Column) -> Column:
    return signed(value, "%+.2f%%")


def percent(value: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", value), F.lit("n/a"))


def plain(value: Column) -> Column:
    """Whole numbers without decimals, others with four."""
    whole = F.round(value)
    return F.when(F.abs(value - whole) <= 1e-9 * F.greatest(F.abs(value), F.abs(whole)), whole.cast("bigint").cast("string")).otherwise(
        F.format_string("%.4f", value)
    )


def line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value)


def sentence(text: Column | str) -> Column:
    return F.concat(F.lit("- "), F.lit(text) if isinstance(text, str) else text)


def answer(heading: str, *lines: Column) -> Column:
    """Title, blank line, heading, then the lines that are not null."""
    return F.array_join(F.array_compact(F.array(F.lit(TITLE), F.lit(""), F.lit(heading), *lines)), "\n")


def narrative_context(quotes: DataFrame) -> DataFrame:
    """Flat columns the templates read, from an explained quote with confidence and action."""
    e, s = F.col("explanation"), F.col("selected")
    flat = quotes.withColumns({
        "t_price": s["price"], "t_strategy": s["strategy"], "t_model": s["model_name"], "t_r2": s["r2"],
        "t_formula": e["formula"], "t_type": e["explanation_type"], "t_driver": F.get(e["top_drivers"], F.lit(0)),
        "t_drivers": F.slice(e["top_drivers"], 1, 5),
    })
    parsed = parse_formula(flat.drop("formula").withColumnRenamed("t_formula", "formula"))
    return parsed.withColumnRenamed("formula", "t_formula").withColumnRenamed("strongest", "t_term").drop("terms")


def _or_na(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("n/a"))


def _found() -> Column:
    return F.coalesce(F.col("client_found"), F.lit(False))


def _client_line(name: str, label: str, pattern: str) -> Column:
    return F.when(F.col(name).isNotNull(), line(label, F.format_string(pattern, F.col(name))))


def client_sentence(columns: list[str]) -> Column:
    """One sentence on a known client: its number, elasticity and mean price, as far as known."""
    known = lambda name, label: (
        F.when(F.col(name).isNotNull(), F.format_string(f", {label} %.4f", F.col(name))) if name in columns else F.lit(None)
    )
    return F.concat(
        F.lit("Client "), F.coalesce(F.nullif(F.col("siren"), F.lit("")), F.lit("n/a")), F.lit(" profile is available"),
        F.coalesce(known("client_price_elasticity", "elasticity"), F.lit("")),
        F.coalesce(known("client_avg_price_ht", "average historical price HT"), F.lit("")), F.lit("."),
    )


def _has_scenarios(quotes: DataFrame) -> bool:
    return "scenarios" in quotes.columns



def scenario_answer(question: Column) -> Column:
    """Answer over ``scenarios``: one result, the strongest, or the list of all.

    ``scenarios`` is an array of ``struct<field_label, old_value, new_value,
    base_price, scenario_price, delta_price, delta_percent>``, one per field.
    """
    results = F.col("scenarios")
    one = F.get(results, F.lit(0))
    tail = [line("Selected strategy", _or_na("t_strategy")), line("Selected model", _or_na("t_model"))]
    single = answer(
        "Scenario result",
        line("Question", question),
        line("Changed field", one["field_label"]),
        line("Old value", plain(one["old_value"])),
        line("New value", plain(one["new_value"])),
        line("Base selected price", number(one["base_price"])),
        line("New predicted price", number(one["scenario_price"])),
        line("Price delta", signed(one["delta_price"])),
        line("Price delta percent", signed_percent(one["delta_percent"])),
        line("Selected model", _or_na("t_model")),
        line("Confidence", F.col("confidence")),
    )
    top = strongest_of(results)
    biggest = answer(
        "Scenario comparison",
        sentence(RERUN_ANSWER),
        sentence(F.concat(F.lit("The biggest impact came from "), top["field_label"], F.lit("."))),
        sentence(F.concat(
            F.lit("Its simulated price movement was "), signed_percent(top["delta_percent"]), F.lit(" ("), signed(top["delta_price"]), F.lit(")."),
        )),
        line("Base selected price", number(F.col("t_price"))),
        *tail,
    )
    moves = F.transform(results, lambda r: F.concat(
        F.lit("- "), r["field_label"], F.lit(": "), plain(r["old_value"]), F.lit(" -> "), plain(r["new_value"]), F.lit(", price "),
        number(r["base_price"]), F.lit(" -> "), number(r["scenario_price"]), F.lit(" ("), signed_percent(r["delta_percent"]), F.lit(")."),
    ))
    every = answer(
        "Scenario comparison", sentence(RERUN_REASON), F.array_join(moves, "\n"), *tail, line("Confidence", F.col("confidence"))
    )
    q = F.lower(question)
    asks_top = F.contains(q, F.lit("most")) | F.contains(q, F.lit("biggest")) | F.contains(q, F.lit("strongest"))
    return F.when(F.size(results) == 1, single).when(asks_top, biggest).otherwise(every)


def strongest_of(results: Column) -> Column:
    sizes = F.transform(results, lambda r: F.abs(F.coalesce(r["delta_percent"], F.lit(0.0))))
    return F.try_element_at(results, F.array_position(sizes, F.array_max(sizes)).cast("int"))


def quote_narrative(quotes: DataFrame, question: str | None = None) -> DataFrame:
    """Add ``answer`` for the ``intent`` of each row; see ``narrative_context`` for the input."""
    price = line("Selected price", number(F.col("t_price")))
    strategy, model = line("Selected strategy", _or_na("t_strategy")), line("Selected model", _or_na("t_model"))
    confidence, action = line("Confidence", F.col("confidence")), line("Recommended action", F.col("action"))
    r2 = F.when(F.col("t_r2").isNotNull(), line("Model R2", number(F.col("t_r2"))))
    formula, has_formula = F.col("t_formula"), F.coalesce(F.col("t_formula") != "", F.lit(False))
    driver, term = F.col("t_driver"), F.col("t_term")
    head = [price, strategy, model]

    formula_text = F.when(
        has_formula, answer("Formula", strategy, model, price, line("Formula", formula), confidence, action)
    ).otherwise(answer(
        "Formula",
        sentence(F.concat(F.lit("No explicit linear formula is available for the selected model "), _or_na("t_model"), F.lit("."))),
        line("Explanation type returned by pricing", _or_na("t_type")), strategy, confidence, action,
    ))
    why = answer(
        "Why this price", *head,
        F.when(has_formula, sentence(FORMULA_AVAILABLE)),
        F.when(term.isNotNull(), sentence(F.concat(
            F.lit("The strongest formula coefficient is "), term["feature"], F.lit(" ("), signed(term["coefficient"]), F.lit(")."),
        ))),
        F.when(driver.isNotNull(), sentence(F.concat(
            F.lit("Top driver in the pricing explanation: "), driver["name"], F.lit(" ("), percent(driver["importance"]), F.lit(")."),
        ))),
        confidence, action,
        F.when(_found(), F.concat(F.lit("\nClient context\n- "), client_sentence(quotes.columns))),
        F.when(has_formula, F.concat(F.lit("\nFormula\n- "), formula)),
    )
    driver_text = F.when(driver.isNotNull(), answer(
        "Top driver",
        sentence(F.concat(
            F.lit("The strongest driver returned by the pricing explanation is "), driver["name"], F.lit(" ("), percent(driver["importance"]), F.lit(")."),
        )),
        strategy, model, price, confidence,
    )).when(term.isNotNull(), answer(
        "Top driver",
        sentence(F.concat(
            F.lit("Based on the linear formula, the largest absolute coefficient is "), term["feature"], F.lit(" ("), signed(term["coefficient"]), F.lit(")."),
        )),
        sentence(DIRECT_DRIVER), strategy, model, price,
    ))
    summary = answer(
        "Pricing summary", *head, confidence, action,
        F.when(has_formula, F.concat(F.lit("\nFormula\n- "), formula)),
        F.when(F.size("t_drivers") > 0, F.concat(F.lit("\nKey price drivers\n"), F.array_join(
            F.transform("t_drivers", lambda d: F.concat(F.lit("- "), d["name"], F.lit(": "), percent(d["importance"]))), "\n"
        ))),
        F.concat(F.lit("\nClient context\n"), F.when(_found(), F.col("explanation")["client_context"]).otherwise(F.lit(NO_CLIENT))),
    )
    if _has_scenarios(quotes):
        top = strongest_of(F.col("scenarios"))
        driver_text = driver_text.when(F.size("scenarios") > 0, answer(
            "Top driver", sentence(DRIVER_RERUN),
            sentence(F.concat(
                F.lit("The largest movement came from "), top["field_label"], F.lit(" with "), signed_percent(top["delta_percent"]), F.lit(" on price."),
            )),
            line("Base selected price", number(F.col("t_price"))), model,
        ))
    driver_text = driver_text.otherwise(summary)

    reason = F.lit(OTHER_REASON)
    for name, text in MODEL_REASONS.items():
        reason = F.when(F.col("t_strategy") == name, F.lit(text)).otherwise(reason)
    selection = answer(
        "Model selection", strategy, model, sentence(reason), r2,
        F.when(has_formula, sentence("A linear formula is available for this selected model.")), price,
    )
    verdict = (
        F.when((F.col("confidence") == "HIGH") & (F.col("action") == "APPROVE"), APPROVE_YES)
        .when(F.col("confidence") == "MEDIUM", APPROVE_REVIEW).otherwise(APPROVE_NO)
    )
    approval = answer("Approval decision", sentence(verdict), confidence, action, strategy, model, price, r2)
    act = answer("Recommended action", line("Action", F.col("action")), confidence, strategy, model, price)
    sure = answer(
        "Confidence", line("Confidence level", F.col("confidence")), strategy, model, r2,
        F.when(has_formula, sentence("A linear formula is available, which improves interpretability.")), action,
    )
    mean, delta = F.col("client_avg_price_ht"), F.col("t_price") - F.col("client_avg_price_ht")
    elasticity = _client_line("client_price_elasticity", "Client price elasticity", "%.4f")
    client = F.when(_found(), answer(
        "Client context", line("Client code", F.coalesce("siren", F.lit("n/a"))), line("Client found", F.lit("True")),
        _client_line("client_price_elasticity", "Price elasticity", "%.4f"),
        _client_line("client_avg_price_ht", "Average historical price HT", "%.4f"),
        _client_line("client_seniority_years", "Seniority in years", "%.2f"),
        _client_line("client_nb_orders", "Historical orders", "%d"), price,
    )).otherwise(answer("Client context", sentence(NO_PROFILE)))
    level = F.when(delta < 0, "below").when(delta < 1e-9, "equal to").otherwise("above")
    comparison = F.when(~_found(), answer("Client comparison", sentence(NO_COMPARISON))).when(
        mean.isNull() | F.col("t_price").isNull(), answer("Client comparison", sentence(NO_AVERAGE))
    ).otherwise(answer(
        "Client comparison",
        sentence(F.concat(F.lit("This quote is "), level, F.lit(" the client's historical average price."))),
        price, line("Client average historical price HT", number(mean)),
        F.when(mean != 0, line("Difference vs client average", signed_percent(F.try_divide(delta, mean) * 100))), elasticity,
    ))
    by_intent = {
        "formula": formula_text, "driver": driver_text, "model_selection": selection, "approval": approval,
        "client": client, "client_price_level": comparison, "action": act, "confidence": sure,
    }
    intent = F.col("intent")
    names = list(by_intent)
    text = F.when(intent == names[0], by_intent[names[0]])
    for name in names[1:]:
        text = text.when(intent == name, by_intent[name])
    if _has_scenarios(quotes):
        asked = F.col(question) if question else F.lit("")
        text = text.when(F.size("scenarios") > 0, scenario_answer(asked))
    return quotes.withColumn("answer", text.otherwise(why))
