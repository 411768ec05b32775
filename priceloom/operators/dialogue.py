"""Questions about quotes: history, intent, fields and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceloom.operators.scenarios import FIELD_ALIASES

# ---------------------------------------------------------------------------
# Keyword rules, in the order they are tried
# ---------------------------------------------------------------------------

INTENT_KEYWORDS = {
    "formula": ["formula", "equation", "linear formula", "formula of the price", "coefficient"],
    "driver": [
        "driver", "most important feature", "main feature", "drives the price", "drives price",
        "influences the price", "influence the price",
    ],
    "model_selection": [
        "why was this model selected", "why this model", "why was this strategy selected",
        "why this strategy", "why linear strategy", "why couple linear",
    ],
    "approval": ["approve", "approval", "reliable enough to approve", "can i approve", "should i approve"],
    "client_price_level": [
        "high or low for this client", "high for this client", "low for this client",
        "compare to the client average", "above the client average", "below the client average",
    ],
    "action": ["what action", "recommended action", "what do you recommend", "recommendation"],
    "confidence": ["confidence", "reliability", "how reliable", "why low", "why medium", "why high"],
    "analysis": [
        "why this price", "why this quote", "explain this price", "explain the price", "why this amount",
        "why this value",
    ],
}
CLIENT_KEYWORDS = ["client", "customer", "elasticity", "elasticite", "sensitivity"]
SCENARIO_KEYWORDS = [
    "if", "what if", "impact", "increase", "decrease", "change", "raise", "lower", "more", "less",
    "augmente", "augmenter", "baisse", "diminue",
]
AMBIGUOUS_REFERENCES = ["this", "that", "it", "them", "those", "these", "same", "again"]
DIRECTION_KEYWORDS = {
    "decrease": ["decrease", "lower", "reduce", "less", "baisse", "diminuer", "diminue"],
    "disable": ["remove", "without", "disable"],
    "enable": ["add", "with", "enable"],
}
PERCENT_HINT = r"(-?\d+(?:\.\d+)?)\s*%"
NUMBER_HINT = r"(-?\d+(?:\.\d+)?)"
HISTORY_TURNS = 8
# Turn numbers per piece of a conversation, see ``history_window``.
PIECE_TURNS = 1024


def _last(items: Column, k: int) -> Column:
    return F.when(F.size(items) > k, F.slice(items, F.size(items) - (k - 1), F.lit(k))).otherwise(items)


def history_window(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    k: int = HISTORY_TURNS,
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """Add ``history``: the user texts among the last ``k`` turns before each turn.

    Conversations are cut into pieces by turn number; the last ``k`` turns of
    the earlier pieces are carried into the next one. A conversation of any
    length is thus spread over tasks, with the same result.
    """
    said = F.struct(
        F.col(turn).alias("turn"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    cut = turns.withColumns({"_piece": F.floor(F.col(turn) / piece_turns), "_said": said})
    order = [F.col("_said.turn"), F.col("_said.role"), F.col("_said.text")]
    newest = Window.partitionBy(conversation, "_piece").orderBy(*[c.desc() for c in order])
    tails = (
        cut.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= k)
        .groupBy(conversation, "_piece")
        .agg(F.sort_array(F.collect_list("_said")).alias("_tail"))
    )
    earlier = Window.partitionBy(conversation).orderBy("_piece").rowsBetween(-k, -1)
    carried = tails.select(
        conversation, "_piece", _last(F.flatten(F.collect_list("_tail").over(earlier)), k).alias("_carried")
    )
    before = Window.partitionBy(conversation, "_piece").orderBy(*order).rowsBetween(-k, -1)
    seen = F.concat(F.col("_carried"), F.collect_list("_said").over(before))
    users = F.filter(_last(seen, k), lambda s: s["role"] == "user")
    return (
        cut.join(carried, [conversation, "_piece"])
        .withColumn("history", F.array_join(F.transform(users, lambda s: s["text"]), " "))
        .drop("_piece", "_said", "_carried")
    )


def normalize_text(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def mentions(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def fields_in(text: Column) -> Column:
    """Names of the fields with an alias in the text, in declared order."""
    return F.array_compact(F.array(*[F.when(mentions(text, a), F.lit(n)) for n, a in FIELD_ALIASES.items()]))


def any_field_in(text: Column) -> Column:
    return mentions(text, [alias for aliases in FIELD_ALIASES.values() for alias in aliases])


def is_ambiguous(text: Column) -> Column:
    return (F.length(F.trim(text)) <= 20) | mentions(text, AMBIGUOUS_REFERENCES)


def classify_intent(questions: DataFrame, question: str = "question", history: str = "history") -> DataFrame:
    """Add ``intent`` and ``answer_source``; both inputs are normalised here."""
    q, past = normalize_text(F.col(question)), normalize_text(F.col(history))
    names = list(INTENT_KEYWORDS)
    intent = F.when(mentions(q, INTENT_KEYWORDS[names[0]]), names[0])
    for name in names[1:]:
        intent = intent.when(mentions(q, INTENT_KEYWORDS[name]), name)
    moves = mentions(q, SCENARIO_KEYWORDS) | any_field_in(q)
    follow_up = is_ambiguous(q) & (mentions(past, SCENARIO_KEYWORDS) | any_field_in(past))
    intent = intent.when(moves, "scenario").when(mentions(q, CLIENT_KEYWORDS), "client")
    intent = intent.when(follow_up, "scenario").otherwise("analysis")
    source = F.when(F.col("intent") == "scenario", "pricing_rerun").otherwise("base_context")
    return questions.withColumn("intent", intent).withColumn("answer_source", source)


def match_fields(questions: DataFrame, question: str = "question", history: str = "history") -> DataFrame:
    """Add the matched fields, the direction and the hints of a question.

    An ambiguous question without fields is read together with its history.
    """
    q, past = normalize_text(F.col(question)), normalize_text(F.col(history))
    source = F.when(is_ambiguous(q) & ~any_field_in(q), F.trim(F.concat_ws(" ", past, q))).otherwise(q)
    direction = None
    for name, words in DIRECTION_KEYWORDS.items():
        hit = mentions(source, words)
        direction = F.when(hit, name) if direction is None else direction.when(hit, name)
    percent = lambda text: F.nullif(F.regexp_extract(text, PERCENT_HINT, 1), F.lit("")).try_cast("double")
    number = F.nullif(F.regexp_extract(q, NUMBER_HINT, 1), F.lit("")).try_cast("double")
    from_question = F.nullif(percent(q), F.lit(0.0))
    return questions.withColumns({
        "matched_fields": fields_in(source),
        "direction": direction.otherwise("increase"),
        "percent_hint": F.coalesce(from_question, percent(past)),
        "absolute_hint": F.nullif(number, F.lit(0.0)),
    })
