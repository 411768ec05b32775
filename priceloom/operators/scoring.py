"""Batch scoring of quotes with the models of every tier.

A model table has one row per model: ``model_name, model_version, algorithm,
r2, formula, intercept, coefficients MAP<STRING,DOUBLE>, feature_importance``.
Numeric coefficients are keyed by the feature, category coefficients by
``feature=level``; unknown levels add nothing. A table may also have ``trees``
(``histogram_trees.tree_models``), whose leaf values add to the intercept. The prediction is on
the ``log(1 + price)`` scale.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom import schema as S
from priceloom.functions import values as V
from priceloom.functions.scale import BROADCAST_BYTES, BROADCAST_ROWS, bounded_batches, join_lookup, settle, written_bytes
from priceloom.operators.quotes import TIER_TYPE

GLOBAL_MODEL = "PricingModelGlobal"
_MODEL_FIELDS = ["model_version", "algorithm", "r2", "formula", "intercept", "coefficients", "feature_importance"]


def family_model_name(family: Column, kind: str, spelled: bool = False) -> Column:
    return F.concat(F.lit("PricingModel_"), family if spelled else V.model_key(family), F.lit(f"_{kind}"))


def pair_model_name(family: Column, client: Column, kind: str, spelled: bool = False) -> Column:
    parts = (family, client) if spelled else (V.model_key(family), V.model_key(client))
    return F.concat(F.lit("PricingModel_"), parts[0], F.lit("__"), parts[1], F.lit(f"_{kind}"))


def tier_names(family: Column, client: Column, spelled: bool = False) -> dict[str, Column]:
    """Registry name of the model each tier asks for; ``spelled`` names are in registry spelling already."""
    return {
        "global_prediction": F.lit(GLOBAL_MODEL),
        "family_linear": family_model_name(family, "Linear", spelled),
        "family_nonlinear": family_model_name(family, "NonLinear", spelled),
        "couple_linear": pair_model_name(family, client, "Linear", spelled),
        "couple_nonlinear": pair_model_name(family, client, "NonLinear", spelled),
    }


def linear_prediction(
    intercept: Column, coefficients: Column, numbers: Sequence[str] | Mapping[str, Column], categories: Sequence[str]
) -> Column:
    """``intercept + sum(coefficient * feature)`` within the row.

    ``numbers`` may map feature names to the columns that hold them.
    """
    values = numbers if isinstance(numbers, Mapping) else {n: F.col(n).cast("double") for n in numbers}
    total = intercept
    for name, value in values.items():
        total = total + F.coalesce(F.element_at(coefficients, F.lit(name)) * value, F.lit(0.0))
    for name in categories:
        level = F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit(S.MISSING)))
        total = total + F.coalesce(F.element_at(coefficients, level), F.lit(0.0))
    return total


def tree_prediction(trees: Column, numbers: Sequence[str] | Mapping[str, Column], categories: Sequence[str]) -> Column:
    """Sum of the leaves that a row reaches in the trees of its model, 0 without trees.

    Nodes lie in heap order, so that a descent takes as many steps as the tree is deep. A missing number counts as the
    feature's centre; an unknown or missing level goes left.
    """
    values = list(numbers.values()) if isinstance(numbers, Mapping) else [F.col(n).cast("double") for n in numbers]
    numeric = F.array(*values) if values else F.array().cast("array<double>")
    texts = F.array(*[F.col(c).cast("string") for c in categories]) if categories else F.array().cast("array<string>")

    def reached(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree, at)
            above = F.coalesce(F.get(numeric, node["slot"]), node["center"]) > node["cut"]
            same = F.coalesce(F.get(texts, node["slot"] - len(values)) == node["level"], F.lit(False))
            right = F.when(node["slot"] < len(values), above).otherwise(same)
            return F.when(node["slot"] < 0, at).otherwise(2 * at + 1 + right.cast("int"))

        depth = F.sequence(F.lit(2), F.floor(F.log2(F.size(tree) + 1)).cast("int"))
        return F.get(tree, F.aggregate(depth, F.lit(0), step))["value"]

    return F.coalesce(F.aggregate(trees, F.lit(0.0), lambda total, tree: total + reached(tree)), F.lit(0.0))


class TreeTable:
    """The trees of all models of a registry as arrays trees x nodes; a category counts as the place of its level."""

    def __init__(self, names: pa.Array, trees: pa.ListArray, n_numbers: int, n_categories: int) -> None:
        nodes = trees.flatten().flatten()
        slot, level, cut, center, value = (nodes.field(k) for k in ("slot", "level", "cut", "center", "value"))
        slot = slot.to_numpy()
        self.names, self.n_numbers = names, n_numbers
        self.counts = pc.fill_null(pc.list_value_length(trees), 0).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        sizes = pc.list_value_length(trees.flatten()).to_numpy().astype(np.int64)
        width = int(sizes.max(initial=1))
        at = np.repeat(np.arange(len(sizes)) * width - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(slot))
        limit = cut.to_numpy(zero_copy_only=False).copy()
        self.levels = []
        for c in range(n_categories):
            mine = slot == n_numbers + c
            self.levels.append(pc.unique(level.filter(pa.array(mine))))
            if mine.any():
                limit[mine] = pc.index_in(level.filter(pa.array(mine)), self.levels[-1]).to_numpy()
        self.depth = (width + 1).bit_length() - 2

        def placed(values: np.ndarray, empty: float) -> np.ndarray:
            out = np.full(len(sizes) * width, empty, dtype=values.dtype)
            out[at] = values
            return out

        self.width, self.slot, self.limit = width, placed(slot.astype(np.int16), -1), placed(limit, 0.0)
        self.center, self.value = placed(center.to_numpy(zero_copy_only=False), np.nan), placed(value.to_numpy(zero_copy_only=False), 0.0)

    def sums(self, name: pa.Array, numbers: Sequence[pa.Array], categories: Sequence[pa.Array]) -> np.ndarray:
        """What ``tree_prediction`` gives for every row with the model of this name, 0 without one."""
        model = pc.fill_null(pc.index_in(name, self.names), -1).to_numpy()
        counts = np.where(model >= 0, self.counts[model], 0)
        out = np.zeros(len(model))
        rows = np.flatnonzero(counts)
        if not len(rows):
            return out
        columns = []
        for x in numbers:
            values = x.to_numpy(zero_copy_only=False).astype(float)
            # a missing number counts as the centre, one that is not a number lies above every cut
            columns.append(np.where(np.isnan(values) & x.is_valid().to_numpy(zero_copy_only=False), np.inf, values))
        for x, levels in zip(categories, self.levels):
            columns.append(pc.fill_null(pc.index_in(x, levels), -1).to_numpy().astype(float))
        values, first = np.stack(columns), self.first[model]
        for t in range(int(counts.max())):
            rows = rows[counts[rows] > t]
            start = (first[rows] + t) * self.width
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = start + at
                slot = self.slot[node]
                x = values[slot, rows]
                number = slot < self.n_numbers
                above = np.where(np.isnan(x), self.center[node], x) > self.limit[node]
                right = np.where(number, above, x == self.limit[node])
                at = np.where(slot < 0, at, 2 * at + 1 + right)
            out[rows] += self.value[start + at]
        return out


def _tree_sums(table: DataFrame, rows: int, numbers, categories: Sequence[str]) -> Callable[[Column], Column] | None:
    """``tree_prediction`` by the name of the model, for a registry as small as a broadcast; None for a larger one or repeated names."""
    if rows > BROADCAST_ROWS or written_bytes(table) > BROADCAST_BYTES:
        return None
    held = table.select("model_name", "trees").toArrow()
    names = held.column("model_name").combine_chunks()
    if len(pc.unique(names)) < len(names):
        return None
    inputs = list(numbers.values()) if isinstance(numbers, Mapping) else [F.col(n).cast("double") for n in numbers]
    inputs += [F.col(c).cast("string") for c in categories]
    n, spark = len(inputs) - len(categories), table.sparkSession
    shared = spark.sparkContext.broadcast(TreeTable(names, held.column("trees").combine_chunks(), n, len(categories)))
    bounded_batches(spark)

    @F.arrow_udf("double")
    def sums(name: pa.Array, *columns: pa.Array) -> pa.Array:
        return pa.array(shared.value.sums(name, columns[:n], columns[n:]))

    return lambda name: sums(name, *inputs)


def _model_fields(models: DataFrame) -> list[str]:
    return _MODEL_FIELDS + (["trees"] if "trees" in models.columns else [])


def _log_price(model: Callable[[str], Column], fields: Sequence[str], numbers, categories: Sequence[str]) -> Column:
    line = linear_prediction(model("intercept"), model("coefficients"), numbers, categories)
    return line + tree_prediction(model("trees"), numbers, categories) if "trees" in fields else line


def join_model_tiers(
    quotes: DataFrame,
    models: DataFrame,
    family: str = "binding_type",
    client: str = "siren",
    tiers: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Attach the model of every tier as a struct ``<tier>_model``, its fields null without a model.

    The model table is written once and its size decides between broadcast and
    salted joins. Fields join flat and become a struct above the join, so that
    those nobody reads never leave the model table.
    """
    fields = ["model_name", *_model_fields(models)]
    table = settle(models.select(*fields), "models")
    rows = table.count()
    if tiers is None:
        # the registry spelling of both names is worked out once per row
        quotes = quotes.withColumns({"_family": V.model_key(F.col(family)), "_client": V.model_key(F.col(client))})
        tiers = tier_names(F.col("_family"), F.col("_client"), spelled=True)
    for tier, name in tiers.items():
        if tier == "global_prediction":
            # one model for all rows: a scalar, not a join
            only = table.where(F.col("model_name") == GLOBAL_MODEL).select(F.struct(*fields).alias("m"))
            quotes = quotes.withColumns({f"{tier}_model": only.scalar(), f"{tier}_name": name})
            continue
        side = table.select(
            F.col("model_name").alias("_name"), *[F.col(c).alias(f"_m_{c}") for c in fields]
        )
        joined = join_lookup(quotes.withColumn("_name", name), side, ["_name"], settled_rows=rows)
        model = F.struct(*[F.col(f"_m_{c}").alias(c) for c in fields])
        quotes = joined.withColumns({f"{tier}_model": model, f"{tier}_name": F.col("_name")}).drop(
            "_name", *[f"_m_{c}" for c in fields]
        )
    return quotes.drop("_family", "_client")


def _tier_block(tier: str, numbers: Sequence[str], categories: Sequence[str], fields: Sequence[str]) -> Column:
    model = F.col(f"{tier}_model")
    there = model["model_name"].isNotNull()
    log_price = _log_price(lambda f: model[f], fields, numbers, categories)
    # built in the order and with the types of quotes.TIER_TYPE
    return F.struct(
        F.col(f"{tier}_name").alias("model_name"),
        F.coalesce(model["model_version"], F.lit(0).cast("bigint")).alias("model_version"),
        model["algorithm"].alias("algorithm"),
        F.when(there, V.price_from_log(log_price)).otherwise(F.lit(0.0)).alias("prediction"),
        model["r2"].alias("r2"),
        model["formula"].alias("formula"),
        model["feature_importance"].alias("feature_importance"),
        there.alias("available"),
        F.when(~there, F.lit("Model not found")).alias("reason"),
    )


def score_tiers(
    tiered: DataFrame,
    numbers: Sequence[str],
    categories: Sequence[str],
    tiers: Sequence[str] = ("global_prediction", "family_linear", "family_nonlinear", "couple_linear", "couple_nonlinear"),
) -> DataFrame:
    """Turn every ``<tier>_model`` into a prediction block named after the tier."""
    blocks = {t: _tier_block(t, numbers, categories, tiered.schema[f"{t}_model"].dataType.fieldNames()) for t in tiers}
    return tiered.withColumns(blocks).drop(*[f"{t}_model" for t in tiers], *[f"{t}_name" for t in tiers])


def score_quotes(
    quotes: DataFrame,
    models: DataFrame,
    numbers: Sequence[str],
    categories: Sequence[str],
    family: str = "binding_type",
    client: str = "siren",
    tiers: Sequence[str] = ("global_prediction", "family_linear", "family_nonlinear", "couple_linear", "couple_nonlinear"),
) -> DataFrame:
    """``join_model_tiers`` and ``score_tiers`` in one go, for large tables of quotes.

    Each tier is scored right after its join, so that coefficients are dropped
    before the next one and rows stay narrow.
    """
    fields = ["model_name", *_model_fields(models)]
    table = settle(models.select(*fields), "models")
    rows = table.count()
    spelled = quotes.withColumns({"_family": V.model_key(F.col(family)), "_client": V.model_key(F.col(client))})
    names = tier_names(F.col("_family"), F.col("_client"), spelled=True)
    by_name = _tree_sums(table, rows, numbers, categories) if "trees" in fields else None
    if by_name is not None:
        # the trees of all tiers in one pass over the rows; none goes with a row
        fields = [f for f in fields if f != "trees"]
        spelled = spelled.withColumns({f"_trees_{t}": by_name(names[t]) for t in tiers})
    work = [f"_m_{c}" for c in fields]
    for tier in tiers:
        named = spelled.withColumn("_name", names[tier])
        if tier == "global_prediction":
            only = table.where(F.col("model_name") == GLOBAL_MODEL).select(F.struct(*fields).alias("m")).scalar()
            joined = named.withColumns({w: only.getField(w.removeprefix("_m_")) for w in work})
        else:
            side = table.select(
                F.col("model_name").alias("_name"), *[F.col(w.removeprefix("_m_")).alias(w) for w in work]
            )
            joined = join_lookup(named, side, ["_name"], settled_rows=rows)
        there = F.col("_m_model_name").isNotNull()
        log_price = _log_price(lambda f: F.col(f"_m_{f}"), fields, numbers, categories)
        if by_name is not None:
            log_price = log_price + F.col(f"_trees_{tier}")
        kept = {
            "model_name": F.col("_name"),
            "model_version": F.coalesce("_m_model_version", F.lit(0).cast("bigint")),
            "algorithm": F.col("_m_algorithm"),
            "prediction": F.when(there, V.price_from_log(log_price)).otherwise(F.lit(0.0)),
            "r2": F.col("_m_r2"),
            "formula": F.col("_m_formula"),
            "feature_importance": F.col("_m_feature_importance"),
            "available": there,
            "reason": F.when(~there, F.lit("Model not found")),
        }
        spelled = joined.withColumns({f"_{tier}_{k}": c for k, c in kept.items()}).drop("_name", *work)
    block = TIER_TYPE.fieldNames()
    blocks = {t: F.struct(*[F.col(f"_{t}_{k}").alias(k) for k in block]) for t in tiers}
    return spelled.withColumns(blocks).drop("_family", "_client", *[f"_trees_{t}" for t in tiers], *[f"_{t}_{k}" for t in tiers for k in block])
