"""Feature rows from quote requests, and metadata lookups from registry tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom import schema as S
from priceloom.functions import values as V


def _request_value(features: Column, feature: str) -> Column:
    return F.element_at(features, F.lit(feature))


def build_feature_rows(requests: DataFrame) -> DataFrame:
    """The 30 model features in order, with a ``warnings`` array.

    Requests have ``features MAP<STRING,STRING>``, ``siren`` and
    ``binding_type``. A feature present in the map wins, then the header value,
    then the default.
    """
    features = F.col("features")
    out: dict[str, Column] = {}
    warnings: list[Column] = []
    for name in S.ALL_FEATURES:
        asked, value = F.map_contains_key(features, F.lit(name)), _request_value(features, name)
        if name in S.CATEGORY_FEATURES:
            header = F.col(name) if name in ("siren", "binding_type") else F.lit(None).cast("string")
            header = F.when(header != "", header)
            out[name] = F.when(asked, V.request_category(value)).otherwise(V.request_category(header))
            continue
        if name in S.FLAG_FEATURES:
            parsed, default = V.request_flag(value, name), F.lit(0)
        elif name in S.COUNT_FEATURES:
            parsed, default = V.request_count(value, name), F.lit(0)
        else:
            parsed, default = V.request_measure(value, name), F.lit(0.0)
        out[name] = F.when(asked, parsed.getField("value")).otherwise(default)
        warnings.append(F.when(asked, parsed.getField("warning")))
    keep = [c for c in requests.columns if c not in {"features", *S.ALL_FEATURES}]
    return requests.select(
        *keep,
        *[column.alias(name) for name, column in out.items()],
        F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def unknown_categories(rows: DataFrame) -> DataFrame:
    """How many rows carry a value outside the vocabulary, per category feature."""
    names = [c for c in S.CATEGORY_FEATURES if c in rows.columns]
    cells = [
        F.struct(F.lit(c).alias("feature"), F.count_if(V.unknown_category(F.col(c), c)).alias("n_unknown"))
        for c in names
    ]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def normalize_category(df: DataFrame, column: str) -> DataFrame:
    """Normalised value and whether it is outside the vocabulary of the column."""
    value = V.request_category(F.col(column))
    return df.withColumns({column: value, f"{column}_unknown": V.unknown_category(value, column)})


def _first_number(source: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.element_at(source, F.lit(k)).try_cast("double") for k in keys])


def tag_metric_lookup(df: DataFrame, tags: str = "tags", metadata: str = "metadata") -> DataFrame:
    """R2 from the first readable tag key, then metadata; other metrics from tags.

    ``performance_<name>`` keys become ``<name>``; rmse, mae, mape and cv_r2 are
    taken under their own name.
    """
    source = F.col(tags)
    r2 = F.coalesce(_first_number(source, S.R2_TAG_KEYS), _first_number(F.col(metadata), S.R2_TAG_KEYS))
    plain = F.map_filter(source, lambda k, v: k.isin("rmse", "mae", "mape", "cv_r2") & v.try_cast("double").isNotNull())
    prefixed = F.map_filter(
        source, lambda k, v: F.startswith(k, F.lit("performance_")) & v.try_cast("double").isNotNull()
    )
    named = F.transform_keys(prefixed, lambda k, v: F.replace(k, F.lit("performance_"), F.lit("")))
    only_plain = F.map_filter(plain, lambda k, v: ~F.map_contains_key(named, k))
    others = F.transform_values(F.map_concat(named, only_plain), lambda k, v: v.try_cast("double"))
    return df.withColumns({"r2": r2, "metrics": others})


def tag_algorithm_formula(df: DataFrame, tags: str = "tags", metadata: str = "metadata") -> DataFrame:
    """Algorithm, formula and explanation flag from tags, then metadata."""
    t, m = F.col(tags), F.col(metadata)
    filled = lambda source, key: F.nullif(F.element_at(source, F.lit(key)), F.lit(""))
    algorithm = F.coalesce(*[filled(source, k) for source in (t, m) for k in S.ALGORITHM_TAG_KEYS])
    formula = F.coalesce(F.element_at(t, F.lit(S.FORMULA_TAG)), F.element_at(m, F.lit("formula")))
    shap = F.lower(F.coalesce(F.element_at(t, F.lit(S.SHAP_TAG)), F.lit("false"))) == "true"
    return df.withColumns({"algorithm": algorithm, "formula": formula, "shap_available": shap})


def parse_importance_json(df: DataFrame, text: str = "importance_json") -> DataFrame:
    """JSON text to ``MAP<STRING,DOUBLE>``; invalid text gives an empty map."""
    parsed = F.from_json(text, "map<string,double>")
    empty = F.create_map().cast("map<string,double>")
    return df.withColumn("feature_importance", F.coalesce(parsed, empty))
