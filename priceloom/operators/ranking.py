"""Ranks, registry versions, samples, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceloom.functions import values as V
from priceloom.functions.distribution import nth_values_unique, overall, quantiles_of
from priceloom.functions.scale import join_lookup, settle

# Metric and direction each level is ranked by.
RANK_RULES = {"global": ("rmse", "asc"), "linear": ("cv_r2", "desc"), "nonlinear": ("r2", "desc")}


def _metric_order(rule: str) -> Column:
    metric, direction = RANK_RULES[rule]
    return F.asc_nulls_last(metric) if direction == "asc" else F.desc_nulls_last(metric)


def rank_models(candidates: DataFrame, by: Sequence[str], rule: str, tie: str = "candidate_order") -> DataFrame:
    """Rank the candidates of a group, ``selected`` yes for the first. A group holds one row per candidate."""
    order = Window.partitionBy(*by).orderBy(_metric_order(rule), F.asc(tie))
    return candidates.withColumn("rank", F.row_number().over(order)).withColumn(
        "selected", F.when(F.col("rank") == 1, "yes").otherwise("no")
    )


def best_model_per_group(candidates: DataFrame, by: Sequence[str], rule: str, tie: str = "candidate_order") -> DataFrame:
    """First candidate of every group; earlier candidates win ties."""
    order = Window.partitionBy(*by).orderBy(_metric_order(rule), F.asc(tie))
    return candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def target_quantile_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Add ``bin``: position among the distinct quantile edges, equal edges merged.

    The edges are one small array computed from value counts; rows are placed
    by comparing with it, so there is no ordering of the whole frame.
    """
    probs = {f"_e{k}": k / bins for k in range(bins + 1)}
    edges = settle(quantiles_of(settle(df.select(value), "values"), [], value, probs), "edges")
    cuts = edges.select(F.array_distinct(F.array(*list(probs))).alias("edges")).scalar()
    return df.withColumn("_edges", cuts).withColumn(
        "bin",
        F.greatest(
            F.size(F.filter("_edges", lambda edge: edge < F.col(value))) - 1,
            F.lit(0),
        ),
    ).drop("_edges")


def stratified_split(
    df: DataFrame, stratum: str, key: str, test_share: float = 0.25
) -> DataFrame:
    """Add ``part``: exactly the rounded share of every stratum is ``test``.

    The rows with the smallest key hashes form the test part. The threshold hash
    of each stratum is found by counting, so no stratum is ever sorted in one
    task. Keys must be unique.
    """
    hashed = df.withColumn("_h", V.stable_hash(F.col(key).cast("string")).cast("double"))
    last = F.round(F.col("total") * F.lit(test_share)).cast("bigint") - 1
    wanted = F.array(F.struct(F.lit(0).alias("i"), last.alias("rank")))
    # the threshold reads the rows twice: written, the plan behind them runs once for it
    hashes = settle(hashed.select(stratum, F.col("_h").alias("value")), "hashes")
    limits = nth_values_unique(hashes, [stratum], wanted).select(stratum, F.col("value").alias("_limit"))
    return (
        join_lookup(hashed, limits, [stratum])
        .withColumn("part", F.when(F.col("_h") <= F.col("_limit"), "test").otherwise("train"))
        .drop("_h", "_limit")
    )


def plain_split(df: DataFrame, key: str, test_share: float = 0.2) -> DataFrame:
    """Split without strata, used for groups and when strata are too small."""
    return stratified_split(overall(df), "_all", key, test_share).drop("_all")


def kfold_assign(df: DataFrame, key: Column, folds: int = 5) -> DataFrame:
    """Fold number from the key hash: stable under repartitioning and retries."""
    return df.withColumn("fold", F.pmod(V.stable_hash(key), F.lit(folds)).cast("int"))


def seeded_sample(df: DataFrame, key: Column, n: int = 100) -> DataFrame:
    """``n`` reproducible rows: the smallest key hashes, kept per task before they are merged."""
    return df.withColumn("_h", F.md5(key)).orderBy("_h").limit(n).drop("_h")


def prediction_examples(df: DataFrame, key: Column, n: int = 10, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return seeded_sample(df, key, n).withColumns({
        "abs_error": F.abs(e),
        "pct_error": F.when(y > 0, F.abs(e / y * 100)).otherwise(F.lit(0.0)),
    })


def topk_feature_importance(df: DataFrame, by: Sequence[str], k: int = 50, importance: str = "importance", positive_only: bool = False) -> DataFrame:
    """The ``k`` largest importances per model; ``positive_only`` for the drivers of a quote."""
    rows = df.where(F.col(importance) > 0) if positive_only else df
    order = Window.partitionBy(*by).orderBy(F.desc(importance), F.asc("feature"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def latest_version(versions: DataFrame, name: str = "model_name", version: str = "version") -> DataFrame:
    """Latest version per model, the one it replaces, and the resulting alias states.

    Two rows per model survive each task, so a model with many versions is cheap.
    """
    order = Window.partitionBy(name).orderBy(F.desc(version))
    top = versions.select(name, version).distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
    return top.groupBy(name).agg(
        F.max(F.when(F.col("_r") == 1, F.col(version))).alias("production_version"),
        F.max(F.when(F.col("_r") == 2, F.col(version))).alias("archived_version"),
    )


def registry_listing(versions: DataFrame) -> DataFrame:
    """Every version with its lifecycle state: ``production``, ``archived`` or none."""
    states = settle(latest_version(versions), "registry")
    state = F.when(F.col("version") == F.col("production_version"), "production").when(
        F.col("version") == F.col("archived_version"), "archived"
    )
    return join_lookup(versions, states, ["model_name"]).withColumn("lifecycle_status", state)
