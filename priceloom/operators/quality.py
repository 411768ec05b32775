"""Reports on columns, groups, predictions and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceloom import schema as S
from priceloom.functions.distribution import quantiles_of


def _melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str], kind: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.column", "_c.value")


def value_frequencies(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Per column the number of distinct values and the ``k`` most frequent ones with their share."""
    counts = _melt(df, [], columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("_rows"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(totals, "column").select(
        "column", "n_distinct", "rank", "value", "n", (F.col("n") / F.col("_rows")).alias("share")
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls and, for numbers, the description."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(df.dtypes)
    cells = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        value = col.cast("double") if kinds[c] in numeric else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(col.isNull()).alias("n_missing"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            )
        )
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))


def feature_eligibility(
    df: DataFrame,
    group: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    min_numeric: int = 15,
    min_category: int = 8,
    max_levels: int = 50,
) -> DataFrame:
    """Usable features per group.

    Distinct levels are counted from ``(group, column, value)`` counts and not
    as distinct sets. Thresholds are 15 and 8 for families, 8 and 8 for pairs.
    """
    spread = (
        _melt(df, [group], numbers, "double")
        .groupBy(group, "column")
        .agg(F.count("value").alias("filled"), F.stddev_samp("value").alias("std"))
        .where((F.col("filled") >= min_numeric) & (F.col("std") > 1e-6))
        .select(group, "column", F.lit("numeric").alias("kind"))
    )
    levels = (
        _melt(df, [group], categories, "string")
        .where(F.col("value").isNotNull())
        .groupBy(group, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(group, "column")
        .agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("levels"))
        .where((F.col("filled") >= min_category) & F.col("levels").between(2, max_levels))
        .select(group, "column", F.lit("category").alias("kind"))
    )
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("column"))))
    return spread.unionByName(levels).groupBy(group).agg(
        names("numeric").alias("numeric_features"), names("category").alias("category_features")
    )


def vif_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors from the correlation matrix.

    The matrix comes from one aggregate; only its p x p numbers reach the task
    that solves it. Constant columns and factors of 1000 and more are left out.
    """
    import numpy as np
    import pandas as pd

    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    moments = complete.agg(
        F.array(*[F.stddev_samp(c) for c in columns]).alias("std"),
        F.array(*[F.coalesce(F.corr(columns[i], columns[j]), F.lit(0.0)) for i, j in pairs]).alias("corr"),
        F.count(F.lit(1)).alias("n"),
    )
    names = list(columns)

    def invert(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                p = len(names)
                matrix = np.eye(p)
                for (i, j), value in zip(pairs, row.corr):
                    if i != j:
                        matrix[i, j] = matrix[j, i] = value
                used = [k for k in range(p) if row.std[k] is not None and row.std[k] > 1e-6]
                if len(used) < 2 or row.n < len(used) + 1:
                    yield pd.DataFrame({"column": pd.Series(dtype=str), "vif": pd.Series(dtype=float)})
                    continue
                found = []
                for k in used:
                    others = [m for m in used if m != k]
                    r = matrix[k, others]
                    explained = r @ np.linalg.pinv(matrix[np.ix_(others, others)], hermitian=True) @ r
                    vif = 1.0 / (1.0 - explained) if explained < 1 else np.inf
                    if np.isfinite(vif) and vif < 1000:
                        found.append((names[k], float(vif)))
                yield pd.DataFrame(found, columns=["column", "vif"])

    return moments.mapInPandas(invert, "column string, vif double")


def regression_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, R2, MAE and MAPE on the price scale, in one grouped aggregate."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(y > 0, F.abs(e) / y)) * 100).alias("mape"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(predicted).alias("predicted_mean"),
        F.avg(y).alias("actual_mean"),
    )


def cv_stability(folds: DataFrame, by: Sequence[str], score: str = "r2") -> DataFrame:
    """Spread of the fold scores, risk label, and the train-validation gap when present."""
    aggregates = [
        F.avg(score).alias("cv_mean"),
        F.stddev_pop(score).alias("cv_std"),
        F.min(score).alias("cv_min"),
        F.max(score).alias("cv_max"),
        (F.max(score) - F.min(score)).alias("cv_range"),
    ]
    gap = "train_score" in folds.columns and "val_score" in folds.columns
    if gap:
        aggregates.append((F.avg("train_score") - F.avg("val_score")).alias("train_val_gap"))
    out = folds.groupBy(*by).agg(*aggregates).withColumn(
        "overfitting_risk",
        F.when(F.col("cv_std") > 0.2, "HIGH").when(F.col("cv_std") > 0.1, "MEDIUM").otherwise("LOW"),
    )
    return out.withColumn("overfitting_detected", F.col("train_val_gap") > 0.2) if gap else out


def prediction_plausibility(df: DataFrame, by: str, predicted: str = "predicted") -> DataFrame:
    """Issue codes per group from its predictions and ``bound_min`` / ``bound_max`` columns.

    All predictions are judged, not a sample of them.
    """
    p = F.col(predicted)
    shape = df.groupBy(by).agg(
        F.min(p).alias("pred_min"), F.max(p).alias("pred_max"), F.avg(p).alias("pred_mean"),
        F.stddev_pop(p).alias("pred_std"),
        F.max("bound_min").alias("bound_min"), F.max("bound_max").alias("bound_max"),
    )
    points = quantiles_of(df, [by], predicted, {"p1": 0.01, "pred_median": 0.5, "p99": 0.99})
    lo, hi = F.col("bound_min"), F.col("bound_max")
    safe_lo, safe_hi = lo * 0.8, F.least(hi * 1.2, F.lit(S.MAX_REASONABLE_PRICE * 1.5))
    top, bottom = F.col("pred_max"), F.col("pred_min")
    issues = F.array(
        F.when(top > safe_hi, "max too high").when(top > hi, "max high"),
        F.when(bottom < safe_lo, "min too low").when(bottom < lo, "min low"),
        F.when(F.col("pred_mean") > hi * 1.5, "mean too high").when(F.col("pred_mean") < lo * 0.5, "mean too low"),
        F.when(F.col("pred_std") > (hi - lo) * 2, "std too high"),
        F.when((bottom > 0) & (F.try_divide(top, bottom) > 100), "max/min ratio too high"),
        F.when(F.col("p99") > hi * 3, "distribution tail too long"),
        F.when(F.col("p1") < 0, "negative predictions"),
    )
    return (
        shape.join(points.drop("total"), by)
        .withColumn("issues", F.array_compact(issues))
        .withColumn("plausible", F.size("issues") == 0)
    )


def _screen_status(issues: Column) -> Column:
    return F.when(F.size(issues) == 0, "accepted").otherwise("rejected")


def prediction_screen(
    df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Gate for candidates: unusable values, bounds, R2 and RMSE limits.

    Up to half negative predictions are treated as 0 in the metrics. The frame
    carries ``bound_min`` and ``bound_max`` per row.
    """
    raw, y = F.col(predicted), F.col(actual)
    bad = raw.isNull() | F.isnan(raw) | raw.isin(float("inf"), float("-inf"))
    p = F.greatest(raw, F.lit(0.0))
    e = y - p
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("n_unusable"),
        F.count_if(raw < 0).alias("n_negative"),
        F.max(raw).alias("pred_max"),
        F.min(raw).alias("pred_min"),
        F.max("bound_max").alias("bound_max"),
        F.max("bound_min").alias("bound_min"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.stddev_samp(y).alias("_std"),
    )
    floor = F.greatest(F.lit(-1.0), -F.col("n") / F.lit(100.0))
    issues = F.array(
        F.when(F.col("n_unusable") > 0, "unusable values"),
        F.when(F.col("n_negative") > F.col("n") * 0.5, "too many negatives"),
        F.when(F.col("pred_max") > F.col("bound_max") * 3, "max too high"),
        F.when(F.col("pred_min") < -F.col("bound_min"), "min too low"),
        F.when(F.col("r2") < floor, "r2 too low"),
        F.when(F.col("rmse") > F.col("_std") * 2, "rmse too high"),
    )
    return stats.withColumn("issues", F.array_compact(issues)).withColumn("status", _screen_status(F.col("issues"))).drop("_std")
