"""Feature pipelines and the global race on Spark ML; tree models of groups on the histogram engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    RobustScaler,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scale import join_lookup, settle
from priceloom.models import histogram_trees as H
from priceloom.operators import quality as Q
from priceloom.operators import ranking as R

RARE = "__rare__"
SEED = 42


def fold_rare_levels(df: DataFrame, categories: Sequence[str], minimum: int = 10) -> DataFrame:
    """Levels with fewer rows than the minimum become one level, whatever their number."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories])
    frequent = settle(
        df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
        .select("column", "value"),
        "levels",
    )
    sizes = {r["column"]: r["n"] for r in frequent.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in categories:
        known = frequent.where(F.col("column") == c).select(F.col("value").alias(c), F.lit(True).alias("_known"))
        out = join_lookup(out.withColumn(c, F.col(c).cast("string")), known, [c], settled_rows=sizes.get(c, 0))
        out = out.withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise(RARE)).drop("_known")
    return out


def _encoders(numbers: Sequence[str], indexed: Sequence[str], scaler) -> Pipeline:
    stages: list = [VectorAssembler(inputCols=list(numbers), outputCol="_numbers"), scaler]
    parts = ["_scaled"]
    if indexed:
        stages.append(StringIndexer(
            inputCols=list(indexed), outputCols=[f"_ix_{c}" for c in indexed], handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ))
        stages.append(OneHotEncoder(
            inputCols=[f"_ix_{c}" for c in indexed], outputCols=[f"_oh_{c}" for c in indexed], dropLast=True,
            handleInvalid="keep",
        ))
        parts += [f"_oh_{c}" for c in indexed]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def _apply(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith(("_ix_", "_oh_"))], "_numbers", "_scaled")


def feature_pipeline_standard(
    df: DataFrame, numbers: Sequence[str], categories: Sequence[str], min_frequency: int = 10
) -> tuple[DataFrame, PipelineModel]:
    """Standard scaling and one-hot with rare levels folded; adds ``features``."""
    rows = fold_rare_levels(_doubles(df, numbers), categories, min_frequency)
    scaler = StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)
    model = _encoders(numbers, categories, scaler).fit(rows)
    return _apply(model, rows), model


def feature_pipeline_robust(
    df: DataFrame, numbers: Sequence[str], categories: Sequence[str]
) -> tuple[DataFrame, PipelineModel]:
    """Median centring and 5-95 range scaling; adds ``features``."""
    rows = fold_rare_levels(_doubles(df, numbers), categories, 1)
    scaler = RobustScaler(inputCol="_numbers", outputCol="_scaled", withCentering=True, withScaling=True, lower=0.05, upper=0.95)
    model = _encoders(numbers, categories, scaler).fit(rows)
    return _apply(model, rows), model


def _doubles(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numbers})


# --- global race ---------------------------------------------------------------


@dataclass(frozen=True)
class RaceSettings:
    """Size of the candidates; the defaults are the full ones."""

    forest_trees: int = 200
    depth: int = 15
    boost_rounds: int = 300
    boost_depth: int = 5
    folds: int = 5
    test_share: float = 0.25
    extra: Mapping[str, object] = field(default_factory=dict)


def race_candidates(s: RaceSettings, label: str = "y") -> dict:
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "log_prediction"}
    tree = {"maxDepth": s.depth, "minInstancesPerNode": 5, "seed": SEED}
    return {
        "RandomForest": RandomForestRegressor(**common, numTrees=s.forest_trees, **tree),
        "GradientBoosting": GBTRegressor(
            **common, maxIter=s.boost_rounds, maxDepth=s.boost_depth, stepSize=0.05, subsamplingRate=0.8, seed=SEED
        ),
        "DecisionTree": DecisionTreeRegressor(**common, **tree),
        "LinearRegression": LinearRegression(**common, regParam=0.0, solver="l-bfgs" if s.extra.get("many") else "auto"),
    }


def _scored(model: Model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(
        F.expm1("y").alias("actual"), F.expm1("log_prediction").alias("predicted"), "y", "log_prediction"
    )


def global_model_race(
    df: DataFrame,
    key: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    price: str = "unit_price",
    settings: RaceSettings = RaceSettings(),
) -> tuple[DataFrame, dict[str, Model]]:
    """Train the candidates on log price; the best test RMSE on the price scale wins.

    The encoded rows are written once and every fit reads that table. The frame
    of results is one row per candidate.
    """
    rows = df.withColumn("y", F.log1p(F.col(price)))
    split = R.stratified_split(R.target_quantile_bins(rows, "y"), "bin", key, settings.test_share)
    coded, _ = feature_pipeline_standard(R.kfold_assign(split, F.col(key), settings.folds), numbers, categories)
    table = settle(coded.select("features", "y", "part", "fold"), "race")
    train, test = table.where(F.col("part") == "train"), table.where(F.col("part") == "test")
    models, results = {}, None
    for order, (name, estimator) in enumerate(race_candidates(settings).items()):
        models[name] = estimator.fit(train)
        measured = Q.regression_metrics(_scored(models[name], test), [])
        if settings.folds > 1:
            folds = [
                _scored(estimator.fit(train.where(F.col("fold") != k)), train.where(F.col("fold") == k))
                .agg(F.sqrt(F.avg((F.col("y") - F.col("log_prediction")) ** 2)).alias("rmse"))
                for k in range(settings.folds)
            ]
            scores = folds[0]
            for f in folds[1:]:
                scores = scores.unionByName(f)
            cv = scores.agg(F.struct(F.avg("rmse").alias("m"), F.stddev_pop("rmse").alias("s")).alias("cv")).scalar()
            measured = measured.withColumns({"cv_rmse": cv.getField("m"), "cv_rmse_std": cv.getField("s")})
        row = measured.select(F.lit(name).alias("model_name"), F.lit(order).alias("candidate_order"), "*")
        results = row if results is None else results.unionByName(row)
    table_of_results = settle(results, "race-results")
    return R.rank_models(table_of_results.withColumn("level", F.lit("global")), ["level"], "global"), models


def feature_importance(model: Model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """Importances of one fitted tree model as rows (a vector bounded by the features)."""
    vector = model.featureImportances
    pairs = [(names[i], float(vector[i])) for i in range(len(names))]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double")


# --- tree models per group --------------------------------------------------------


@dataclass
class GroupTrees:
    """Tree tier of one level: all candidates with their test metrics, and the best accepted model of every group."""

    results: DataFrame
    best: DataFrame
    candidates: DataFrame


@dataclass
class Prepared:
    """Rows (``_group``, key, features, ``y``, ``part``), design and bounds of the groups of one level."""

    rows: DataFrame
    design: DataFrame
    bounds: DataFrame


def prepare_groups(
    df: DataFrame, group: str, key: str, limits: DataFrame, numbers: Sequence[str], categories: Sequence[str],
    price: str = "unit_price", min_rows: int = 50, min_numeric: int = 15, level: str = "",
) -> Prepared:
    """Clipped log prices, 80 % train and 20 % test; centres and levels come from the training part alone."""
    from priceloom.models.linear import design_table, nan_as_null, with_limits

    named = F.concat(F.lit(level), F.col(group).cast("string")).alias("_group")
    clipped = with_limits(nan_as_null(df, numbers).where(F.col(group).isNotNull()), group, limits, price)
    narrow = settle(clipped.select(named, F.col(key).cast("string").alias("_key"), *numbers, *categories, F.log1p("price_clipped").alias("y")), "clipped")
    rows = settle(R.stratified_split(narrow, "_group", "_key", 0.2), "split")
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows)
    design = design_table(rows.where(F.col("part") == "train"), "_group", numbers, categories, min_numeric).where(F.col("n_features") >= 3)
    return Prepared(
        rows, settle(design.join(sizes, "_group", "left_semi"), "design"), settle(limits.select(named, "bound_min", "bound_max"), "bounds")
    )


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grow_levels(
    levels: Mapping[str, tuple[str, Prepared]], numbers: Sequence[str], categories: Sequence[str],
    candidates: Sequence[H.TreeCandidate] = H.CANDIDATES,
) -> dict[str, GroupTrees]:
    """Tree ensembles of all groups of all levels, grown in the same passes.

    ``levels`` maps the prefix of a level's groups to the name of its group column and its rows. The best accepted
    candidate by R2 on the price scale is the model of its group.
    """
    prepared = [p for _, p in levels.values()]
    grown = H.grow(
        _together([p.rows for p in prepared]), _together([p.design for p in prepared]), "_group", "_key", numbers, categories, candidates
    )
    names = F.array(*[F.lit(c.name) for c in candidates])
    flat = H.predictions(grown).withColumns({
        "model_name": F.get(names, F.col("candidate_order")), "actual": F.expm1("y"), "predicted": F.expm1("log_prediction"),
    })
    bounds = _together([p.bounds for p in prepared])
    measured = settle(join_lookup(flat.drop("y", "log_prediction"), bounds, ["_group"], "inner"), "tree-predictions")
    by = ["_group", "model_name", "candidate_order"]
    test, floor = measured.where(F.col("part") == "test"), F.greatest("predicted", F.lit(0.0))
    screened = Q.prediction_screen(test, by)
    errors = Q.regression_metrics(test.withColumn("predicted", floor), by).drop("n", "r2", "rmse", "predicted_mean", "actual_mean")
    fitted = Q.regression_metrics(measured.where(F.col("part") == "train").withColumn("predicted", floor), by).select(
        *by, F.col("n").alias("n_train"), F.col("r2").alias("r2_train")
    )
    results = settle(screened.join(errors, by).join(fitted, by), "group-tree-results")
    models = settle(H.tree_models(grown), "tree-models")
    accepted = results.where(F.col("status") == "accepted").select(*by, "n", "n_train", "r2", "r2_train", "rmse", "mae")
    first = R.best_model_per_group(accepted, ["_group"], "nonlinear")
    best = settle(first.join(models.drop("model_name"), ["_group", "candidate_order"]), "best-trees")

    def of(df: DataFrame, prefix: str, group: str) -> DataFrame:
        mine = df.where(F.startswith("_group", F.lit(prefix)))
        return mine.withColumn("_group", F.substring("_group", len(prefix) + 1, 1 << 30)).withColumnRenamed("_group", group)

    return {prefix: GroupTrees(*[of(df, prefix, group) for df in (results, best, models)]) for prefix, (group, _) in levels.items()}


def group_nonlinear_models(
    df: DataFrame, group: str, key: str, limits: DataFrame, numbers: Sequence[str], categories: Sequence[str],
    price: str = "unit_price", min_rows: int = 50, min_numeric: int = 15, candidates: Sequence[H.TreeCandidate] = H.CANDIDATES,
) -> GroupTrees:
    """Tree ensembles of every group with enough rows: grown on 80 %, screened and measured on 20 %."""
    prepared = prepare_groups(df, group, key, limits, numbers, categories, price, min_rows, min_numeric)
    return grow_levels({"": (group, prepared)}, numbers, categories, candidates)[""]
