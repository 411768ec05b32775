"""Model training, metrics and rankings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from priceloom.catalog import register
from priceloom.catalog.bounds_checks import BOUNDS, family_rows
from priceloom.catalog.client_checks import rounded
from priceloom.catalog.mart import SALES, fixed, sales
from priceloom.catalog.quote_checks import MODELS, TIER_COLUMNS, scored_quotes
from priceloom.functions import values as V
from priceloom.functions.scale import settle
from priceloom.models import histogram_trees as H
from priceloom.models import linear as L
from priceloom.models import training as G
from priceloom.models import trees as W
from priceloom.operators import bounds as B
from priceloom.operators import quality as Q
from priceloom.operators import quotes as QU
from priceloom.operators import ranking as R
from priceloom.operators import scenarios as X
from priceloom.operators import scoring as T

NUMBERS = ["quantity", "size", "retail", "discount", "line_no"]
CATEGORIES = ["brand", "segment", "returnflag", "linestatus", "status", "priority_level"]


def training_rows(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True, nation=True)
    return rows.withColumn("pair", V.pair_key(F.col("binding_type"), F.col("country")))


# --- metrics on the closed-form tiers ---------------------------------------------

TIERS_SQL = MODELS + """,
tiered AS (
  SELECT binding_type, 'global' AS tier, 0 AS candidate_order, unit_price AS y, g_price AS p FROM scored
  UNION ALL SELECT binding_type, 'family', 1, unit_price, f_price FROM scored
  UNION ALL SELECT binding_type, 'family_flat', 2, unit_price, fn_price FROM scored),
metrics AS (
  SELECT binding_type, tier, candidate_order, count(*) AS n, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae,
         avg(abs(y - p) / y) * 100 AS mape, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM tiered GROUP BY 1, 2, 3)"""


def tier_predictions(spark, sf_dir):
    names = {"global": "global_prediction", "family": "family_linear", "family_flat": "family_nonlinear"}
    cells = F.array(*[
        F.struct(F.lit(k).alias("tier"), F.lit(i).alias("candidate_order"), F.col(t)["prediction"].alias("predicted"))
        for i, (k, t) in enumerate(names.items())
    ])
    return scored_quotes(spark, sf_dir).select(
        "row_key", "binding_type", F.col("unit_price").alias("actual"), F.explode(cells).alias("c")
    ).select("row_key", "binding_type", "actual", "c.*")


def tier_metrics(spark, sf_dir):
    return Q.regression_metrics(tier_predictions(spark, sf_dir), ["binding_type", "tier", "candidate_order"])


@register("regression_metrics", f"""
WITH {TIERS_SQL} SELECT binding_type, tier, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape, round(r2, 6) AS r2 FROM metrics""")
def regression_metrics(spark, sf_dir):
    m = tier_metrics(spark, sf_dir)
    return m.select("binding_type", "tier", "n", *[fixed(c, 4).alias(c) for c in ("rmse", "mae", "mape")], fixed("r2", 6).alias("r2"))


@register("rank_models", f"""
WITH {TIERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY binding_type ORDER BY rmse, candidate_order) AS rank FROM metrics)
SELECT binding_type, tier, rank, CASE WHEN rank = 1 THEN 'yes' ELSE 'no' END AS selected FROM r""")
def rank_models(spark, sf_dir):
    ranked = R.rank_models(tier_metrics(spark, sf_dir), ["binding_type"], "global")
    return ranked.select("binding_type", "tier", F.col("rank").cast("bigint").alias("rank"), "selected")


@register("best_model_per_group", f"""
WITH {TIERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY binding_type ORDER BY r2 DESC, candidate_order) AS rank FROM metrics)
SELECT binding_type, tier, round(r2, 6) AS r2 FROM r WHERE rank = 1""")
def best_model_per_group(spark, sf_dir):
    best = R.best_model_per_group(tier_metrics(spark, sf_dir), ["binding_type"], "nonlinear")
    return best.select("binding_type", "tier", fixed("r2", 6).alias("r2"))


@register("prediction_examples", f"""
WITH {MODELS} SELECT row_key, round(unit_price, 6) AS actual, round(f_price, 4) AS predicted, round(abs(unit_price - f_price), 4) AS abs_error,
  round(abs((unit_price - f_price) / unit_price * 100), 4) AS pct_error FROM scored ORDER BY md5(row_key) LIMIT 10""")
def prediction_examples(spark, sf_dir):
    rows = tier_predictions(spark, sf_dir).where(F.col("tier") == "family")
    examples = R.prediction_examples(rows, F.col("row_key"), 10)
    return examples.select(
        "row_key", fixed("actual", 6).alias("actual"), *[fixed(c, 4).alias(c) for c in ("predicted", "abs_error", "pct_error")]
    )


FOLDED = f"""
WITH {MODELS}, f AS (
  SELECT binding_type, ('0x' || substr(md5(row_key), 1, 13))::BIGINT % 5 AS fold, 1 - avg((unit_price - f_price) ** 2) / var_pop(unit_price) AS r2,
         1 - avg((unit_price - g_price) ** 2) / var_pop(unit_price) AS val FROM scored GROUP BY 1, 2)
SELECT binding_type, round(avg(r2), 6) AS cv_mean, round(stddev_pop(r2), 6) AS cv_std, round(min(r2), 6) AS cv_min, round(max(r2), 6) AS cv_max,
  round(max(r2) - min(r2), 6) AS cv_range, round(avg(r2) - avg(val), 6) AS train_val_gap,
  CASE WHEN stddev_pop(r2) > 0.2 THEN 'HIGH' WHEN stddev_pop(r2) > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS overfitting_risk,
  CAST(avg(r2) - avg(val) > 0.2 AS BIGINT) AS overfitting_detected FROM f GROUP BY 1"""


@register("cv_stability", FOLDED)
def cv_stability(spark, sf_dir):
    rows = R.kfold_assign(tier_predictions(spark, sf_dir), F.col("row_key"))
    scores = Q.regression_metrics(rows.where(F.col("tier") != "family_flat"), ["binding_type", "fold", "tier"])
    folds = scores.groupBy("binding_type", "fold").agg(
        F.max(F.when(F.col("tier") == "family", F.col("r2"))).alias("r2"),
        F.max(F.when(F.col("tier") == "family", F.col("r2"))).alias("train_score"),
        F.max(F.when(F.col("tier") == "global", F.col("r2"))).alias("val_score"),
    )
    return rounded(Q.cv_stability(folds, ["binding_type"]))


# Predictions against tight bounds, so that the issue codes occur.
@register("prediction_plausibility", f"""
WITH {MODELS}, s AS (
  SELECT binding_type, min(f_price) AS lo, max(f_price) AS hi, avg(f_price) AS m, stddev_pop(f_price) AS sd, quantile_cont(f_price, 0.01) AS p1, quantile_cont(f_price, 0.99) AS p99,
         CASE WHEN binding_type < 'M' THEN 900.0 ELSE 0.5 END AS bmin, CASE WHEN binding_type < 'P' THEN 1500.0 ELSE 5000.0 END AS bmax FROM scored GROUP BY 1)
SELECT binding_type, concat_ws(';', CASE WHEN hi > least(bmax * 1.2, 7500) THEN 'max too high' WHEN hi > bmax THEN 'max high' END,
  CASE WHEN lo < bmin * 0.8 THEN 'min too low' WHEN lo < bmin THEN 'min low' END, CASE WHEN m > bmax * 1.5 THEN 'mean too high' WHEN m < bmin * 0.5 THEN 'mean too low' END,
  CASE WHEN sd > (bmax - bmin) * 2 THEN 'std too high' END, CASE WHEN lo > 0 AND hi / lo > 100 THEN 'max/min ratio too high' END,
  CASE WHEN p99 > bmax * 3 THEN 'distribution tail too long' END, CASE WHEN p1 < 0 THEN 'negative predictions' END) AS issues, round(m, 4) AS pred_mean, round(p99, 4) AS p99 FROM s""")
def prediction_plausibility(spark, sf_dir):
    name = F.col("binding_type")
    rows = tier_predictions(spark, sf_dir).where(F.col("tier") == "family").withColumns({
        "bound_min": F.when(name < "M", 900.0).otherwise(0.5), "bound_max": F.when(name < "P", 1500.0).otherwise(5000.0),
    })
    judged = Q.prediction_plausibility(rows, "binding_type")
    return judged.select(
        "binding_type", F.array_join("issues", ";").alias("issues"), fixed("pred_mean", 4).alias("pred_mean"), fixed("p99", 4).alias("p99")
    )


@register("prediction_screen", f"""
WITH {TIERS_SQL}, shifted AS (SELECT binding_type, tier, y, p - CASE tier WHEN 'global' THEN 400 WHEN 'family' THEN 0 ELSE 9000 END AS raw, CASE WHEN binding_type < 'P' THEN 500.0 ELSE 9000.0 END AS bmax FROM tiered),
s AS (
  SELECT binding_type, tier, count(*) AS n, count(*) FILTER (raw < 0) AS n_negative, max(raw) AS hi, min(raw) AS lo, max(bmax) AS bmax, sqrt(avg((y - greatest(raw, 0)) ** 2)) AS rmse,
         1 - avg((y - greatest(raw, 0)) ** 2) / var_pop(y) AS r2, stddev_samp(y) AS sd FROM shifted GROUP BY 1, 2),
i AS (SELECT *, concat_ws(';', CASE WHEN n_negative > n * 0.5 THEN 'too many negatives' END, CASE WHEN hi > bmax * 3 THEN 'max too high' END, CASE WHEN lo < -0.5 THEN 'min too low' END,
  CASE WHEN r2 < greatest(-1, -n / 100) THEN 'r2 too low' END, CASE WHEN rmse > sd * 2 THEN 'rmse too high' END) AS issues FROM s)
SELECT binding_type, tier, n, n_negative, round(rmse, 4) AS rmse, issues, CASE WHEN issues = '' THEN 'accepted' ELSE 'rejected' END AS status FROM i""")
def prediction_screen(spark, sf_dir):
    shift = F.when(F.col("tier") == "global", 400.0).when(F.col("tier") == "family", 0.0).otherwise(9000.0)
    rows = tier_predictions(spark, sf_dir).withColumns({
        "predicted": F.col("predicted") - shift, "bound_min": F.lit(0.5),
        "bound_max": F.when(F.col("binding_type") < "P", 500.0).otherwise(9000.0),
    })
    screened = Q.prediction_screen(rows, ["binding_type", "tier"])
    return screened.select(
        "binding_type", "tier", "n", "n_negative", fixed("rmse", 4).alias("rmse"), F.array_join("issues", ";").alias("issues"), "status"
    )


@register("topk_feature_importance", f"""
WITH {SALES}, e AS (SELECT binding_type, brand || '/' || segment AS feature, abs(avg(ln(1 + unit_price)) - 7) AS importance FROM sales GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY binding_type ORDER BY importance DESC, feature) AS rank FROM e)
SELECT binding_type, feature, round(importance, 6) AS importance, rank FROM r WHERE rank <= 50""")
def topk_feature_importance(spark, sf_dir):
    effects = sales(spark, sf_dir, client=True, part=True).groupBy(
        "binding_type", F.concat_ws("/", "brand", "segment").alias("feature")
    ).agg(F.abs(F.avg(F.log1p("unit_price")) - 7).alias("importance"))
    top = R.topk_feature_importance(effects, ["binding_type"], 50)
    return top.select("binding_type", "feature", fixed("importance", 6).alias("importance"), F.col("rank").cast("bigint").alias("rank"))


@register("vif_table")
def vif_table(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True).withColumn("double_size", F.col("size") * 2 + F.col("discount"))
    return Q.vif_table(rows, [*NUMBERS, "double_size"]).select("column", fixed("vif", 4).alias("vif"))


@register("fallback_median_model", f"""
WITH {BOUNDS}, lim AS (SELECT family, greatest(0.5, 0.8 * quantile_cont(unit_price, 0.01)) AS lo, least(5000, 1.5 * quantile_cont(unit_price, 0.99)) AS hi FROM fam GROUP BY 1),
m AS (SELECT fam.family, median(ln(1 + greatest(least(unit_price, hi), lo))) AS med FROM fam JOIN lim USING (family) GROUP BY 1),
j AS (SELECT m.family, med, bdefault, exp(med) - 1 < 1.2 * CASE WHEN m.family < 'M' THEN 900 ELSE bmax END AS fits FROM m JOIN bounds b ON b.family = m.family)
SELECT family AS binding_type, CASE WHEN fits THEN 'Median_Fallback' ELSE 'Constant_Fallback' END AS model_name, round(CASE WHEN fits THEN med ELSE ln(1 + least(bdefault, 1000)) END, 6) AS intercept FROM j""")
def fallback_median_model(spark, sf_dir):
    rows = settle(family_rows(spark, sf_dir).select("binding_type", "unit_price"), "rows")
    _, limits = G.family_limits(rows, "binding_type")
    tight = limits.withColumn("bound_max", F.when(F.col("binding_type") < "M", 900.0).otherwise(F.col("bound_max")))
    spare = L.fallback_median_model(L.with_limits(rows, "binding_type", tight, "unit_price"), "binding_type")
    return spare.select("binding_type", "model_name", fixed("intercept", 6).alias("intercept"))


# --- trained models: rows only ------------------------------------------------------


@register("feature_pipeline_standard")
def feature_pipeline_standard(spark, sf_dir):
    coded, _ = W.feature_pipeline_standard(sales(spark, sf_dir, client=True, part=True), NUMBERS, CATEGORIES)
    return _feature_summary(coded)


@register("feature_pipeline_robust")
def feature_pipeline_robust(spark, sf_dir):
    coded, _ = W.feature_pipeline_robust(sales(spark, sf_dir, client=True, part=True), NUMBERS, CATEGORIES)
    return _feature_summary(coded)


def _feature_summary(coded):
    x = vector_to_array("features")
    return coded.select("binding_type", F.size(x).alias("width"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("s")).groupBy(
        "binding_type", "width"
    ).agg(F.count(F.lit(1)).alias("n_rows"), fixed(F.avg("s"), 6).alias("mean_sum"))


@register("global_model_race")
def global_model_race(spark, sf_dir):
    results, _ = W.global_model_race(training_rows(spark, sf_dir), "row_key", NUMBERS, CATEGORIES)
    return results


@register("group_linear_models")
def group_linear_models(spark, sf_dir):
    rows = G.training_columns(training_rows(spark, sf_dir), "binding_type", "row_key", NUMBERS, CATEGORIES)
    _, limits = G.family_limits(rows, "binding_type")
    _, tried = L.group_linear_models(rows, "binding_type", "row_key", limits, NUMBERS, CATEGORIES)
    return tried.select("binding_type", "model_name", "alpha", "l1_ratio", fixed("cv_r2", 6).alias("cv_r2"), fixed("cv_std", 6).alias("cv_std"))


@register("group_nonlinear_models")
def group_nonlinear_models(spark, sf_dir):
    rows = G.training_columns(training_rows(spark, sf_dir), "binding_type", "row_key", NUMBERS, CATEGORIES)
    bounds, _ = G.family_limits(rows, "binding_type")
    limits = B.clip_limits(rows, "binding_type", rule="nonlinear").join(
        bounds.select(F.col("family").alias("binding_type"), F.col("min").alias("bound_min"), F.col("max").alias("bound_max")), "binding_type"
    )
    results = W.group_nonlinear_models(rows, "binding_type", "row_key", limits, NUMBERS, CATEGORIES).results
    return results.withColumn("issues", F.array_join("issues", ";"))


def _trained_summary(trained, group):
    """The linear and the tree model of every group; a group may lack a tree model that is accepted."""
    trees = trained.trees.best.select(
        group, F.col("model_name").alias("tree_model"), F.size("trees").alias("n_trees"), F.col("n_train").alias("tree_n_train"), F.col("n").alias("tree_n_test"),
        fixed("r2_train", 6).alias("tree_r2_train"), fixed("r2", 6).alias("tree_r2_test"), fixed("mae", 4).alias("tree_mae_test"),
    )
    return trained.models.select(
        group, "model_name", "alpha", fixed("cv_r2", 6).alias("cv_r2"), "n_samples", "n_features", "formula"
    ).join(trained.metrics.select(group, fixed("r2", 6).alias("r2_train"), fixed("mae", 4).alias("mae_train")), group).join(trees, group, "left")


@register("train_families")
def train_families(spark, sf_dir):
    trained = G.train_families(training_rows(spark, sf_dir), "binding_type", "row_key", NUMBERS, CATEGORIES, trees=H.CANDIDATES)
    return _trained_summary(trained, "binding_type")


@register("train_pairs")
def train_pairs(spark, sf_dir):
    trained = G.train_pairs(training_rows(spark, sf_dir), "pair", "row_key", NUMBERS, CATEGORIES, trees=H.CANDIDATES)
    return _trained_summary(trained, "pair")


@register("coefficients_table")
def coefficients_table(spark, sf_dir):
    rows = G.training_columns(training_rows(spark, sf_dir), "binding_type", "row_key", NUMBERS, CATEGORIES)
    _, limits = G.family_limits(rows, "binding_type")
    models, _ = L.group_linear_models(rows, "binding_type", "row_key", limits, NUMBERS, CATEGORIES)
    return L.coefficients_table(models, "binding_type", 50)


# --- trees of groups ------------------------------------------------------------------

#: One tree per group on all rows, without sampling: its splits can be found again in SQL.
SINGLE_TREE = H.TreeCandidate("Single", "forest", 1, 2, feature_share=1.0, min_decrease=0.0)


def _splits_sql(k: int) -> str:
    """Best split of every node of ``n{k}`` (g, node, row_key, y), and the nodes of the next level."""
    return f"""
t{k} AS (SELECT g, node, count(*) AS n, sum(y) AS s FROM n{k} GROUP BY 1, 2),
l{k} AS (
  SELECT r.g, node, f, c, NULL AS v, 0 AS kind, count(*) FILTER (x <= c) AS nl, coalesce(sum(y) FILTER (x <= c), 0) AS sl FROM n{k} r JOIN num USING (g, row_key) JOIN cuts USING (g, f) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT r.g, node, f, NULL, l.v, 1, count(*) FILTER (cat.v <> l.v), coalesce(sum(y) FILTER (cat.v <> l.v), 0) FROM n{k} r JOIN cat USING (g, row_key) JOIN levels l USING (g, f) GROUP BY 1, 2, 3, 5),
b{k} AS (SELECT g, node, f, c, v, n, nl, sl, s, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM l{k} JOIN t{k} USING (g, node)
  WHERE nl >= {SINGLE_TREE.min_leaf} AND n - nl >= {SINGLE_TREE.min_leaf} AND n >= {SINGLE_TREE.min_split}
  QUALIFY row_number() OVER (PARTITION BY g, node ORDER BY round(gain, 9) DESC, kind, f, c, v) = 1),
n{k + 1} AS (
  SELECT r.g, 2 * r.node + 1 + CASE WHEN b.v IS NULL THEN num.x > b.c ELSE cat.v = b.v END::INT AS node, r.row_key, r.y FROM n{k} r JOIN b{k} b ON b.g = r.g AND b.node = r.node
  LEFT JOIN num ON num.g = r.g AND num.row_key = r.row_key AND num.f = b.f LEFT JOIN cat ON cat.g = r.g AND cat.row_key = r.row_key AND cat.f = b.f)"""


_NUM = " UNION ALL ".join(f"SELECT binding_type AS g, row_key, '{n}' AS f, CAST({n} AS DOUBLE) AS x FROM sales" for n in NUMBERS)
_CAT = " UNION ALL ".join(f"SELECT binding_type AS g, row_key, '{c}' AS f, {c} AS v FROM sales" for c in CATEGORIES)
SPLITS = f"""
WITH {SALES}, num AS ({_NUM}), cat AS ({_CAT}),
cuts AS (SELECT DISTINCT g, f, c FROM (SELECT g, f, unnest(quantile_cont(x, [{', '.join(str(k / H.BINS) for k in range(1, H.BINS))}])) AS c FROM num GROUP BY 1, 2)),
seen AS (SELECT g, f, v, row_number() OVER (PARTITION BY g, f ORDER BY v) AS rk, count(*) OVER (PARTITION BY g, f) AS n FROM (SELECT DISTINCT g, f, v FROM cat)),
levels AS (SELECT g, f, v FROM seen WHERE n <> 2 OR rk = 2),
n0 AS (SELECT binding_type AS g, 0 AS node, row_key, ln(1 + unit_price) - avg(ln(1 + unit_price)) OVER (PARTITION BY binding_type) AS y FROM sales),
{_splits_sql(0)},{_splits_sql(1)},
base AS (SELECT binding_type AS g, avg(ln(1 + unit_price)) AS m FROM sales GROUP BY 1)
SELECT g AS binding_type, node, f AS feature, c AS cut, v AS level, n, nl AS n_left, round(m + sl / nl, 6) AS mean_left, round(m + (s - sl) / (n - nl), 6) AS mean_right
FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1) JOIN base USING (g)"""


@register("group_tree_splits", SPLITS)
def group_tree_splits(spark, sf_dir):
    """Splits of one tree per family: the histogram engine without sampling, recomputed in SQL."""
    rows = settle(training_rows(spark, sf_dir).select(
        "binding_type", "row_key", *NUMBERS, *CATEGORIES, F.log1p("unit_price").alias("y"), F.lit("train").alias("part")
    ), "rows")
    design = settle(L.design_table(rows, "binding_type", NUMBERS, CATEGORIES), "design")
    models = H.tree_models(H.grow(rows, design, "binding_type", "row_key", NUMBERS, CATEGORIES, [SINGLE_TREE]))
    base = rows.groupBy("binding_type").agg(F.avg("y").alias("base"))
    nodes = models.join(base, "binding_type").select("binding_type", "base", F.col("trees")[0].alias("t"), F.posexplode(F.col("trees")[0]).alias("node", "s"))
    left, right = F.get("t", 2 * F.col("node") + 1), F.get("t", 2 * F.col("node") + 2)
    feature = F.get(F.array(*[F.lit(c) for c in [*NUMBERS, *CATEGORIES]]), F.col("s.slot"))
    return nodes.where(F.col("s.slot") >= 0).select(
        "binding_type", "node", feature.alias("feature"), F.col("s.cut").alias("cut"), F.col("s.level").alias("level"),
        F.col("s.n").cast("bigint").alias("n"), left["n"].cast("bigint").alias("n_left"),
        fixed(F.col("base") + left["value"], 6).alias("mean_left"), fixed(F.col("base") + right["value"], 6).alias("mean_right"),
    )


# Trained once per session and folder: the queries below read the registry as quotes do.
_LEVELS: dict[tuple[str, str], G.Levels] = {}


def trained_levels(spark, sf_dir) -> G.Levels:
    """Linear and tree models of families, pairs and the whole at full size, written to the registry table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEVELS:
        rows = settle(training_rows(spark, sf_dir), "mart")
        _LEVELS[key] = G.train_levels(rows, "binding_type", "country", "row_key", NUMBERS, CATEGORIES)
    return _LEVELS[key]


def trained_quotes(spark, sf_dir):
    """Order lines scored with the trained models of all five tiers."""
    return T.score_quotes(training_rows(spark, sf_dir), trained_levels(spark, sf_dir).registry, NUMBERS, CATEGORIES, "binding_type", "country")


@register("score_trained_tiers")
def score_trained_tiers(spark, sf_dir):
    """How well each tier prices the order lines, all tiers from trained models."""
    tiers = [F.struct(F.lit(t).alias("tier"), F.col(t)["available"].alias("available"), F.col(t)["prediction"].alias("predicted")) for t in TIER_COLUMNS.values()]
    flat = trained_quotes(spark, sf_dir).select("binding_type", F.col("unit_price").alias("actual"), F.explode(F.array(*tiers)).alias("t")).select("binding_type", "actual", "t.*")
    return Q.regression_metrics(flat.where("available"), ["binding_type", "tier"])


@register("trained_feature_importance")
def trained_feature_importance(spark, sf_dir):
    """The 50 largest importances of the best tree model of every family and pair."""
    levels = trained_levels(spark, sf_dir)
    best = levels.families.trees.best.withColumnRenamed("_family", "name").unionByName(levels.pairs.trees.best.withColumnRenamed("_pair", "name"))
    rows = best.select("name", "model_name", F.explode("feature_importance").alias("feature", "importance"))
    return R.topk_feature_importance(rows, ["name"], 50)


@register("trained_scenarios")
def trained_scenarios(spark, sf_dir):
    """The strongest scenario of every order line, its price moved through the best available trained tier."""
    registry = trained_levels(spark, sf_dir).registry

    def price(rows):
        scored = QU.quote_select_tier(T.score_quotes(rows, registry, NUMBERS, CATEGORIES, "binding_type", "country").withColumn("siren", F.col("country")))
        return scored.withColumn("price", F.coalesce(F.col("selected.price"), F.col("global_prediction.prediction"))).select(*rows.columns, "price")

    quotes = training_rows(spark, sf_dir).drop("siren")
    base = price(quotes).withColumnRenamed("price", "base_price")
    results = X.scenario_evaluate(base, price, percent=F.lit(20.0))
    return X.strongest_scenario(results, "row_key")
