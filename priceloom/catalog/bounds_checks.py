"""Price bounds, clipping, eligibility, bins, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.catalog import register
from priceloom.catalog.client_checks import rounded
from priceloom.catalog.mart import OFF_HALF, SALES, fixed, r6, sales, table
from priceloom.functions import values as V
from priceloom.functions.scale import settle
from priceloom.operators import bounds as B
from priceloom.operators import quality as Q
from priceloom.operators import ranking as R

# Tiny families keep fewer than ten rows, so that they take the shared bounds; seventh lines have no family.
FAMILY_ROWS = f"""
{SALES},
fam AS (SELECT CASE WHEN order_id < 40 THEN 'TINY_' || line_no WHEN line_no <> 7 THEN binding_type END AS family, unit_price, row_key FROM sales)"""


def family_rows(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True)
    tiny = F.concat(F.lit("TINY_"), F.col("line_no"))
    return rows.withColumn("binding_type", F.when(F.col("order_id") < 40, tiny).when(F.col("line_no") != 7, F.col("binding_type")))


CLEAN = """
pooled AS (SELECT family, unit_price AS v FROM {rows} WHERE family IS NOT NULL UNION ALL SELECT 'DEFAULT', unit_price FROM {rows}),
q AS (SELECT family, count(*) AS n_samples, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS min_raw, max(v) AS max_raw FROM pooled GROUP BY 1),
inside AS (SELECT b.family, v FROM pooled b JOIN q USING (family) WHERE v BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)),
c AS (
  SELECT family, count(*) AS n_clean, min(v) AS min_clean, max(v) AS max_clean, avg(v) AS mean, median(v) AS median,
         quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS q1c, quantile_cont(v, 0.75) AS q3c,
         quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99
  FROM inside GROUP BY 1)"""

BOUNDS = FAMILY_ROWS + "," + CLEAN.format(rows="fam") + """,
own AS (
  SELECT q.family, n_samples, n_clean, min_raw, max_raw, min_clean, max_clean, mean, median, p1, p99,
         greatest(0.5, CASE WHEN q.family = 'DEFAULT' THEN p1 ELSE 0.8 * p1 END) AS lo, least(5000, 1.5 * p99) AS hi
  FROM q LEFT JOIN c USING (family)),
d AS (SELECT lo AS dlo, hi AS dhi, median AS dmid FROM own WHERE family = 'DEFAULT'),
bounds AS (
  SELECT family, n_samples, n_clean, median, mean, p1, p99, min_clean, max_clean,
         n_samples - n_clean AS outliers_removed, (n_samples - n_clean) / n_samples * 100 AS outlier_pct,
         family <> 'DEFAULT' AND (n_samples < 10 OR n_clean < 5) AS uses_default,
         CASE WHEN family <> 'DEFAULT' AND (n_samples < 10 OR n_clean < 5) THEN dlo ELSE lo END AS bmin,
         CASE WHEN family <> 'DEFAULT' AND (n_samples < 10 OR n_clean < 5) THEN dhi ELSE hi END AS bmax,
         CASE WHEN family <> 'DEFAULT' AND (n_samples < 10 OR n_clean < 5) THEN dmid ELSE median END AS bdefault
  FROM own, d)"""


@register("price_bounds_iqr", f"""
WITH {BOUNDS} SELECT family, {r6('bmin')} AS "min", {r6('bmax')} AS "max", {r6('bdefault')} AS "default",
  CAST(uses_default AS BIGINT) AS uses_default, n_samples, n_clean, outliers_removed, {r6('outlier_pct')} AS outlier_pct,
  {r6('min_clean')} AS min_clean, {r6('max_clean')} AS max_clean, {r6('mean')} AS mean, {r6('p1')} AS p1, {r6('p99')} AS p99
FROM bounds""")
def price_bounds_iqr(spark, sf_dir):
    found = B.price_bounds_iqr(family_rows(spark, sf_dir))
    stats = ["n_samples", "n_clean", "outliers_removed", "outlier_pct", "min_clean", "max_clean", "mean", "p1", "p99"]
    return rounded(found.select("family", "min", "max", "default", "uses_default", *[f"stats.{c}" for c in stats]), shift=OFF_HALF)


# Pairs of family and country; orders below 400 form pairs with few rows.
PAIR_ROWS = f"""
{SALES},
pairs AS (SELECT CASE WHEN order_id < 400 THEN 'RARE__' || order_id % 50 WHEN line_no <> 7 THEN binding_type || '__' || country END AS family, unit_price FROM sales)"""


@register("price_bounds_group", f"""
WITH {PAIR_ROWS}, {CLEAN.format(rows='pairs')},
stats AS (SELECT q.family, n_samples, n_clean, p1, p99, median, mean FROM q LEFT JOIN c USING (family)),
d AS (SELECT * FROM stats WHERE family = 'DEFAULT'),
s AS (SELECT s.family, CASE WHEN s.n_samples < 10 THEN d.n_samples ELSE s.n_samples END AS n_samples,
  CASE WHEN s.n_samples < 10 THEN d.n_clean ELSE s.n_clean END AS n_clean, CASE WHEN s.n_samples < 10 THEN d.p1 ELSE s.p1 END AS p1,
  CASE WHEN s.n_samples < 10 THEN d.p99 ELSE s.p99 END AS p99, CASE WHEN s.n_samples < 10 THEN d.median ELSE s.median END AS median,
  CASE WHEN s.n_samples < 10 THEN d.mean ELSE s.mean END AS mean FROM stats s, d)
SELECT family AS "group", {r6('greatest(0.5, 0.8 * p1)')} AS "min", {r6('least(5000, 1.5 * p99)')} AS "max",
       {r6('median')} AS "default", n_samples, n_clean, {r6('mean')} AS mean FROM s""")
def price_bounds_group(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True, nation=True)
    rare = F.concat(F.lit("RARE__"), F.col("order_id") % 50)
    rows = rows.withColumn(
        "pair", F.when(F.col("order_id") < 400, rare).when(F.col("line_no") != 7, V.pair_key(F.col("binding_type"), F.col("country")))
    )
    found = B.price_bounds_group(rows, "pair")
    return rounded(found.select("group", "min", "max", "default", "n_samples", "n_clean", "mean"), shift=OFF_HALF)


@register("join_bounds_with_default", f"""
WITH {BOUNDS}, o AS (SELECT row_key, CASE WHEN line_no = 3 THEN 'UNHEARD' ELSE binding_type END AS family FROM sales)
SELECT row_key, o.family AS binding_type, {r6('coalesce(b.bmin, e.bmin, 0.5)')} AS bound_min,
       {r6('coalesce(b.bmax, e.bmax, 5000)')} AS bound_max, {r6('coalesce(b.bdefault, e.bdefault, 100)')} AS bound_default
FROM o LEFT JOIN bounds b ON b.family = o.family AND b.family <> 'DEFAULT' CROSS JOIN (SELECT * FROM bounds WHERE family = 'DEFAULT') e""")
def join_bounds_with_default(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True).select(
        "row_key", F.when(F.col("line_no") == 3, "UNHEARD").otherwise(F.col("binding_type")).alias("binding_type")
    )
    return rounded(B.join_bounds_with_default(rows, B.price_bounds_iqr(family_rows(spark, sf_dir))), shift=OFF_HALF)


@register("price_distribution_report", f"""
WITH {FAMILY_ROWS}, pooled AS (SELECT family, unit_price AS v FROM fam WHERE family IS NOT NULL UNION ALL SELECT 'ALL FAMILIES', unit_price FROM fam),
q AS (SELECT family, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM pooled GROUP BY 1),
j AS (SELECT *, v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1) AS out FROM pooled JOIN q USING (family))
SELECT family, count(*) AS n_samples, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
  round(coalesce(stddev_samp(v), 0), 4) AS std, round(median(v), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95,
  round(quantile_cont(v, 0.99), 6) AS p99, count(*) FILTER (out) AS outlier_count, round(count(*) FILTER (out) / count(*) * 100, 6) AS outlier_pct,
  round(coalesce(min(v) FILTER (out), -1), 6) AS min_outlier, round(coalesce(max(v) FILTER (out), -1), 6) AS max_outlier,
  round(greatest(0.5, 0.5 * quantile_cont(v, 0.05)), 6) AS recommended_min, round(least(5000, 2 * quantile_cont(v, 0.95)), 6) AS recommended_max
FROM j GROUP BY 1""")
def price_distribution_report(spark, sf_dir):
    report = B.price_distribution_report(family_rows(spark, sf_dir)).drop("q1", "q3", "lower_bound", "upper_bound")
    report = report.na.fill(-1.0, ["min_outlier", "max_outlier"]).withColumn("std", F.coalesce(fixed("std", 4), F.lit(0.0)))
    return rounded(report)


def _clip_sql(rule):
    floor, low, cap, high = B.CLIP_RULES[rule]
    return f"""
SELECT '{rule}' AS rule, row_key, round(greatest(least(unit_price, hi), lo), 7) AS price_clipped, CAST(unit_price > hi OR unit_price < lo AS BIGINT) AS was_clipped
FROM sales JOIN (SELECT binding_type, greatest({floor}, {low} * quantile_cont(unit_price, 0.01)) AS lo, least({cap}, {high} * quantile_cont(unit_price, 0.99)) AS hi
                 FROM sales GROUP BY 1) USING (binding_type)"""


@register("clip_target", f"WITH {SALES} {_clip_sql('linear')} UNION ALL {_clip_sql('nonlinear')}")
def clip_target(spark, sf_dir):
    rows = settle(sales(spark, sf_dir, part=True).select("row_key", "binding_type", "unit_price"), "rows")
    parts = [
        B.clip_target(rows, "binding_type", rule=rule).select(
            F.lit(rule).alias("rule"), "row_key", fixed("price_clipped", 7).alias("price_clipped"),
            F.col("was_clipped").cast("bigint").alias("was_clipped"),
        )
        for rule in B.CLIP_RULES
    ]
    return parts[0].unionByName(parts[1])


@register("clip_prediction", f"""
WITH {BOUNDS} SELECT s.row_key, {r6('greatest(least(unit_price * 3, 1.2 * bmax), 0.5)')} AS family_price,
  {r6('greatest(least(unit_price / 4, 1.2 * bmax), 0.8 * bmin)')} AS pair_price
FROM sales s JOIN bounds b ON b.family = s.binding_type""")
def clip_prediction(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True).select("row_key", "binding_type", "unit_price")
    joined = B.join_bounds_with_default(rows, B.price_bounds_iqr(family_rows(spark, sf_dir)))
    lo, hi = F.col("bound_min"), F.col("bound_max")
    return rounded(joined.select(
        "row_key", B.clip_prediction(F.col("unit_price") * 3, None, hi).alias("family_price"),
        B.clip_prediction(F.col("unit_price") / 4, lo, hi).alias("pair_price"),
    ), shift=OFF_HALF)


NUMBERS = ["quantity", "size", "retail", "discount", "flat"]
CATEGORIES = ["brand", "segment", "returnflag", "linestatus", "status", "siren"]


@register("feature_eligibility", f"""
WITH {PAIR_ROWS}, f AS (SELECT *, CASE WHEN order_id < 400 THEN 'RARE__' || order_id % 50 ELSE binding_type || '__' || country END AS pair, 1.0 AS flat FROM sales),
num AS ({' UNION ALL '.join(f"SELECT pair, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM f" for c in NUMBERS)}),
cat AS ({' UNION ALL '.join(f"SELECT pair, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM f" for c in CATEGORIES)}),
ok AS (
  SELECT pair, col, 'n' AS kind FROM num GROUP BY 1, 2 HAVING count(v) >= 8 AND stddev_samp(v) > 1e-6
  UNION ALL SELECT pair, col, 'c' FROM cat GROUP BY 1, 2 HAVING count(v) >= 8 AND count(DISTINCT v) BETWEEN 2 AND 50)
SELECT pair, coalesce(string_agg(col, ',' ORDER BY col) FILTER (kind = 'n'), '') AS numeric_features,
       coalesce(string_agg(col, ',' ORDER BY col) FILTER (kind = 'c'), '') AS category_features FROM ok GROUP BY 1""")
def feature_eligibility(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True, nation=True).withColumn("flat", F.lit(1.0))
    rare = F.concat(F.lit("RARE__"), F.col("order_id") % 50)
    rows = rows.withColumn(
        "pair", F.when(F.col("order_id") < 400, rare).otherwise(V.pair_key(F.col("binding_type"), F.col("country")))
    )
    found = Q.feature_eligibility(rows, "pair", NUMBERS, CATEGORIES, min_numeric=8)
    return found.select(
        "pair", F.array_join("numeric_features", ",").alias("numeric_features"),
        F.array_join("category_features", ",").alias("category_features"),
    )


BINNED = f"""
{SALES},
logs AS (SELECT row_key, ln(1 + unit_price) AS y FROM sales),
edges AS (SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(y, {k / 10})' for k in range(11))}])) AS e FROM logs),
binned AS (SELECT row_key, y, greatest(len(list_filter(e, lambda x: x < y)) - 1, 0) AS bin FROM logs, edges)"""


# Edge values lie between two rows, except the extremes, so that rounding noise cannot move a row.
@register("target_quantile_bins", f"WITH {BINNED} SELECT row_key, bin FROM binned")
def target_quantile_bins(spark, sf_dir):
    rows = sales(spark, sf_dir).select("row_key", V.log_price(F.col("unit_price")).alias("y"))
    return R.target_quantile_bins(rows, "y").select("row_key", F.col("bin").cast("bigint").alias("bin"))


@register("stratified_split", f"""
WITH {BINNED}, r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY ('0x' || substr(md5(row_key), 1, 13))::BIGINT) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM binned)
SELECT row_key, bin, CASE WHEN rn <= round(n * 0.25) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    rows = sales(spark, sf_dir).select("row_key", V.log_price(F.col("unit_price")).alias("y"))
    split = R.stratified_split(R.target_quantile_bins(rows, "y"), "bin", "row_key", 0.25)
    return split.select("row_key", F.col("bin").cast("bigint").alias("bin"), "part")


@register("kfold_assign", f"WITH {SALES} SELECT row_key, ('0x' || substr(md5(row_key), 1, 13))::BIGINT % 5 AS fold FROM sales")
def kfold_assign(spark, sf_dir):
    rows = R.kfold_assign(sales(spark, sf_dir).select("row_key"), F.col("row_key"))
    return rows.select("row_key", F.col("fold").cast("bigint").alias("fold"))


@register("seeded_sample", f"WITH {SALES} SELECT row_key, siren, round(unit_price, 8) AS unit_price FROM sales ORDER BY md5(row_key) LIMIT 100")
def seeded_sample(spark, sf_dir):
    sample = R.seeded_sample(sales(spark, sf_dir), F.col("row_key"), 100)
    return sample.select("row_key", "siren", fixed("unit_price", 8).alias("unit_price"))


# Registry rows: one model per priority and status, the order key as its version.
REGISTRY = "reg AS (SELECT 'PricingModel_' || o_orderstatus || '_' || regexp_replace(o_orderpriority, '[^a-zA-Z0-9_]', '_', 'g') AS model_name, o_orderkey AS version FROM orders)"


def registry(spark, sf_dir):
    name = F.concat(F.lit("PricingModel_"), F.col("o_orderstatus"), F.lit("_"), V.model_key(F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(name.alias("model_name"), F.col("o_orderkey").alias("version"))


@register("latest_version", f"""
WITH {REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS rn FROM reg)
SELECT model_name, max(version) FILTER (rn = 1) AS production_version, max(version) FILTER (rn = 2) AS archived_version FROM r GROUP BY 1""")
def latest_version(spark, sf_dir):
    return R.latest_version(registry(spark, sf_dir))


@register("registry_listing", f"""
WITH {REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS rn FROM reg)
SELECT model_name, version, CASE rn WHEN 1 THEN 'production' WHEN 2 THEN 'archived' ELSE '-' END AS lifecycle_status FROM r""")
def registry_listing(spark, sf_dir):
    return R.registry_listing(registry(spark, sf_dir)).select(
        "model_name", "version", F.coalesce("lifecycle_status", F.lit("-")).alias("lifecycle_status")
    )
