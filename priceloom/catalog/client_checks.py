"""Client indicators, features and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.catalog import register
from priceloom.catalog.mart import PRICED, fixed, priced, sales, table
from priceloom.functions.scale import settle
from priceloom.operators import clients as C


def rounded(df, digits=6, shift=0.0):
    """Doubles rounded, dates as text: what both engines can be compared on."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind == "double":
            col = fixed(col + shift, digits)
        elif kind == "date":
            col = col.cast("string")
        elif kind in ("int", "boolean"):
            col = col.cast("bigint")
        out.append(col.alias(name))
    return df.select(*out)


def priced_once(spark, sf_dir, *columns):
    """The columns of the priced rows, written once: means, key counts and the join back each read them."""
    return settle(priced(spark, sf_dir).select(*columns), "priced")


AGGREGATE = """
agg AS (
  SELECT siren, count(*) AS client_nb_orders, avg(unit_price_ht) AS client_avg_price_ht,
         stddev_samp(unit_price_ht) AS client_price_std_ht, avg(quantity) AS client_avg_quantity,
         min(reception_date) AS client_first_order, max(reception_date) AS client_last_order
  FROM priced GROUP BY siren)"""

DATED = AGGREGATE + """,
dated AS (
  SELECT *, coalesce(round(CAST(date_diff('day', client_first_order, (SELECT max(client_last_order) FROM agg)) AS DOUBLE) / 365, 2), 0) AS client_seniority_years,
         date_diff('day', client_last_order, (SELECT max(client_last_order) FROM agg)) AS client_recency_days
  FROM agg)"""

# Elasticity with limits that all status codes occur on the driver data.
ELASTIC = """
valid AS (SELECT * FROM priced WHERE quantity > 0 AND unit_price_ht > 0),
el AS (
  SELECT siren, count(*) AS n, stddev_samp(unit_price_ht) AS s, avg(unit_price_ht) AS m,
         regr_slope(ln(quantity), ln(unit_price_ht)) AS slope, regr_r2(ln(quantity), ln(unit_price_ht)) AS r2
  FROM valid GROUP BY siren),
elastic AS (
  SELECT siren, n, s / m AS cv, slope, r2,
         CASE WHEN n < {n} THEN 'insufficient_samples' WHEN m = 0 OR s = 0 THEN 'zero_variance'
              WHEN s / m < {cv} THEN 'low_price_variation' ELSE 'success' END AS code
  FROM el)"""

FEATURES = PRICED + "," + DATED + "," + ELASTIC.format(n=8, cv=0.05) + """,
features AS (
  SELECT siren, client_nb_orders, client_avg_price_ht, coalesce(client_price_std_ht, 0) AS client_price_std_ht,
         client_avg_quantity, coalesce(client_price_std_ht, 0) AS client_price_volatility, 1.0::DOUBLE AS client_relative_price,
         client_first_order, client_last_order, client_seniority_years, client_recency_days,
         CASE WHEN code = 'success' THEN slope ELSE 0 END AS client_price_elasticity,
         CASE WHEN code = 'insufficient_samples' THEN code || '_' || n ELSE code END AS elasticity_status
  FROM dated LEFT JOIN elastic USING (siren))"""


@register("relative_price_index", f"""
WITH {PRICED}, m AS (SELECT siren, avg(unit_price_ht) AS mean FROM priced GROUP BY 1)
SELECT order_id, line_no, part_key, siren, round(coalesce(unit_price_ht / mean, 1.0), 6) AS relative_price_index
FROM priced JOIN m USING (siren)""")
def relative_price_index(spark, sf_dir):
    rows = C.relative_price_index(priced_once(spark, sf_dir, "order_id", "line_no", "part_key", "siren", "unit_price_ht"))
    return rows.select("order_id", "line_no", "part_key", "siren", fixed("relative_price_index", 6).alias("relative_price_index"))


@register("price_volatility", f"""
WITH {PRICED}, m AS (SELECT siren, coalesce(stddev_samp(unit_price_ht), 0) AS s FROM priced GROUP BY 1)
SELECT order_id, line_no, part_key, siren, round(s, 6) AS price_volatility FROM priced JOIN m USING (siren)""")
def price_volatility(spark, sf_dir):
    rows = C.price_volatility(priced_once(spark, sf_dir, "order_id", "line_no", "part_key", "siren", "unit_price_ht"))
    return rows.select("order_id", "line_no", "part_key", "siren", fixed("price_volatility", 6).alias("price_volatility"))


@register("client_aggregate", f"""
WITH {PRICED}, {AGGREGATE}
SELECT siren, client_nb_orders, round(client_avg_price_ht, 6) AS client_avg_price_ht, round(coalesce(client_price_std_ht, 0), 6) AS client_price_std_ht,
       round(client_avg_quantity, 6) AS client_avg_quantity, round(coalesce(client_price_std_ht, 0), 6) AS client_price_volatility, 1.0::DOUBLE AS client_relative_price,
       CAST(client_first_order AS VARCHAR) AS client_first_order, CAST(client_last_order AS VARCHAR) AS client_last_order
FROM agg""")
def client_aggregate(spark, sf_dir):
    rows = priced_once(spark, sf_dir, "siren", "unit_price_ht", "quantity", "reception_date")
    return rounded(C.client_aggregate(C.client_indicators(rows)).na.fill(0.0, ["client_price_std_ht"]))


@register("client_recency_seniority", f"""
WITH {PRICED}, {DATED} SELECT siren, CAST(client_first_order AS VARCHAR) AS client_first_order, CAST(client_last_order AS VARCHAR) AS client_last_order,
  client_seniority_years, client_recency_days FROM dated""")
def client_recency_seniority(spark, sf_dir):
    clients = settle(C.client_aggregate(sales(spark, sf_dir).select("siren", "reception_date")))
    return rounded(C.client_recency_seniority(clients))


@register("client_elasticity", f"""
WITH {PRICED}, {ELASTIC.format(n=30, cv=1.6)}
SELECT siren, CASE WHEN code = 'success' THEN round(slope, 6) ELSE 0.0 END AS client_price_elasticity,
       CASE WHEN code = 'success' THEN round(r2, 6) ELSE -1 END AS elasticity_r2, n AS elasticity_n_samples,
       round(coalesce(cv, 0), 6) AS elasticity_cv, code AS elasticity_code FROM elastic""")
def client_elasticity(spark, sf_dir):
    rows = C.client_elasticity(priced(spark, sf_dir), min_samples=30, min_cv=1.6).drop("elasticity_status")
    return rounded(rows.withColumns({
        "elasticity_r2": F.coalesce("elasticity_r2", F.lit(-1.0)), "elasticity_cv": F.coalesce("elasticity_cv", F.lit(0.0)),
    }))


@register("join_client_elasticity", f"""
WITH {PRICED}, {AGGREGATE}, {ELASTIC.format(n=8, cv=0.05)}
SELECT siren, client_nb_orders, round(CASE WHEN code = 'success' THEN slope ELSE 0 END, 6) AS client_price_elasticity,
       coalesce(CASE WHEN code = 'insufficient_samples' THEN code || '_' || n ELSE code END, '-') AS elasticity_status
FROM agg LEFT JOIN elastic USING (siren)""")
def join_client_elasticity(spark, sf_dir):
    rows = priced(spark, sf_dir)
    joined = C.join_client_elasticity(C.client_aggregate(rows), C.client_elasticity(rows))
    return rounded(joined.select(
        "siren", "client_nb_orders", "client_price_elasticity",
        F.coalesce("elasticity_status", F.lit("-")).alias("elasticity_status"),
    ))


ROUND_FEATURES = """
  siren, client_nb_orders, round(client_avg_price_ht, 6) AS client_avg_price_ht, round(client_price_std_ht, 6) AS client_price_std_ht,
  round(client_avg_quantity, 6) AS client_avg_quantity, round(client_price_volatility, 6) AS client_price_volatility,
  client_relative_price, CAST(client_first_order AS VARCHAR) AS client_first_order,
  CAST(client_last_order AS VARCHAR) AS client_last_order, client_seniority_years, client_recency_days,
  round(client_price_elasticity, 6) AS client_price_elasticity, elasticity_status"""


@register("client_features", f"WITH {FEATURES} SELECT {ROUND_FEATURES} FROM features")
def client_features(spark, sf_dir):
    return rounded(C.client_features(priced_input(spark, sf_dir)))


def priced_input(spark, sf_dir):
    """Raw orders as the feature job expects them: VAT as a percentage."""
    return sales(spark, sf_dir).withColumn("tva", F.col("tva_percent"))


# Every seventh order carries a client the features do not know.
@register("join_enrich_orders", f"""
WITH {FEATURES}, o AS (SELECT order_id, line_no, part_key, CASE WHEN order_id % 7 = 0 THEN 'X' || siren ELSE siren END AS siren FROM sales)
SELECT order_id, line_no, part_key, siren, coalesce(client_nb_orders, 0) AS client_nb_orders,
       round(coalesce(client_avg_price_ht, 0), 6) AS client_avg_price_ht, coalesce(client_recency_days, 0) AS client_recency_days,
       coalesce(elasticity_status, 'none') AS elasticity_status, coalesce(CAST(client_last_order AS VARCHAR), '-') AS client_last_order
FROM o LEFT JOIN features USING (siren)""")
def join_enrich_orders(spark, sf_dir):
    orders = sales(spark, sf_dir).select("order_id", "line_no", "part_key", "siren").withColumn(
        "siren", F.when(F.col("order_id") % 7 == 0, F.concat(F.lit("X"), F.col("siren"))).otherwise(F.col("siren"))
    )
    joined = C.join_enrich_orders(orders, C.client_features(priced_input(spark, sf_dir)))
    return rounded(joined.select(
        "order_id", "line_no", "part_key", "siren", "client_nb_orders", "client_avg_price_ht", "client_recency_days",
        "elasticity_status", F.coalesce(F.col("client_last_order").cast("string"), F.lit("-")).alias("client_last_order"),
    ))


@register("lookup_client", f"""
WITH {FEATURES}
SELECT o_orderkey AS request_id, CAST(o_custkey * 2 AS VARCHAR) AS siren, CAST(client_nb_orders IS NOT NULL AS BIGINT) AS found,
       coalesce(client_nb_orders, -1) AS client_nb_orders
FROM orders LEFT JOIN features ON siren = CAST(o_custkey * 2 AS VARCHAR)""")
def lookup_client(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") * 2).alias("siren")
    )
    found = C.lookup_client(asked, C.client_features(priced_input(spark, sf_dir)))
    return found.select(
        "request_id", "siren", F.col("found").cast("bigint").alias("found"),
        F.coalesce("client_nb_orders", F.lit(-1)).alias("client_nb_orders"),
    )


@register("validate_client_features", f"""
WITH {FEATURES}
SELECT count(*) AS n_clients, 12 AS n_features, 0 AS missing_values, count(*) FILTER (client_price_elasticity <> 0) AS clients_with_elasticity,
  round(avg(client_price_elasticity), 6) AS elasticity_mean, round(stddev_samp(client_price_elasticity), 6) AS elasticity_std,
  round(min(client_price_elasticity), 6) AS elasticity_min, round(max(client_price_elasticity), 6) AS elasticity_max,
  round(avg(client_seniority_years), 6) AS seniority_mean, round(avg(client_recency_days), 6) AS recency_mean,
  round(avg(client_avg_price_ht), 6) AS avg_price_mean,
  CASE WHEN count(*) FILTER (client_price_elasticity <> 0) < count(*) * 0.3 THEN 'few_clients_with_elasticity' ELSE '' END AS issues
FROM features""")
def validate_client_features(spark, sf_dir):
    checked = C.validate_client_features(C.client_features(priced_input(spark, sf_dir)))
    return rounded(checked.withColumn("issues", F.array_join("issues", ";")))


PROFILED = ["client_nb_orders", "client_avg_price_ht", "client_price_std_ht", "client_avg_quantity",
            "client_seniority_years", "client_recency_days", "client_price_elasticity"]


@register("numeric_profile", f"""
WITH {FEATURES}, long AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM features" for c in PROFILED)})
SELECT c AS "column", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
FROM long GROUP BY 1""")
def numeric_profile(spark, sf_dir):
    features = settle(C.client_features(priced_input(spark, sf_dir)))
    return rounded(C.numeric_profile(features, PROFILED))


@register("correlation_matrix", f"""
WITH {FEATURES} {' UNION ALL '.join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM features"
    for a in PROFILED for b in PROFILED)}""")
def correlation_matrix(spark, sf_dir):
    return rounded(C.correlation_matrix(C.client_features(priced_input(spark, sf_dir)), PROFILED))


def _histogram_sql(column, where="true"):
    return f"""
SELECT '{column}' AS "column", b AS bin, round(lo + (hi - lo) * b / 30, 6) AS low, round(lo + (hi - lo) * (b + 1) / 30, 6) AS high,
       (SELECT count(*) FROM features f WHERE {where} AND least(floor((f.{column} - lo) / (hi - lo) * 30), 29) = b) AS n
FROM (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM features WHERE {where}), range(30) t(b)"""


@register("histogram_30", f"""
WITH {FEATURES} {' UNION ALL '.join([
    _histogram_sql('client_price_elasticity', 'client_price_elasticity <> 0'), _histogram_sql('client_seniority_years'),
    _histogram_sql('client_recency_days'), _histogram_sql('client_avg_price_ht')])}""")
def histogram_30(spark, sf_dir):
    return rounded(C.histogram_30(settle(C.client_features(priced_input(spark, sf_dir)))))
