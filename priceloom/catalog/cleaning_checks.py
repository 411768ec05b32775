"""Cleaning, column functions and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom import schema as S
from priceloom.catalog import register
from priceloom.catalog.mart import SALES, fixed, sales, table
from priceloom.functions import values as V
from priceloom.operators import cleaning as K
from priceloom.operators import quality as Q


def sql_list(items):
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def sql_map(column, mapping):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {cases} ELSE {column} END"


# Dirty spellings that follow from the line keys, the same in both engines.
# Index 0..9 of (partkey + linenumber) % 10 picks the spelling.
BINDING_SPELLINGS = [
    " saddle stitch ", "SaddleStitch", "casebound", "CASEBOUND-ES ", "looseleaf_no_cover", "coilhardtab",
    "perfect", "none", "", None,
]
FINISH_SPELLINGS = ["lgloss", "Layflat Gloss", "LMATTE", "matt ", "N/A", "null", "<na>", " ", None, "foil"]
LABEL_SPELLINGS = ["yes", "ISBN-ST", "bar code", "Grade 1", "standard", "none", "2", "relx", None, "blue"]
PRIORITY_SPELLINGS = ["high", "HIGH*", "high**", "normal", "low", "NAN", "", None, "High ", "missing"]
COVER_SIZES = ["6x9", "8x11", "6x9", "MISSING", "5x8", "8x11", "MISSING", "6x9", "8x11", "5x8"]


def _pick_spark(values, shift=0):
    index = (F.col("l_partkey") + F.col("l_linenumber") + shift) % 10
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick_sql(values, shift=0):
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[(l_partkey + l_linenumber + {shift}) % 10 + 1]"


DIRTY = f"""
dirty AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_key,
         {_pick_sql(BINDING_SPELLINGS)} AS binding_type, {_pick_sql(FINISH_SPELLINGS, 3)} AS cover_finish_type,
         {_pick_sql(LABEL_SPELLINGS, 5)} AS label_type, {_pick_sql(PRIORITY_SPELLINGS, 7)} AS priority_level,
         {_pick_sql(COVER_SIZES, 2)} AS cover_size,
         CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity END AS tab_size,
         CASE WHEN l_suppkey % 3 <> 0 THEN l_tax + 0.0::DOUBLE END AS tva,
         CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS version,
         l_extendedprice / l_quantity AS unit_price, l_quantity AS quantity
  FROM lineitem)"""


def dirty(spark, sf_dir):
    supp = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        _pick_spark(BINDING_SPELLINGS).alias("binding_type"),
        _pick_spark(FINISH_SPELLINGS, 3).alias("cover_finish_type"),
        _pick_spark(LABEL_SPELLINGS, 5).alias("label_type"),
        _pick_spark(PRIORITY_SPELLINGS, 7).alias("priority_level"),
        _pick_spark(COVER_SIZES, 2).alias("cover_size"),
        F.when(supp % 4 != 0, F.col("l_quantity")).alias("tab_size"),
        F.when(supp % 3 != 0, F.col("l_tax") + F.lit(0.0)).alias("tva"),
        F.when(supp % 5 != 0, F.col("l_linenumber").cast("bigint")).alias("version"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_quantity").alias("quantity"),
    )


TEXTS = ["binding_type", "cover_finish_type", "label_type", "priority_level"]


def counted(df, *columns):
    """Counts per combination: every row takes part, the result stays readable."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


# --- projections -----------------------------------------------------------


@register("project_keep_list", f"""
WITH {DIRTY} SELECT coalesce(binding_type, '-') AS binding_type, coalesce(priority_level, '-') AS priority_level,
  coalesce(label_type, '-') AS label_type, count(*) AS n_rows, round(sum(unit_price), 3) AS price_sum,
  round(sum(coalesce(tva, 0)), 4) AS tva_sum, 10 AS n_columns
FROM dirty GROUP BY 1, 2, 3""")
def project_keep_list(spark, sf_dir):
    kept = K.project_keep_list(dirty(spark, sf_dir))
    text = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return kept.groupBy(text("binding_type"), text("priority_level"), text("label_type")).agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.sum("unit_price"), 3).alias("price_sum"),
        fixed(F.sum(F.coalesce("tva", F.lit(0))), 4).alias("tva_sum"), F.lit(len(kept.columns)).alias("n_columns"),
    )


@register("filter_nonzero_price", f"""
WITH {SALES} SELECT status, count(*) AS n_rows, round(sum(unit_price), 3) AS price_sum
FROM sales WHERE unit_price <> 0 AND discount <> 0 GROUP BY 1""")
def filter_nonzero_price(spark, sf_dir):
    rows = sales(spark, sf_dir).withColumn("unit_price", F.when(F.col("discount") == 0, 0.0).otherwise(F.col("unit_price")))
    return K.filter_nonzero_price(rows).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.sum("unit_price"), 3).alias("price_sum")
    )


@register("filter_training_target", """
WITH t AS (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0.25 ELSE l_extendedprice / l_quantity END AS p FROM lineitem)
SELECT l_returnflag AS returnflag, count(*) AS n_rows, round(min(p), 8) AS lowest FROM t WHERE p > 0.5 GROUP BY 1""")
def filter_training_target(spark, sf_dir):
    line, price = F.col("l_linenumber"), F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("returnflag"),
        F.when(line == 1, "abc").when(line == 2, "0.25").otherwise(price.cast("string")).alias("unit_price"),
    )
    return K.filter_training_target(rows).groupBy("returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.min("unit_price"), 8).alias("lowest")
    )


@register("filter_positive_pairs", """
SELECT l_linestatus AS linestatus, count(*) AS n_rows FROM lineitem
WHERE l_quantity - 5 > 0 AND l_extendedprice - 20000 > 0 GROUP BY 1""")
def filter_positive_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("linestatus"),
        (F.col("l_quantity") - 5).alias("quantity"),
        (F.col("l_extendedprice") - 20000).alias("unit_price_ht"),
    )
    return counted(K.filter_positive_pairs(rows), "linestatus")


@register("filter_min_group_size", f"""
WITH {SALES}, big AS (SELECT siren FROM sales GROUP BY siren HAVING count(*) >= 40)
SELECT siren, count(*) AS n_rows, round(sum(quantity), 2) AS quantity_sum FROM sales WHERE siren IN (SELECT siren FROM big) GROUP BY 1""")
def filter_min_group_size(spark, sf_dir):
    kept = K.filter_min_group_size(sales(spark, sf_dir), "siren", 40)
    return kept.groupBy("siren").agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.sum("quantity"), 2).alias("quantity_sum")
    )


@register("drop_constant_columns", """
SELECT p_partkey AS part_key, p_type AS binding_type, 1 AS has_coil, p_size AS size FROM part""")
def drop_constant_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), F.col("p_type").alias("binding_type"), F.lit(1).alias("has_coil"),
        F.lit("x").alias("self_cover"), F.lit(None).cast("double").alias("weight"), F.col("p_size").alias("size"),
    )
    return K.drop_constant_columns(rows)


# --- text and tokens -------------------------------------------------------

UPPER = {c: f"upper(trim({c}))" for c in TEXTS}
TOKENED = {c: f"CASE WHEN {UPPER[c]} IS NULL OR {UPPER[c]} IN ({sql_list(S.EMPTY_TOKENS)}) THEN 'MISSING' ELSE {UPPER[c]} END" for c in TEXTS}


@register("str_trim_upper", f"""
WITH {DIRTY} SELECT {', '.join(f"coalesce({UPPER[c]}, '-') AS {c}" for c in TEXTS)}, count(*) AS n_rows FROM dirty GROUP BY 1, 2, 3, 4""")
def str_trim_upper(spark, sf_dir):
    return counted(K.str_trim_upper(dirty(spark, sf_dir)).na.fill("-", TEXTS), *TEXTS)


@register("normalize_empty_tokens", f"""
WITH {DIRTY} SELECT {', '.join(f"{TOKENED[c]} AS {c}" for c in TEXTS)}, count(*) AS n_rows FROM dirty GROUP BY 1, 2, 3, 4""")
def normalize_empty_tokens(spark, sf_dir):
    return counted(K.normalize_empty_tokens(K.str_trim_upper(dirty(spark, sf_dir)), TEXTS), *TEXTS)


@register("map_values", f"""
WITH {DIRTY}, tok AS (SELECT {', '.join(f"{TOKENED[c]} AS {c}" for c in TEXTS)} FROM dirty)
SELECT {', '.join(f"{sql_map(c, S.VALUE_MAPS[c])} AS {c}" for c in TEXTS)}, count(*) AS n_rows FROM tok GROUP BY 1, 2, 3, 4""")
def map_values(spark, sf_dir):
    return counted(K.map_values(K.str_trim_upper(dirty(spark, sf_dir))), *TEXTS)


@register("fill_typed", f"""
WITH {DIRTY} SELECT coalesce(tab_size, -1) AS tab_size, coalesce(version, 1) AS version,
  coalesce(cover_finish_type, 'MISSING') AS cover_finish_type, count(*) AS n_rows, round(sum(coalesce(tva, 0)), 4) AS tva_sum
FROM dirty GROUP BY 1, 2, 3""")
def fill_typed(spark, sf_dir):
    filled = K.fill_typed(dirty(spark, sf_dir))
    return filled.groupBy("tab_size", "version", "cover_finish_type").agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.sum("tva"), 4).alias("tva_sum")
    )


@register("fill_final", f"""
WITH {DIRTY} SELECT {', '.join(f"upper(trim(coalesce({c}, 'MISSING'))) AS {c}" for c in TEXTS)}, count(*) AS n_rows,
  count(tab_size) AS n_sizes FROM dirty GROUP BY 1, 2, 3, 4""")
def fill_final(spark, sf_dir):
    return K.fill_final(dirty(spark, sf_dir)).groupBy(*TEXTS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("tab_size").alias("n_sizes")
    )


@register("flag_present", f"""
WITH {DIRTY} SELECT CAST(coalesce(trim(binding_type) <> '', false) AS BIGINT) AS isbn10,
  CAST(coalesce(trim(cover_finish_type) <> '', false) AS BIGINT) AS isbn13, count(*) AS n_rows FROM dirty GROUP BY 1, 2""")
def flag_present(spark, sf_dir):
    rows = dirty(spark, sf_dir).select(F.col("binding_type").alias("isbn10"), F.col("cover_finish_type").alias("isbn13"))
    flagged = K.flag_present(rows)
    return counted(flagged.select(F.col("isbn10").cast("bigint"), F.col("isbn13").cast("bigint")), "isbn10", "isbn13")


ABSENT = ["NONE", "MISSING", "-1", "0", ""]
_PRESENT = lambda c: f"({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) NOT IN ({sql_list(ABSENT)}))"


@register("flag_any_present", f"""
WITH {DIRTY}, u AS (SELECT {UPPER['label_type']} AS a, {UPPER['priority_level']} AS b FROM dirty)
SELECT CAST(a IS NOT NULL OR b IS NOT NULL AS BIGINT) AS has_tab,
       CAST({_PRESENT('a')} OR {_PRESENT('b')} AS BIGINT) AS has_tab_strict, 0 AS has_coil, count(*) AS n_rows
FROM u GROUP BY 1, 2""")
def flag_any_present(spark, sf_dir):
    rows = K.str_trim_upper(dirty(spark, sf_dir)).select(F.col("label_type").alias("tab_color"), F.col("priority_level").alias("tab_size"))
    sources = {"has_tab": S.FLAG_SOURCES["has_tab"], "has_coil": S.FLAG_SOURCES["has_coil"]}
    loose = K.flag_any_present(rows, sources)
    strict = K.flag_any_present(loose.withColumnRenamed("has_tab", "loose"), {"has_tab": sources["has_tab"]}, ABSENT)
    out = strict.select(
        F.col("loose").cast("bigint").alias("has_tab"), F.col("has_tab").cast("bigint").alias("has_tab_strict"), "has_coil"
    )
    return counted(out, "has_tab", "has_tab_strict", "has_coil")


# --- numbers and dates -----------------------------------------------------


@register("parse_locale_number", """
SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no,
       CASE WHEN l_suppkey % 6 = 0 THEN 0.0::DOUBLE ELSE round(l_discount * 100 + 0.5, 1) END AS percent,
       round(l_extendedprice, 2) AS price
FROM lineitem""")
def parse_locale_number(spark, sf_dir):
    percent = F.replace(fixed(F.col("l_discount") * 100 + 0.5, 1).cast("string"), F.lit("."), F.lit(","))
    text = F.when(F.col("l_suppkey") % 6 == 0, "abc").otherwise(F.concat(percent, F.lit("%")))
    price = F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_no"),
        V.locale_number(text).alias("percent"), V.locale_number(price).alias("price"),
    )


# The added 1e-9 keeps exact halves, where the engines round differently, off the rounding point.
@register("price_ht", f"""
WITH {SALES}, r AS (SELECT *, CASE WHEN line_no = 7 THEN -0.1 WHEN tva_percent > 1 THEN tva_percent / 100 ELSE tva_percent END AS rate FROM sales)
SELECT order_id, line_no, part_key, round(rate, 6) AS rate, round(unit_price / (1 + greatest(rate, 0)) + 1e-9, 6) AS unit_price_ht FROM r""")
def price_ht(spark, sf_dir):
    from priceloom.operators.clients import price_ht as op

    percent = F.replace(F.col("tva_percent").cast("string"), F.lit("."), F.lit(","))
    rows = sales(spark, sf_dir).withColumn(
        "tva", F.when(F.col("line_no") == 7, "-0,1").otherwise(F.concat(percent, F.lit("%")))
    )
    return op(rows).select(
        "order_id", "line_no", "part_key", fixed("tva", 6).alias("rate"), fixed(F.col("unit_price_ht") + 1e-9, 6).alias("unit_price_ht")
    )


# Five ways a date may arrive, by order key.
def _date_text(day):
    key = F.col("o_orderkey") % 6
    return (
        F.when(key == 0, F.date_format(day, "dd-MM-yyyy")).when(key == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key == 2, F.date_format(day, "dd/MM/yyyy")).when(key == 3, "NONE").when(key == 4, "someday")
        .otherwise(F.lit(None).cast("string"))
    )


DATES_SQL = """
d AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 6 AS k FROM orders)"""


@register("parse_date_multi", f"""
WITH {DATES_SQL} SELECT o_orderkey AS order_id, coalesce(CAST(day AS VARCHAR), '-') AS day, CAST(k IN (3, 4) AS BIGINT) AS failed FROM d""")
def parse_date_multi(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("text", _date_text(F.col("o_orderdate")))
    day = V.parse_date(F.col("text"))
    return rows.select(
        F.col("o_orderkey").alias("order_id"), F.coalesce(day.cast("string"), F.lit("-")).alias("day"),
        V.date_failed(F.col("text"), day).cast("bigint").alias("failed"),
    )


@register("sentinel_date", f"""
WITH {DATES_SQL} SELECT CAST(coalesce(day, DATE '9999-12-31') AS VARCHAR) AS reception_date, count(*) AS n_rows FROM d GROUP BY 1""")
def sentinel_date(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _date_text(F.col("o_orderdate")).alias("reception_date"))
    return counted(K.clean_dates(rows).select(F.col("reception_date").cast("string")), "reception_date")


@register("format_date", "SELECT strftime(o_orderdate, '%d-%m-%Y') AS day, count(*) AS n_rows FROM orders GROUP BY 1")
def format_date(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(V.day_first_text(F.col("o_orderdate").cast("date")).alias("day"))
    return counted(days, "day")


@register("date_range_audit", """
SELECT 'reception_date' AS "column", count(*) FILTER (o_orderkey % 50 = 1) AS beyond_sentinel,
       count(*) FILTER (o_orderkey % 50 = 0) AS before_1900, count(*) FILTER (o_orderkey % 50 = 2) AS unreadable FROM orders""")
def date_range_audit(spark, sf_dir):
    key = F.col("o_orderkey") % 50
    rows = table(spark, sf_dir, "orders").select(
        F.when(key == 0, "15-03-1850").when(key == 1, "10000-01-01").when(key == 2, "??")
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("reception_date")
    )
    # years beyond 9999 have no text form in the mart, so they come as typed dates
    far = F.make_date(F.lit(10000), F.lit(1), F.lit(1))
    typed = F.when(F.col("reception_date") == "10000-01-01", far).otherwise(V.parse_date(F.col("reception_date")))
    unreadable = K.date_range_audit(rows.where(F.col("reception_date") != "10000-01-01"), ["reception_date"])
    return K.date_range_audit(rows.select(typed.alias("reception_date")), ["reception_date"]).withColumn(
        "unreadable", unreadable.select("unreadable").scalar()
    )


@register("log_transform", """
SELECT p_partkey AS part_key, round(ln(1 + p_retailprice), 6) AS log_price, round(p_retailprice, 6) AS back, round(ln(p_retailprice), 6) AS ln_price FROM part""")
def log_transform(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), fixed(V.log_price(price), 6).alias("log_price"),
        fixed(V.price_from_log(V.log_price(price)), 6).alias("back"), fixed(F.ln(price), 6).alias("ln_price"),
    )


# --- keys ------------------------------------------------------------------


@register("pair_key", f"""
WITH {SALES} SELECT binding_type || '__' || CASE WHEN country IN ('NATION_1', 'BRAZIL') THEN 'UNKNOWN' ELSE country END AS pair, count(*) AS n_rows
FROM sales GROUP BY 1""")
def pair_key(spark, sf_dir):
    client = F.when(~F.col("country").isin("NATION_1", "BRAZIL"), F.col("country"))
    rows = sales(spark, sf_dir, part=True, nation=True).select(V.pair_key(F.col("binding_type"), client).alias("pair"))
    return counted(rows, "pair")


@register("pair_key_split", f"""
WITH {SALES} SELECT CASE WHEN line_no = 1 THEN binding_type ELSE binding_type || '__' || country END AS pair, binding_type AS family,
  CASE WHEN line_no = 1 THEN '' ELSE country END AS client, count(*) AS n_rows FROM sales GROUP BY 1, 2, 3""")
def pair_key_split(spark, sf_dir):
    both = V.pair_key(F.col("binding_type"), F.col("country"))
    rows = sales(spark, sf_dir, part=True, nation=True).select(
        F.when(F.col("line_no") == 1, F.col("binding_type")).otherwise(both).alias("pair")
    )
    pair = F.col("pair")
    return counted(rows.select(pair, V.pair_family(pair).alias("family"), V.pair_client(pair).alias("client")), "pair", "family", "client")


@register("model_key", """
SELECT 'PricingModel_' || regexp_replace(p_type || '-' || p_brand || '*é', '[^a-zA-Z0-9_]', '_', 'g') AS model_name, count(*) AS n_parts FROM part GROUP BY 1""")
def model_key(spark, sf_dir):
    name = F.concat(F.col("p_type"), F.lit("-"), F.col("p_brand"), F.lit("*é"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("PricingModel_"), V.model_key(name)).alias("model_name"))
    return parts.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_parts"))


@register("strip_log_timestamp", """
SELECT event_id, event_type || ': ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - ' || user_id AS line FROM events""")
def strip_log_timestamp(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    user = F.col("user_id").cast("string")
    line = F.concat(F.lit("  "), stamp, F.lit(" - "), F.col("event_type"), F.lit(": "), stamp, F.lit(" - "), user)
    return table(spark, sf_dir, "events").select("event_id", V.strip_log_timestamp(line).alias("line"))


# --- rows, imputation, quality --------------------------------------------


@register("distinct_rows", """
WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
SELECT count(*) AS n_distinct, (SELECT count(*) FROM twice) - count(*) AS n_removed FROM (SELECT DISTINCT * FROM twice)""")
def distinct_rows(spark, sf_dir):
    once = table(spark, sf_dir, "lineitem")
    lines = once.unionByName(once.where("l_linenumber = 1"))
    total = lines.agg(F.count(F.lit(1)).alias("n")).scalar()
    return K.distinct_rows(lines).agg(F.count(F.lit(1)).alias("n_distinct")).select(
        "n_distinct", (total - F.col("n_distinct")).alias("n_removed")
    )


@register("mode_impute_in_group", f"""
WITH {DIRTY}, m AS (SELECT {sql_map(TOKENED['binding_type'], S.VALUE_MAPS['binding_type'])} AS binding_type, cover_size, part_key FROM dirty),
f AS (SELECT CASE WHEN part_key % 3 = 0 THEN 'SS' ELSE binding_type END AS binding_type, cover_size FROM m),
mode_value AS (SELECT cover_size FROM f WHERE binding_type = 'SS' AND cover_size <> 'MISSING' GROUP BY 1 ORDER BY count(*) DESC, cover_size LIMIT 1)
SELECT binding_type, CASE WHEN binding_type = 'SS' AND cover_size = 'MISSING' THEN (SELECT cover_size FROM mode_value) ELSE cover_size END AS cover_size,
       count(*) AS n_rows FROM f GROUP BY 1, 2""")
def mode_impute_in_group(spark, sf_dir):
    rows = K.map_values(K.str_trim_upper(dirty(spark, sf_dir), ["binding_type"]))
    rows = rows.withColumn("binding_type", F.when(F.col("part_key") % 3 == 0, "SS").otherwise(F.col("binding_type")))
    return counted(K.mode_impute_in_group(rows, ignore_tokens=[S.MISSING]), "binding_type", "cover_size")


@register("median_impute", f"""
WITH {DIRTY} SELECT coalesce(tab_size, (SELECT median(tab_size) FROM dirty)) AS tab_size,
  CAST(coalesce(version, (SELECT median(version) FROM dirty)) AS DOUBLE) AS version, count(*) AS n_rows FROM dirty GROUP BY 1, 2""")
def median_impute(spark, sf_dir):
    return counted(K.median_impute(dirty(spark, sf_dir), ["tab_size", "version"]), "tab_size", "version")


@register("value_frequencies", f"""
WITH {DIRTY}, long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS value FROM dirty" for c in TEXTS)}
  UNION ALL SELECT 'order_id', CAST(order_id AS VARCHAR) FROM dirty),
n AS (SELECT col, value, count(*) AS n FROM long GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value NULLS FIRST) AS rank,
      count(*) OVER (PARTITION BY col) AS n_distinct, sum(n) OVER (PARTITION BY col) AS total FROM n)
SELECT col AS "column", n_distinct, rank, coalesce(value, '<null>') AS value, n, round(n / total, 6) AS share FROM r WHERE rank <= 10""")
def value_frequencies(spark, sf_dir):
    top = Q.value_frequencies(dirty(spark, sf_dir), [*TEXTS, "order_id"])
    return top.select(
        "column", "n_distinct", F.col("rank").cast("bigint").alias("rank"),
        F.coalesce("value", F.lit("<null>")).alias("value"), "n", fixed("share", 6).alias("share"),
    )


def _report_sql(c, kind, numeric):
    v = f"CAST({c} AS DOUBLE)" if numeric else "NULL::DOUBLE"
    return (
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_missing, "
        f"round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, round(max({v}), 6) AS max FROM dirty"
    )


@register("quality_report", f"""
WITH {DIRTY} {' UNION ALL '.join([
    _report_sql('part_key', 'bigint', True), _report_sql('binding_type', 'string', False),
    _report_sql('tab_size', 'double', True), _report_sql('tva', 'double', True), _report_sql('version', 'bigint', True)])}""")
def quality_report(spark, sf_dir):
    report = Q.quality_report(dirty(spark, sf_dir).select("part_key", "binding_type", "tab_size", "tva", "version"))
    numbers = [fixed(c, 6).alias(c) for c in ("mean", "std", "min", "max")]
    return report.select("column", "type", "n_rows", "n_missing", *numbers)


@register("group_counts", f"""
WITH {SALES} SELECT binding_type || '__' || country AS pair, count(*) AS n_rows FROM sales GROUP BY 1""")
def group_counts(spark, sf_dir):
    rows = sales(spark, sf_dir, part=True, nation=True)
    return Q.group_counts(rows.withColumn("pair", V.pair_key(F.col("binding_type"), F.col("country"))), "pair")


