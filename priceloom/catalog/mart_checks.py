"""Sources, sinks and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom import schema as S
from priceloom.catalog import register
from priceloom.catalog.mart import CHILDREN, RELATIONS, SALES, fixed, priced, relations, table

from priceloom.functions.scale import fresh_path
from priceloom.operators import consolidate as C
from priceloom.operators.clients import client_features
from priceloom.plans.mart import build_mart
from priceloom.sources import readers as R
from priceloom.sources import sinks as K

CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_mktsegment", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()),
])


@register("scan_csv", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def scan_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    table(spark, sf_dir, "customer").select(*CUSTOMER.fieldNames()).write.option("header", True).csv(path)
    return R.scan_csv(spark, path, CUSTOMER)


@register(
    "scan_validated",
    "SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def scan_validated(spark, sf_dir):
    orders = R.scan_validated(spark, f"{sf_dir}/orders.parquet", max_file_mb=None)
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), fixed(F.sum("o_totalprice"), 2).alias("total")
    )


@register("scan_relations", """
SELECT 'production_parts' AS relation, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'clients', count(*) FROM customer
UNION ALL SELECT 'kits', count(*) FROM conversations
UNION ALL SELECT 'part_coils', count(*) FROM part
UNION ALL SELECT 'part_covers', count(*) FROM supplier
UNION ALL SELECT 'part_tabs', count(*) FROM nation
UNION ALL SELECT 'part_inserts', count(*) FROM region
UNION ALL SELECT 'part_covers_cases', count(*) FROM events""")
def scan_relations(spark, sf_dir):
    names = {
        "production_parts": "lineitem",
        "orders": "orders",
        "clients": "customer",
        "kits": "conversations",
        "part_coils": "part",
        "part_covers": "supplier",
        "part_tabs": "nation",
        "part_inserts": "region",
        "part_covers_cases": "events",
    }
    found = R.scan_relations(spark, {k: f"{sf_dir}/{v}.parquet" for k, v in names.items()})
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows")
        for name, df in found.items()
    ]
    return C.union_align_columns(counts)


@register("scan_dumps_with_provenance", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'dump_1' WHEN 'O' THEN 'dump_10' ELSE 'dump_1' END AS source,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END::BIGINT AS source_rank,
       count(*) AS n_rows
FROM orders GROUP BY ALL""")
def scan_dumps_with_provenance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = fresh_path(spark, "dumps")
    # a name that begins with another one, an empty extract, and an equal name in another folder
    names = {"dump_1": "F", "dump_10": "O", "dump_empty": "", "dump_10_more/dump_1": "P"}
    for name, status in names.items():
        orders.where(F.col("o_orderstatus") == status).write.parquet(f"{base}/{name}")
    dumps = R.scan_dumps_with_provenance(spark, [f"{base}/{n}" for n in names], orders.schema)
    return R.rows_per_source(dumps).withColumn("source_rank", F.col("source_rank").cast("bigint"))


@register("require_columns", "SELECT p_type, count(*) AS n_rows FROM part GROUP BY 1")
def require_columns(spark, sf_dir):
    part = R.require_columns(table(spark, sf_dir, "part"), ["p_type", "p_retailprice"])
    return part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n_rows"))


@register("scan_client_features", f"""
WITH {SALES} SELECT siren, count(*) AS client_nb_orders, round(avg(quantity), 6) AS client_avg_quantity
FROM sales GROUP BY 1""")
def scan_client_features(spark, sf_dir):
    path = K.sink_table(client_features(priced(spark, sf_dir)), fresh_path(spark, "client-features"))
    return R.scan_client_features(spark, path).select(
        "siren", "client_nb_orders", fixed("client_avg_quantity", 6).alias("client_avg_quantity")
    )


@register("sink_table", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n_orders, CAST(sum(o_custkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1, 2""")
def sink_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = K.sink_table(orders, fresh_path(spark, "orders"), fmt="csv")
    back = R.scan_csv(spark, path, orders.schema)
    return back.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_custkey").alias("key_sum")
    )


@register("sink_report_json", "SELECT p_type AS family, count(*) AS n_rows, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1")
def sink_report_json(spark, sf_dir):
    report = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family")).agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.avg("p_retailprice"), 6).alias("mean")
    )
    return spark.read.schema(report.schema).json(K.sink_report_json(report, fresh_path(spark, "report")))


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").alias("finished_at"),
        (F.col("event_type") != "error").alias("succeeded"),
        F.col("value").alias("seconds"),
        F.lit(1).cast("bigint").alias("rows"),
        (F.col("event_id") % 3).alias("retries"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


@register("run_ledger", """
WITH e AS (SELECT *, event_type <> 'error' AS ok FROM events),
last AS (SELECT * FROM e WHERE NOT ok ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 5)
SELECT count(*) AS files_processed, count(*) FILTER (ok) AS successful_runs, count(*) FILTER (NOT ok) AS failed_runs,
       round(sum(value) FILTER (ok), 4) AS total_execution_time, CAST(sum(event_id % 3) AS BIGINT) AS retries_used,
       round(count(*) FILTER (ok) / count(*), 6) AS success_rate,
       round(sum(value) FILTER (ok) / count(*) FILTER (ok), 6) AS average_execution_time,
       (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, CAST(event_id AS VARCHAR)) FROM last) AS recent_errors
FROM e""")
def run_ledger(spark, sf_dir):
    ledger = K.run_ledger(_runs(spark, sf_dir))
    return ledger.select(
        "files_processed", "successful_runs", "failed_runs",
        fixed("total_execution_time", 4).alias("total_execution_time"), "retries_used",
        fixed("success_rate", 6).alias("success_rate"),
        fixed("average_execution_time", 6).alias("average_execution_time"),
        F.array_join(F.col("recent_errors.run_id"), ",").alias("recent_errors"),
    )


@register("file_fingerprint", """
SELECT count(*) AS n_rows,
       CAST(sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority)), 1, 8))::BIGINT) AS BIGINT) AS row_hash_sum
FROM orders""")
def file_fingerprint(spark, sf_dir):
    cents, day = F.round(F.col("o_totalprice") * 100).cast("bigint"), F.date_format("o_orderdate", "yyyy-MM-dd")
    columns = [c.cast("string") for c in (F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), cents, day, F.col("o_orderpriority"))]
    return K.table_fingerprint(table(spark, sf_dir, "orders"), columns)


@register("file_fingerprints", """
SELECT o_orderpriority AS priority, md5(string_agg(o_orderkey || '|' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS content_md5,
       CAST(sum(length(o_orderkey || '|' || o_orderstatus) + 1) AS BIGINT) AS "length"
FROM orders GROUP BY 1""")
def file_fingerprints(spark, sf_dir):
    """One file per priority, in the order of the keys; its fingerprint covers the whole content."""
    path = fresh_path(spark, "files")
    orders = table(spark, sf_dir, "orders").repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    orders.select("o_orderpriority", line.alias("line")).write.partitionBy("o_orderpriority").text(path)
    found = K.file_fingerprints(spark, path)
    priority = F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]*)", 1))
    return found.where(F.endswith("path", F.lit(".txt"))).select(priority.alias("priority"), "content_md5", "length")


AUDIT_RULES = {**S.FORBIDDEN_PATTERNS, r"\blicen[sc]e\b": "license line", r"\bpassword\b": "secret"}


@register("text_pattern_audit", """
SELECT doc_id, CAST(len(hits) = 0 AS BIGINT) AS accepted, array_to_string(hits, ';') AS violations FROM (
  SELECT doc_id, list_filter([
    CASE WHEN regexp_matches(text, '(?i)\\bDROP\\s+DATABASE\\b') THEN 'DROP DATABASE forbidden' END,
    CASE WHEN regexp_matches(text, '(?i)\\bDROP\\s+USER\\b') THEN 'DROP USER forbidden' END,
    CASE WHEN regexp_matches(text, '(?i)\\bGRANT\\b') THEN 'GRANT forbidden' END,
    CASE WHEN regexp_matches(text, '(?i)\\bREVOKE\\b') THEN 'REVOKE forbidden' END,
    CASE WHEN regexp_matches(text, '(?i)\\bLOAD\\s+DATA\\b') THEN 'LOAD DATA forbidden' END,
    CASE WHEN regexp_matches(text, '(?i)\\blicen[sc]e\\b') THEN 'license line' END,
    CASE WHEN regexp_matches(text, '(?i)\\bpassword\\b') THEN 'secret' END], lambda x: x IS NOT NULL) AS hits
  FROM documents)""")
def text_pattern_audit(spark, sf_dir):
    audited = K.text_pattern_audit(table(spark, sf_dir, "documents"), rules=AUDIT_RULES)
    return audited.select(
        "doc_id", F.col("accepted").cast("bigint").alias("accepted"),
        F.array_join("violations", ";").alias("violations"),
    )


# --- projections and schema ------------------------------------------------


@register("project_renamed", f"""
WITH {RELATIONS} SELECT order_id, client_id, order_num, reception_date, quantity, qty_min AS quantity_min, priority_level
FROM porders""")
def project_renamed(spark, sf_dir):
    return C.project_renamed(relations(spark, sf_dir)["orders"], C.ORDER_COLUMNS, ["order_id", "client_id"])


@register("drop_duplicate_columns", """
SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, o_custkey AS client_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def drop_duplicate_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_no")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id")
    )
    return C.drop_duplicate_columns(lines.join(orders, lines["order_id"] == orders["order_id"]))


@register("filter_not_split", f"""
WITH {RELATIONS} SELECT line_no, count(*) AS n_rows, CAST(sum(order_id) AS BIGINT) AS id_sum FROM pparts WHERE split = 0 GROUP BY 1""")
def filter_not_split(spark, sf_dir):
    kept = C.filter_not_split(relations(spark, sf_dir)["production_parts"])
    return kept.groupBy("line_no").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("order_id").alias("id_sum"))


# --- joins -----------------------------------------------------------------


@register("join_star_inner", f"""
WITH {RELATIONS} SELECT part_id, order_id, line_no, split, round(unit_price, 8) AS unit_price, client_id, order_num, name, siren
FROM pparts JOIN porders USING (order_id) JOIN pclients USING (client_id)""")
def join_star_inner(spark, sf_dir):
    r = relations(spark, sf_dir)
    star = C.join_star_inner(r["production_parts"], r["orders"], r["clients"])
    return star.select(
        "part_id", "order_id", "line_no", "split", fixed("unit_price", 8).alias("unit_price"),
        "client_id", "order_num", "name", "siren",
    )


CHILD_JOINS = """
  LEFT JOIN part_coils dc ON dc.part_id = replace(pp.part_id, 'PZ', '') AND dc.active = 1
  LEFT JOIN part_covers pc ON pc.part_id = replace(pp.part_id, 'PZ', '') AND pc.active = 1
  LEFT JOIN part_tabs pt ON pt.part_id = replace(pp.part_id, 'PZ', '') AND pt.active = 1
  LEFT JOIN part_inserts pi ON pi.part_id = replace(pp.part_id, 'PZ', '') AND pi.active = 1
  LEFT JOIN part_covers_cases pcc ON pcc.part_id = replace(pp.part_id, 'PZ', '') AND pcc.active = 1"""


@register("join_active_children_left", f"""
WITH {RELATIONS} SELECT pp.part_id, pp.order_id, pp.line_no, coalesce(coil_type, '-') AS coil_type,
  coalesce(cover_size, '-') AS cover_size, coalesce(tab_size, -9) AS tab_size,
  coalesce(insert_paper_type, '-') AS insert_paper_type, coalesce(spine_type, '-') AS spine_type
FROM pparts pp {CHILD_JOINS}""")
def join_active_children_left(spark, sf_dir):
    r = relations(spark, sf_dir)
    joined = C.join_active_children_left(r["production_parts"], {n: r[n] for n in CHILDREN}, CHILDREN)
    text = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return joined.select(
        "part_id", "order_id", "line_no", text("coil_type"), text("cover_size"),
        F.coalesce("tab_size", F.lit(-9)).alias("tab_size"), text("insert_paper_type"), text("spine_type"),
    )


@register("join_not_exists_kits", f"""
WITH {RELATIONS} SELECT part_id, order_id, line_no FROM pparts pp
WHERE NOT EXISTS (SELECT 1 FROM kits k WHERE k.order_id = pp.order_id AND k.active = 1)""")
def join_not_exists_kits(spark, sf_dir):
    r = relations(spark, sf_dir)
    return C.join_not_exists_kits(r["production_parts"], r["kits"]).select("part_id", "order_id", "line_no")


@register("sort_orders_desc", "SELECT o_orderkey AS order_id, o_orderpriority AS priority_level FROM orders ORDER BY 1 DESC")
def sort_orders_desc(spark, sf_dir):
    return C.sort_orders_desc(relations(spark, sf_dir)["orders"].select("order_id", "priority_level"))


@register("union_align_columns", """
SELECT o_orderkey AS order_id, o_orderstatus AS status, '-' AS priority_level FROM orders
UNION ALL SELECT o_orderkey, '-', o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""")
def union_align_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    second = orders.where(F.col("o_orderkey") % 2 == 0).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority_level")
    )
    return C.union_align_columns([first, second]).na.fill("-", ["status", "priority_level"])


# Two sources with overlapping keys; every 97th order id and every 3rd line of those is null.
@register("dedup_keep_first", """
WITH src AS (
  SELECT 0 AS source_rank, * FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 1, * FROM lineitem),
keyed AS (
  SELECT source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag,
         coalesce(CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END, 'MISSING_order_id') AS order_id,
         coalesce(CASE WHEN l_orderkey % 97 = 0 AND l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END, 'MISSING_part_id') AS part_id
  FROM src),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY order_id, part_id
    ORDER BY source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM keyed)
SELECT order_id, part_id, CAST(source_rank AS BIGINT) AS source_rank, l_partkey AS part_key, l_suppkey AS supp_key,
       round(l_extendedprice, 2) AS price FROM ranked WHERE rn = 1""")
def dedup_keep_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    void = F.col("l_orderkey") % 97 == 0
    frame = lambda df, rank: df.select(
        F.lit(rank).cast("bigint").alias("source_rank"),
        F.when(~void, F.col("l_orderkey").cast("string")).alias("order_id"),
        F.when(~(void & (F.col("l_linenumber") % 3 == 0)), F.col("l_linenumber").cast("string")).alias("part_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    )
    merged = C.union_align_columns([frame(lines.where(F.col("l_returnflag") == "R"), 0), frame(lines, 1)])
    order = ["source_rank", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    first = C.dedup_keep_first(merged, ["order_id", "part_id"], [F.col(c) for c in order])
    return first.select(
        "order_id", "part_id", "source_rank", F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"), fixed("l_extendedprice", 2).alias("price"),
    )


@register("conform_defaults", """
SELECT p_partkey AS part_key, p_type AS coil_type, 'NONE' AS insert_color, -1 AS insert_size, -1 AS tab_size,
       'NONE' AS spine_type, 0 AS perf, p_size AS shrinkwrap, 31 - 2 AS n_added FROM part""")
def conform_defaults(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), F.col("p_type").alias("coil_type"), F.col("p_size").alias("shrinkwrap")
    )
    full = C.conform_defaults(part)
    return full.select(
        "part_key", "coil_type", "insert_color", "insert_size", "tab_size", "spine_type", "perf", "shrinkwrap",
        F.lit(len(full.columns) - len(part.columns)).alias("n_added"),
    )


@register("coerce_types", """
SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no,
       coalesce(CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END, 'NONE') AS coil_type,
       CASE WHEN l_partkey % 5 IN (0, 1) THEN 0.0::DOUBLE ELSE l_quantity END AS quantity
FROM lineitem""")
def coerce_types(spark, sf_dir):
    key = F.col("l_partkey")
    dirty = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.when(key % 7 != 0, F.col("l_returnflag")).alias("coil_type"),
        F.when(key % 5 == 0, "n/a").when(key % 5 != 1, F.col("l_quantity").cast("string")).alias("quantity"),
    )
    return C.coerce_types(dirty)


@register("consolidate", f"""
WITH {RELATIONS},
mart AS (
  SELECT pp.order_id, pp.part_id, pp.line_no, pp.unit_price, o.quantity, c.siren, coil_type, tab_size, insert_paper_type
  FROM pparts pp JOIN porders o USING (order_id) JOIN pclients c USING (client_id) {CHILD_JOINS}
  WHERE pp.split = 0 AND NOT EXISTS (SELECT 1 FROM kits k WHERE k.order_id = pp.order_id AND k.active = 1)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY order_id, part_id ORDER BY line_no, unit_price, insert_paper_type) AS rn FROM mart)
SELECT CAST(order_id AS VARCHAR) AS order_id, part_id, line_no, round(unit_price, 8) AS unit_price,
       CAST(quantity AS DOUBLE) AS quantity, siren, coalesce(coil_type, 'NONE') AS coil_type,
       CAST(coalesce(tab_size, 0) AS DOUBLE) AS tab_size, coalesce(insert_paper_type, 'NONE') AS insert_paper_type,
       'NONE' AS head_and_tail
FROM ranked WHERE rn = 1""")
def consolidate(spark, sf_dir):
    mart = build_mart(relations(spark, sf_dir), columns=CHILDREN, precedence=["line_no", "unit_price", "insert_paper_type"])
    return mart.select(
        "order_id", "part_id", "line_no", fixed("unit_price", 8).alias("unit_price"), "quantity", "siren",
        "coil_type", "tab_size", "insert_paper_type", "head_and_tail",
    )


@register("fan_out_audit", f"""
WITH {RELATIONS}, joined AS (SELECT pp.order_id, pp.part_id, pp.line_no FROM pparts pp {CHILD_JOINS})
SELECT copies, count(*) AS n_keys FROM (SELECT count(*) AS copies FROM joined GROUP BY order_id, part_id, line_no) GROUP BY 1""")
def fan_out_audit(spark, sf_dir):
    r = relations(spark, sf_dir)
    joined = C.join_active_children_left(r["production_parts"], {n: r[n] for n in CHILDREN}, CHILDREN)
    return C.fan_out(joined, ["order_id", "part_id", "line_no"])


