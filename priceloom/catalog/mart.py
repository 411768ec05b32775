"""The pricing mart on the driver tables, once for Spark and once for the check engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(value: Column | str, digits: int) -> Column:
    """Value to a fixed number of digits, by arithmetic both engines share bit for bit.

    ``register`` rewrites ``round(x, n)`` of the SQL checks to the same form.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def row_key() -> Column:
    """Unique text key of an order line."""
    return F.concat_ws(
        "-",
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.unix_date(F.col("l_shipdate").cast("date")), F.floor(F.col("l_extendedprice") * 100 + 0.5),
    )


def sales(spark: SparkSession, sf_dir: str, client: bool = False, part: bool = False, nation: bool = False) -> DataFrame:
    """Order lines as mart rows; only the asked dimensions are joined."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    # customers and nations meet the orders, so that the lines move once less
    if client or nation:
        orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if nation:
        orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = {
        "row_key": row_key(),
        "order_id": F.col("l_orderkey"),
        "line_no": F.col("l_linenumber").cast("bigint"),
        "part_key": F.col("l_partkey"),
        "supp_key": F.col("l_suppkey"),
        "siren": F.col("o_custkey").cast("string"),
        "quantity": F.col("l_quantity"),
        "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
        "tva": F.col("l_tax") + F.lit(0.0),
        "tva_percent": fixed((F.col("l_tax") + F.lit(0.0)) * 100, 2),
        "reception_date": F.col("o_orderdate").cast("date"),
        "priority_level": F.col("o_orderpriority"),
        "status": F.col("o_orderstatus"),
        "discount": F.col("l_discount") + F.lit(0.0),
        "returnflag": F.col("l_returnflag"),
        "linestatus": F.col("l_linestatus"),
    }
    if client or nation:
        columns["segment"] = F.col("c_mktsegment")
    if nation:
        columns["country"] = F.col("n_name")
    if part:
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        columns |= {
            "binding_type": F.col("p_type"),
            "brand": F.col("p_brand"),
            "size": F.col("p_size").cast("bigint"),
            "retail": F.col("p_retailprice"),
        }
    return spread(rows, lines, "l_orderkey").select(*[c.alias(n) for n, c in columns.items()])


# The same rows for the check engine.
SALES = """
sales AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)),
                   CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS row_key,
         l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_key,
         l_suppkey AS supp_key, CAST(o_custkey AS VARCHAR) AS siren, l_quantity AS quantity,
         l_extendedprice / l_quantity AS unit_price, l_tax + 0.0::DOUBLE AS tva,
         round((l_tax + 0.0::DOUBLE) * 100, 2) AS tva_percent, CAST(o_orderdate AS DATE) AS reception_date,
         o_orderpriority AS priority_level, o_orderstatus AS status, l_discount + 0.0::DOUBLE AS discount,
         l_returnflag AS returnflag, l_linestatus AS linestatus, c_mktsegment AS segment, n_name AS country,
         p_type AS binding_type, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_retailprice AS retail
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""

# Price without VAT by the percentage rule: rates above 1 are percentages.
PRICE_HT_SQL = (
    "unit_price / (1 + greatest(CASE WHEN tva_percent > 1 THEN tva_percent / 100 ELSE tva_percent END, 0))"
)

PRICED = SALES + f""",
priced AS (SELECT *, {PRICE_HT_SQL} AS unit_price_ht FROM sales)"""


def priced(spark: SparkSession, sf_dir: str, **dimensions: bool) -> DataFrame:
    """Mart rows with ``unit_price_ht``, the VAT given as a percentage."""
    from priceloom.operators.clients import price_ht

    rows = sales(spark, sf_dir, **dimensions)
    return price_ht(rows.withColumn("tva", F.col("tva_percent")))


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine source relations, derived from the driver tables.

    Part ids carry the ``PZ`` prefix on every other part; every fifth line is
    split; large parts have two active inserts, so the child join fans out.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    part_key = F.col("l_partkey")
    key = F.col("p_partkey").cast("string").alias("part_id")

    def child(condition: Column, **columns: Column) -> DataFrame:
        return parts.select(key, condition.cast("int").alias("active"), *[c.alias(n) for n, c in columns.items()])

    inserts = child(F.col("p_size") > 5, insert_paper_type=F.col("p_type"), insert_size=F.col("p_size"))
    extra = parts.where(F.col("p_size") > 45).select(
        key, F.lit(1).alias("active"), F.lit("EXTRA").alias("insert_paper_type"), F.col("p_size").alias("insert_size")
    )
    return {
        "production_parts": lines.select(
            F.concat(F.when(part_key % 2 == 0, "PZ").otherwise(""), part_key.cast("string")).alias("part_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("bigint").alias("line_no"),
            F.when(F.col("l_linenumber") % 5 == 0, 1).otherwise(0).alias("split"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        ),
        "orders": orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("client_id"),
            F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("order_num"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("reception_date"),
            (F.col("o_orderkey") % 1000 + 1).alias("quantity"),
            (F.col("o_orderkey") % 10).alias("qty_min"),
            F.col("o_orderpriority").alias("priority_level"),
        ),
        "clients": customers.select(
            F.col("c_custkey").alias("client_id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("string").alias("shipping_country"),
            F.col("c_custkey").cast("string").alias("siren"),
            (F.col("c_custkey") % 21).cast("double").alias("tva"),
        ),
        "part_coils": child(F.col("p_size") > 10, coil_type=F.col("p_brand")),
        "part_covers": child(F.col("p_size") > 20, cover_size=F.col("p_type"), cover_color=F.col("p_brand")),
        "part_tabs": child(F.col("p_size") > 30, tab_color=F.col("p_brand"), tab_size=F.col("p_size")),
        "part_inserts": inserts.unionByName(extra),
        "part_covers_cases": child(F.col("p_size") > 40, spine_type=F.col("p_type")),
        "kits": orders.where(F.col("o_orderstatus") == "P").select(
            F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("active")
        ),
    }


# Child columns that exist in the derived relations.
CHILDREN = {
    "part_coils": {"coil_type": "coil_type"},
    "part_covers": {"cover_size": "cover_size", "cover_color": "cover_color"},
    "part_tabs": {"active": "tab_active", "tab_color": "tab_color", "tab_size": "tab_size"},
    "part_inserts": {
        "active": "insert_active", "insert_paper_type": "insert_paper_type", "insert_size": "insert_size",
    },
    "part_covers_cases": {"spine_type": "spine_type"},
}

RELATIONS = """
pparts AS (
  SELECT CASE WHEN l_partkey % 2 = 0 THEN 'PZ' ELSE '' END || CAST(l_partkey AS VARCHAR) AS part_id,
         l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no,
         CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS split, l_extendedprice / l_quantity AS unit_price
  FROM lineitem),
porders AS (
  SELECT o_orderkey AS order_id, o_custkey AS client_id, 'N' || CAST(o_orderkey AS VARCHAR) AS order_num,
         strftime(o_orderdate, '%Y-%m-%d') AS reception_date, o_orderkey % 1000 + 1 AS quantity,
         o_orderkey % 10 AS qty_min, o_orderpriority AS priority_level
  FROM orders),
pclients AS (
  SELECT c_custkey AS client_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS shipping_country,
         CAST(c_custkey AS VARCHAR) AS siren, CAST(c_custkey % 21 AS DOUBLE) AS tva
  FROM customer),
part_coils AS (SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size > 10 AS INT) AS active, p_brand AS coil_type FROM part),
part_covers AS (SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size > 20 AS INT) AS active, p_type AS cover_size, p_brand AS cover_color FROM part),
part_tabs AS (SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size > 30 AS INT) AS active, p_brand AS tab_color, p_size AS tab_size FROM part),
part_inserts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size > 5 AS INT) AS active, p_type AS insert_paper_type, p_size AS insert_size FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'EXTRA', p_size FROM part WHERE p_size > 45),
part_covers_cases AS (SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size > 40 AS INT) AS active, p_type AS spine_type FROM part),
kits AS (SELECT o_orderkey AS order_id, CAST(o_orderkey % 3 = 0 AS INT) AS active FROM orders WHERE o_orderstatus = 'P')
"""


# Quotients and interpolated quantiles of short decimals often end exactly on a
# half, which the engines round differently. Both sides add this before rounding.
OFF_HALF = 1.23456789e-7


def r6(expression: str) -> str:
    """SQL for a value rounded to six digits away from exact halves."""
    return f"round(({expression}) + {OFF_HALF!r}, 6)"
