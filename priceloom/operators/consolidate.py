"""From source relations to the consolidated table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from priceloom import schema as S
from priceloom.functions import values as V
from priceloom.functions.scale import join_lookup

PART_KEY = "child_part_id"

# Columns each child relation contributes, with their name in the mart.
CHILD_COLUMNS = {
    "part_coils": {"coil_type": "coil_type"},
    "part_covers": {
        "cover_paper_type": "cover_paper_type",
        "double_sided_cover": "double_sided_cover",
        "cover_color": "cover_color",
        "head_and_tail": "head_and_tail",
        "cover_size": "cover_size",
    },
    "part_tabs": {
        "active": "tab_active",
        "tab_page_number": "tab_page_number",
        "trim_size": "trim_size",
        "tab_color": "tab_color",
        "tab_lamination": "tab_lamination",
        "tab_size": "tab_size",
        "tab_paper_type": "tab_paper_type",
    },
    "part_inserts": {
        "active": "insert_active",
        "insert_lamination": "insert_lamination",
        "insert_paper_type": "insert_paper_type",
        "insert_color": "insert_color",
        "insert_size": "insert_size",
    },
    "part_covers_cases": {
        "case_finish_type": "case_finish_type",
        "case_paper_type": "case_paper_type",
        "cover_case_color": "cover_case_color",
        "back_cover_flat_size": "back_cover_flat_size",
        "spine_type": "spine_type",
    },
}

ORDER_COLUMNS = {
    "order_num": "order_num",
    "delivery_date": "delivery_date",
    "expected_date": "expected_date",
    "requester_name": "requester_name",
    "reception_date": "reception_date",
    "quantity": "quantity",
    "qty_min": "quantity_min",
    "qty_max": "quantity_max",
    "priority_level": "priority_level",
}
CLIENT_COLUMNS = {
    "name": "client_name",
    "shipping_country": "shipping_country",
    "siren": "siren",
    "tva": "tva",
}


def project_renamed(df: DataFrame, names: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, then ``names`` (source to mart name), skipping absent ones."""
    return df.select(*keep, *[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of same-named columns."""
    taken: set[str] = set()
    names, keep = [], []
    for i, name in enumerate(df.columns):
        fresh = name not in taken
        taken.add(name)
        names.append(name if fresh else f"_again_{i}")
        keep.append(fresh)
    return df.toDF(*names).select(*[f"`{n}`" for n, k in zip(names, keep) if k])


def filter_not_split(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("split") == 0)


def join_star_inner(parts: DataFrame, orders: DataFrame, clients: DataFrame) -> DataFrame:
    """Parts with their order and its client.

    Orders are unique by ``order_id`` and clients by ``client_id``. A client may
    own a third of all rows, so the client side goes through the size-checked,
    salted lookup; a large order is left to the runtime split of skewed joins.
    """
    return join_lookup(parts.join(orders, "order_id"), clients, ["client_id"], "inner", settled_rows=clients.count())


def bundle_children(
    children: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]] = CHILD_COLUMNS
) -> DataFrame:
    """The active rows of all child relations side by side, one set of rows per part id."""
    active = [
        child.where(F.col("active") == 1).select(
            F.col("part_id").alias(PART_KEY), *[F.col(a).alias(b) for a, b in columns[name].items()]
        )
        for name, child in children.items()
    ]
    keys = reduce(lambda a, b: a.unionByName(b), [c.select(PART_KEY) for c in active]).distinct()
    return reduce(lambda left, child: left.join(child, PART_KEY, "left"), active, keys)


def join_active_children_left(
    parts: DataFrame, children: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]] = CHILD_COLUMNS
) -> DataFrame:
    """Left join the active rows of every child relation on the part id without its prefix.

    The children are put side by side first, which gives the same rows as five
    joins in a row: the parts, by far the larger side, are joined once instead
    of five times, and a part id with a third of all rows is salted.
    """
    keyed = parts.withColumn(PART_KEY, F.replace("part_id", F.lit("PZ"), F.lit("")))
    return join_lookup(keyed, bundle_children(children, columns), [PART_KEY]).drop(PART_KEY)


def join_not_exists_kits(parts: DataFrame, kits: DataFrame) -> DataFrame:
    """Drop parts of orders that have an active kit."""
    return parts.join(kits.where(F.col("active") == 1).select("order_id"), "order_id", "left_anti")


def sort_orders_desc(df: DataFrame) -> DataFrame:
    """Order of the exported file; a range-partitioned sort, meant for the sink only."""
    return df.orderBy(F.desc("order_id"))


def union_align_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames by name; columns absent from one of them become null."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("No data available")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], precedence: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order; null keys collapse into one token.

    ``row_number() = 1`` is limited per key before the shuffle as well, so a key
    shared by a third of the rows sends one row per task.
    """
    tokens = {k: F.coalesce(F.col(k).cast("string"), F.lit(f"MISSING_{k}")) for k in keys}
    keyed = df.withColumns(tokens)
    first = Window.partitionBy(*keys).orderBy(*precedence)
    return keyed.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")


def fan_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur once, twice, ... : the audit of the child joins."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("copies")
        .agg(F.count(F.lit(1)).alias("n_keys"))
    )


def conform_defaults(df: DataFrame, defaults: Mapping[str, object] = S.CONSOLIDATION_DEFAULTS) -> DataFrame:
    """Add the absent columns with their typed default; present columns stay as they are."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def coerce_types(
    df: DataFrame,
    strings: Sequence[str] = tuple(S.CONSOLIDATION_STRINGS),
    numbers: Sequence[str] = tuple(S.CONSOLIDATION_NUMBERS),
) -> DataFrame:
    """Strings: null to ``NONE``. Numbers: tolerant parse, failure and null to 0."""
    casts = {c: F.coalesce(F.col(c).cast("string"), F.lit("NONE")) for c in strings if c in df.columns}
    casts |= {c: V.tolerant_number(F.col(c)) for c in numbers if c in df.columns}
    return df.withColumns(casts)


def consolidate(frames: Sequence[DataFrame], precedence: Sequence[Column]) -> DataFrame:
    """Union, keep-first per part, defaults, types."""
    merged = union_align_columns(frames)
    return coerce_types(conform_defaults(dedup_keep_first(merged, ["order_id", "part_id"], precedence)))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
