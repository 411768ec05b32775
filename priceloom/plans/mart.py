"""Source relations to consolidated, cleaned and enriched layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.operators import cleaning, clients, consolidate
from priceloom.operators.consolidate import CHILD_COLUMNS
from priceloom.sources.sinks import sink_table


def extract(relations: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]] = CHILD_COLUMNS) -> DataFrame:
    """One extract: filters, star, children.

    Orders with an active kit are dropped before the join with the parts: the
    inner join then drops their parts, and the parts are shuffled by order once.
    """
    parts = consolidate.filter_not_split(relations["production_parts"])
    orders = consolidate.join_not_exists_kits(relations["orders"], relations["kits"])
    orders = consolidate.project_renamed(orders, consolidate.ORDER_COLUMNS, ["order_id", "client_id"])
    clients_ = consolidate.project_renamed(relations["clients"], consolidate.CLIENT_COLUMNS, ["client_id"])
    # the first of same-named columns wins, and parts come first
    orders = orders.drop(*[c for c in orders.columns if c in parts.columns and c != "order_id"])
    taken = {*parts.columns, *orders.columns}
    clients_ = clients_.drop(*[c for c in clients_.columns if c in taken and c != "client_id"])
    star = consolidate.join_star_inner(parts, orders, clients_)
    children = {n: relations[n] for n in columns if n in relations}
    fresh = {n: {a: b for a, b in columns[n].items() if b not in star.columns} for n in children}
    return consolidate.join_active_children_left(star, children, fresh)


def build_mart(
    relations: Mapping[str, DataFrame] | Sequence[Mapping[str, DataFrame]],
    static: DataFrame | None = None,
    columns: Mapping[str, Mapping[str, str]] = CHILD_COLUMNS,
    precedence: Sequence[str] = ("source_rank", "source_file"),
) -> DataFrame:
    """Static history first, then the extracts in their order; one row per part.

    ``relations`` is one extract or a list of them. Columns of ``precedence`` that no
    frame has are passed over.
    """
    extracts = [relations] if isinstance(relations, Mapping) else list(relations)
    frames = [extract(r, columns).withColumn("source_rank", F.lit(i)) for i, r in enumerate(extracts, 1)]
    if static is not None:
        frames.insert(0, static.withColumn("source_rank", F.lit(0)))
    known = {c for f in frames for c in f.columns}
    order = [F.col("source_rank"), *[F.col(c).asc_nulls_last() for c in precedence if c != "source_rank" and c in known]]
    return consolidate.consolidate(frames, order).drop("source_rank")


def refresh(mart: DataFrame, folder: str, null_tokens: Sequence[str] | None = None) -> dict[str, str]:
    """Clean a mart, derive client features, enrich the orders; every layer is written.

    Later layers read the written one, so no layer is computed twice.
    """
    spark = mart.sparkSession
    paths = {n: f"{folder}/{n}" for n in ("consolidated", "cleaned", "client_features", "enriched")}
    sink_table(mart, paths["consolidated"])
    cleaned = cleaning.full_cleaning(spark.read.parquet(paths["consolidated"]), null_tokens)
    sink_table(cleaned, paths["cleaned"])
    orders = spark.read.parquet(paths["cleaned"])
    features = clients.client_features(cleaning.filter_nonzero_price(orders))
    sink_table(features, paths["client_features"])
    enriched = clients.join_enrich_orders(orders, spark.read.parquet(paths["client_features"]))
    sink_table(enriched, paths["enriched"])
    return paths
