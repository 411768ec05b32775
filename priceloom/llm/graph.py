"""Connected components of a link table, kept on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scale import settle


def _lowest(links: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour; a map-side combined aggregate, so hubs are no hot task."""
    return links.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest node around it."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("_m", F.least("_m", "_u"))
    return both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them. ``links`` has u > v."""
    low = _lowest(links)
    moved = links.join(low, F.col("u") == F.col("_u")).where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(low.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of ``links`` (u, v: long) that is not the smallest of its component, with that smallest.

    Large and small star steps alternate until nothing changes; every step is written,
    so lineage stays short and a lost executor repeats one step.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = settle(links, "links")
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
        links = settle(_small_star(settle(_large_star(links), "large-star")), "small-star")
