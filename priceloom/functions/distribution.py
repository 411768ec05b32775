"""Exact quantiles without gathering a group in one task.

Rows are first reduced to ``(group, value, n)``. Values are then placed in
order-preserving slots of about 0.05 % relative width, slot totals are
accumulated per group, and only the slots that hold a wanted rank are opened.
Every step is a map-side combined aggregate or a window over a bounded set, so
a group with a third of all rows costs no more than the others. The result is
the linear-interpolation quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from priceloom.functions.scale import join_lookup

# Slots per unit of ln(value); slots of a positive value start at SLOT_BASE.
SLOTS_PER_E = 2048
SLOT_BASE = 2_000_000


def slot_of(value: Column) -> Column:
    """Order-preserving slot number of a double."""
    width = F.floor(F.ln(F.abs(value)) * SLOTS_PER_E).cast("int") + SLOT_BASE
    slot = F.when(value > 0, width).when(value < 0, -width).otherwise(F.lit(0))
    return F.coalesce(slot, F.lit(0))  # never null, so no null filter splits a shared exchange


def value_counts(df: DataFrame, by: Sequence[str], value: str | Column) -> DataFrame:
    """Occurrences of every non-null value: ``by..., value, n``."""
    column = F.col(value) if isinstance(value, str) else value
    return (
        df.select(*by, column.cast("double").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def melted_counts(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``value_counts`` of several columns at once: ``by..., column, value, n``."""
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in values])
        ).alias("_v"),
    ).select(*by, "_v.column", "_v.value")
    return value_counts(long, [*by, "column"], "value")


def with_total(counts: DataFrame, by: str, label: str) -> DataFrame:
    """Add one more group holding all rows, built from the counts and not from the rows."""
    total = counts.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit(label).alias(by), "value", "n")
    return counts.select(by, "value", "n").unionByName(total)


def _rank_slots(slotted: DataFrame, by: Sequence[str], ranks: Column) -> DataFrame:
    """The slots that hold a wanted rank, with the rows before them."""
    in_order = Window.partitionBy(*by).orderBy("slot")
    return (
        slotted.groupBy(*by, "slot")
        .agg(F.sum("n").alias("in_slot"))
        .withColumn("upto", F.sum("in_slot").over(in_order))
        .withColumn("total", F.sum("in_slot").over(Window.partitionBy(*by)))
        .withColumn("base", F.col("upto") - F.col("in_slot"))
        .withColumn(
            "ranks",
            F.filter(ranks, lambda r: (r["rank"] >= F.col("base")) & (r["rank"] < F.col("upto"))),
        )
        .where(F.size("ranks") > 0)
        .select(*by, "slot", "base", "total", "ranks")
    )


def _rank_values(opened: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values of the wanted ranks from the rows of the opened slots."""
    within = Window.partitionBy(*by, "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        opened.withColumn("upto", F.col("base") + F.sum("n").over(within))
        .withColumn(
            "hit",
            F.explode(
                F.filter(
                    "ranks",
                    lambda r: (r["rank"] >= F.col("upto") - F.col("n")) & (r["rank"] < F.col("upto")),
                )
            ),
        )
        .select(*by, "total", F.col("hit.i").alias("i"), "value")
    )


def nth_values(counts: DataFrame, by: Sequence[str], ranks: Column) -> DataFrame:
    """Values at given zero-based ranks.

    ``ranks`` is an ``array<struct<i:int, rank:bigint>>`` expression over the
    column ``total`` (rows of the group). Returns ``by..., total, i, value``.
    """
    slotted = counts.withColumn("slot", slot_of(F.col("value")))
    return _rank_values(slotted.join(_rank_slots(slotted, by, ranks), [*by, "slot"]), by)


def nth_values_unique(rows: DataFrame, by: Sequence[str], ranks: Column) -> DataFrame:
    """``nth_values`` for values that hardly repeat, such as hashes, in few groups.

    Counting every value would shuffle all rows; here the rows are only counted
    per slot, and read again for the few slots that matter.
    """
    slotted = rows.withColumns({"n": F.lit(1).cast("bigint"), "slot": slot_of(F.col("value"))})
    opened = join_lookup(slotted, _rank_slots(slotted, by, ranks), [*by, "slot"], "inner")
    merged = opened.groupBy(*by, "slot", "value").agg(
        F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("base", "total", "ranks")]
    )
    return _rank_values(merged, by)


def _positions(probs: dict[str, float]) -> tuple[dict[str, Column], Column]:
    """Fractional position of every quantile, and the ranks on both sides of each."""
    position = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = []
    for k, name in enumerate(probs):
        for side, rank in enumerate((F.floor(position[name]), F.ceil(position[name]))):
            wanted.append(F.struct(F.lit(2 * k + side).alias("i"), rank.cast("bigint").alias("rank")))
    return position, F.array(*wanted)


def _interpolated(found: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from the values at their ranks."""
    position, _ = _positions(probs)
    columns = [F.max("total").alias("total")]
    for k in range(len(probs)):
        columns.append(F.max(F.when(F.col("i") == 2 * k, F.col("value"))).alias(f"_lo{k}"))
        columns.append(F.max(F.when(F.col("i") == 2 * k + 1, F.col("value"))).alias(f"_hi{k}"))
    rows = found.groupBy(*by).agg(*columns)
    out = [*by, "total"]
    for k, name in enumerate(probs):
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        out.append((lo + (hi - lo) * (position[name] - F.floor(position[name]))).alias(name))
    return rows.select(*out)


def quantiles(counts: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group: ``by..., total, <name of each prob>``."""
    return _interpolated(nth_values(counts, by, _positions(probs)[1]), by, probs)


def overall(df: DataFrame) -> DataFrame:
    """Give a frame the one-group key that ungrouped quantiles need."""
    return df.withColumn("_all", F.lit(1).cast(T.IntegerType()))


def quantiles_of(df: DataFrame, by: Sequence[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """Quantiles straight from the rows; ``by`` may be empty.

    The rows are counted per slot, which is combined where they are read, and read again
    for the slots with a wanted rank; the values themselves are never shuffled as a whole.
    """
    keys = list(by) or ["_all"]
    column = F.col(value) if isinstance(value, str) else value
    rows = (df if by else overall(df)).select(*keys, column.cast("double").alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    found = _interpolated(nth_values_unique(rows, keys, _positions(probs)[1]), keys, probs)
    return found if by else found.drop("_all")
