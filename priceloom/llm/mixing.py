"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all document rates between 0
and ``cap`` that meet the targets, entropy balancing takes those closest to rate
1 in relative entropy. Their dual is convex, one multiplier per source, and its
solution tilts the rates exponentially: ``rate = min(cap, exp(m * size))``. The
multipliers are found by Newton steps, each one distributed aggregate over the
size histogram; rates are then rounded into whole copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import WORD, numbered, rank_within, table, text_of

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
# Newton stops when every source is this close to its target, relative to the target.
TOLERANCE = 1e-7
STEPS = 200


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Target words of each source; ``sources`` has source and source_size (one row per source).

    Weights go round the sources in code point order, null last. The total is
    shared by weight; a target above ``cap`` times its source stops there and the
    excess is shared again among the others, until none is above. Each round is an
    aggregate and stops at least one more source, or ends. Ordering puts one row
    per source, never documents, into one task.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    state = settle(
        sources.withColumn("_nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_w", w)
        .withColumn("_most", F.col("source_size") * float(cap))
        .drop("_nth"),
        "mix-sources",
    )
    total = float(state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # a source stops when its share at the present level reaches its limit; the level only rises
    level, stopped = 0.0, -1
    while True:
        full = F.col("_most") <= F.col("_w") * F.lit(level)
        row = state.agg(
            F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("stopped"),
        ).first()
        if row["open"] == 0 or row["stopped"] == stopped:
            break
        stopped, level = row["stopped"], (total - row["held"]) / row["open"]
    return state.withColumn("target", F.least("_most", F.col("_w") * F.lit(level))).drop("_w", "_most")


def tilt(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """Multiplier of each source: source, m (of sizes divided by the source's largest), largest.

    ``cells`` (source, size > 0, n) and ``targets`` (source, target) are written
    tables. ``sum n size min(cap, exp(m size)) = target`` is solved for all sources at
    once: one aggregate per step, Newton inside a bracket that every step narrows,
    halving it when Newton would leave it.
    """
    largest = cells.groupBy("source").agg(F.max("size").alias("largest"), F.sum(F.col("n") * F.col("size")).alias("_all"))
    state = settle(
        largest.join(targets, [largest["source"].eqNullSafe(targets["source"])]).select(
            largest["source"], "largest", "target", F.lit(0.0).alias("m"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"),
            F.lit(False).alias("lo_ok"), F.lit(False).alias("hi_ok"),
            # at the cap every rate is the cap, reached from the multiplier that lifts size 1 to it
            (F.col("target") >= F.col("_all") * cap * (1 - 1e-12)).alias("full"), F.lit(False).alias("done"),
        ).withColumn("m", F.when(F.col("full"), F.col("largest") * float(np.log(cap) + 1e-9)).otherwise(0.0))
        .withColumn("done", F.col("full") | (F.col("target") <= 0)),
        "mix-state",
    )
    for _ in range(STEPS):
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
        state = settle(_newton(cells, state, cap), "mix-state")
    else:
        raise ArithmeticError(f"no mix within {STEPS} Newton steps")
    return state.select("source", "m", "largest")


def _newton(cells: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    x = F.col("size") / F.col("largest")
    power = F.col("m") * x
    at_cap = power >= float(np.log(cap))
    rate = F.when(at_cap, F.lit(float(cap))).otherwise(F.exp(F.least(power, F.lit(float(np.log(cap))))))
    mass = F.col("n") * F.col("size")
    sums = (
        cells.join(state, [cells["source"].eqNullSafe(state["source"])])
        .groupBy(state["source"])
        .agg(F.sum(mass * rate).alias("_f"), F.sum(F.when(~at_cap, mass * x * rate).otherwise(0.0)).alias("_d"))
        .withColumnRenamed("source", "_s")
    )
    gap = F.col("_f") - F.col("target")
    hit = F.abs(gap) <= F.col("target") * TOLERANCE
    state = state.join(sums, state["source"].eqNullSafe(F.col("_s"))).withColumns({
        "done": F.col("done") | hit,
        "lo": F.when(gap < 0, F.col("m")).otherwise(F.col("lo")),
        "hi": F.when(gap > 0, F.col("m")).otherwise(F.col("hi")),
        "lo_ok": F.col("lo_ok") | (gap < 0),
        "hi_ok": F.col("hi_ok") | (gap > 0),
        "_step": F.col("m") - gap / F.nullif(F.col("_d"), F.lit(0.0)),
    })
    # a step that leaves the bracket is replaced: by the middle, or by doubling while an end is open
    open_low = F.least(F.col("m") * 2, F.lit(-1.0))
    open_high = F.greatest(F.col("m") * 2, F.lit(1.0))
    middle = (F.col("lo") + F.col("hi")) / 2
    inside = (~F.col("lo_ok") | (F.col("_step") > F.col("lo"))) & (~F.col("hi_ok") | (F.col("_step") < F.col("hi")))
    fallback = F.when(~F.col("lo_ok"), open_low).when(~F.col("hi_ok"), open_high).otherwise(middle)
    narrow = F.col("lo_ok") & F.col("hi_ok") & (F.col("hi") - F.col("lo") <= F.abs(middle) * 1e-14)
    return state.withColumns({
        "m": F.when(F.col("done"), F.col("m")).when(F.coalesce(inside, F.lit(False)), F.col("_step")).otherwise(fallback),
        "done": F.col("done") | narrow,
    }).drop("_s", "_f", "_d", "_step")


def _round_cells(parts: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Copies of each size of one source, largest size first; what rounding leaves over is carried on."""
    cells = parts.sort_values("size", ascending=False, kind="stable")
    carry, whole, extra = 0.0, [], []
    for n, size, rate in zip(cells["n"], cells["size"], cells["rate"]):
        wanted = n * rate + carry / size
        copies = int(min(max(np.floor(wanted + 0.5), 0), np.floor(cap) * n))
        carry += size * (n * rate - copies)
        whole.append(copies // n)
        extra.append(copies % n)
    return pd.DataFrame({"source": cells["source"], "size": cells["size"], "whole": whole, "extra": extra})


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS, order_column: str | None = None, cap: float = CAP,
) -> DataFrame:
    """Copies of every document in the mix: doc_id, source, size, source_size, target, rate, copies, taken.

    Size is the number of words (null text: 0). Documents of equal source and size
    share a rate; rates are rounded, largest documents first, so that the words of a source meet its target
    up to about half its smallest document (a document that outweighs all the rest of its source may leave more). Which of equal-sized documents get
    the extra copy follows a hash of the id (or of ``order_column``). Empty tables give no rows; documents of
    size 0 and sources without words take nothing; repeated rows are documents of
    their own; other columns are not read.
    """
    sized = settle(
        docs.select(
            F.col(id_column).alias("doc_id"), F.col(order_column or id_column).alias("_order"), F.col(source_column).alias("source"),
            F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    cells = settle(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    targets = settle(source_targets(sources, weights, cap), "mix-targets")
    real = cells.where("size > 0")
    multipliers = tilt(real, targets.select("source", "target"), cap)
    power = F.col("m") * F.col("size") / F.col("largest")
    rates = real.join(multipliers, [real["source"].eqNullSafe(multipliers["source"])]).select(
        real["source"], "size", "n",
        F.when(power >= float(np.log(cap)), F.lit(float(cap))).otherwise(F.exp(power)).alias("rate"),
    )
    rounded = settle(
        rates.groupBy("source").applyInPandas(lambda parts: _round_cells(parts, cap), "source string, size long, whole int, extra long")
        .join(rates.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "rate"),
              [F.col("source").eqNullSafe(F.col("_s")), F.col("size") == F.col("_z")])
        .drop("_s", "_z"),
        "mix-rounded",
    )
    ranked = rank_within(sized, ["source", "size"], ["_order", "doc_id"])
    cell = rounded.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "whole", "extra", "rate")
    copies = F.coalesce(F.col("whole") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0), F.lit(0)).cast("int")
    out = ranked.join(cell, [F.col("source").eqNullSafe(F.col("_s")), F.col("size") == F.col("_z")], "left")
    totals = targets.withColumnRenamed("source", "_t")
    return out.join(totals, out["source"].eqNullSafe(F.col("_t")), "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"),
        copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"),
    )


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document of ``docs`` (a table read) as often as the mix takes it, 0 to 3 times."""
    rows = numbered(docs)
    narrow = rows.select("_row", *[F.col("doc").getField(c).alias(c) for c in ("doc_id", "text", "source")])
    copies = settle(
        mix(narrow, id_column="_row", order_column="doc_id").where("copies > 0").select(F.col("doc_id").alias("_of"), F.col("copies").alias("_copies")),
        "mix-copies",
    )
    return (
        rows.join(copies.hint("shuffle_hash"), F.col("_row") == F.col("_of"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    )
