"""The three percentile rules in use, as exact order statistics.

``midpoint``   interpolates at (i - 0.5) / n   (envelope thresholds)
``linear``     interpolates at (n - 1) p       (sweep summaries; Spark's ``percentile``)
``nearest``    takes element ceil(p n)         (interval trends, modulation gate)

The ``*_of`` forms take a sorted array and suit groups bounded by construction (the bins
of one spectrum, the samples of one window).  ``grouped_quantiles`` is for groups of any
size: it counts values in cells, finds the cells that hold the wanted ranks, and sorts
only those, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(arr: Column, i: Column) -> Column:
    """1-based element with the index clamped to the array."""
    n = F.size(arr)
    return F.element_at(arr, F.greatest(F.lit(1), F.least(n, i)).cast("int"))


def midpoint_of(sorted_values: Column, p: float) -> Column:
    n = F.size(sorted_values)
    pos = n * F.lit(float(p)) + F.lit(0.5)
    lo = F.floor(pos)
    frac = F.when(pos < 1, 0.0).when(pos >= n, 0.0).otherwise(pos - lo)
    a, b = _at(sorted_values, lo), _at(sorted_values, lo + 1)
    return F.when(n > 0, F.when(pos >= n, _at(sorted_values, n)).otherwise(a + (b - a) * frac))


def linear_of(sorted_values: Column, p: float) -> Column:
    n = F.size(sorted_values)
    pos = F.lit(1.0) + (n - 1) * F.lit(float(p))
    lo = F.floor(pos)
    a, b = _at(sorted_values, lo), _at(sorted_values, F.ceil(pos))
    return F.when(n > 0, a * (1 - (pos - lo)) + b * (pos - lo))


def nearest_of(sorted_values: Column, p: float) -> Column:
    n = F.size(sorted_values)
    return F.when(n > 0, _at(sorted_values, F.ceil(n * F.lit(float(p)))))


def _ranks(rule: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, fraction) of one percentile of n values."""
    one = F.lit(1).cast("bigint")
    if rule == "nearest":
        r = F.greatest(one, F.least(n, F.ceil(n * F.lit(float(p))).cast("bigint")))
        return r, r, F.lit(0.0)
    pos = n * F.lit(float(p)) + 0.5 if rule == "midpoint" else 1.0 + (n - 1) * F.lit(float(p))
    pos = F.greatest(F.lit(1.0), F.least(n.cast("double"), pos))
    lo = F.floor(pos).cast("bigint")
    return lo, F.ceil(pos).cast("bigint"), pos - lo


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, tuple[str, float]],
    cell: float,
) -> DataFrame:
    """One row per key with exact percentiles; ``wanted`` maps a name to (rule, p).

    ``cell`` is the width of a counting cell; a key needs range / cell of them.
    """
    keys = list(keys)
    vals = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_x")
    )
    vals = vals.withColumn("_cell", F.floor(F.col("_x") / F.lit(float(cell))).cast("bigint"))
    counts = vals.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns(
        {"_cum": F.sum("_n").over(up), "_total": F.sum("_n").over(Window.partitionBy(*keys))}
    )
    targets = []
    for name, (rule, p) in wanted.items():
        lo, hi, frac = _ranks(rule, p, F.col("_total"))
        targets += [
            F.struct(F.lit(f"{name}|lo").alias("slot"), lo.alias("rank"), frac.alias("frac")),
            F.struct(F.lit(f"{name}|hi").alias("slot"), hi.alias("rank"), frac.alias("frac")),
        ]
    picks = (
        counts.select(*keys, "_cell", "_n", "_cum", F.explode(F.array(*targets)).alias("_t"))
        .where((F.col("_t.rank") <= F.col("_cum")) & (F.col("_t.rank") > F.col("_cum") - F.col("_n")))
        .select(
            *keys,
            "_cell",
            F.col("_t.slot").alias("_slot"),
            F.col("_t.frac").alias("_frac"),
            (F.col("_t.rank") - (F.col("_cum") - F.col("_n"))).alias("_left"),
        )
    )
    cells = picks.select(*keys, "_cell").distinct()
    inside = (
        vals.join(cells, [*keys, "_cell"], "left_semi")
        .groupBy(*keys, "_cell", "_x")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    seen = Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.sum("_m").over(seen))
    hit = (
        picks.join(inside, [*keys, "_cell"])
        .where((F.col("_left") <= F.col("_upto")) & (F.col("_left") > F.col("_upto") - F.col("_m")))
    )
    out = []
    for name in wanted:
        lo = F.max(F.when(F.col("_slot") == f"{name}|lo", F.col("_x")))
        hi = F.max(F.when(F.col("_slot") == f"{name}|hi", F.col("_x")))
        frac = F.max(F.when(F.col("_slot") == f"{name}|lo", F.col("_frac")))
        out.append((lo + (hi - lo) * frac).alias(name))
    return hit.groupBy(*keys).agg(*out)
