"""Ordered scans that never put a whole key into one task.

A plain ``Window.partitionBy(channel).orderBy(sample)`` sends every row of a channel to
one task.  Here a key is cut into *blocks* of a fixed width of its order column.  Each
block is scanned on its own, the blocks are summarised by a map-side combined aggregate,
the summaries (one row per block) are scanned per key, and the running value at the start
of a block is joined back.  With an integer order column that is unique per key a block
holds at most ``width`` rows, whatever share of the data the key has.

The order columns must be unique per key; null keys form a key of their own.

A scan reads its input twice (rows and block summaries).  Where one scan feeds another,
the rows in between are written once with ``settle`` so the reads do not double each time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.session import persist_table

WIDTH = 1 << 16  # order units per block
_BLK = "_blk"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows between two scans to the shared folder and go on from there."""
    return persist_table(df, "scan")


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, max, min or last (last non-null)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = False


def before(name: str, kind: str, value: Column) -> Scan:
    """Value over the rows strictly before the current one."""
    return Scan(name, kind, value)


def upto(name: str, kind: str, value: Column) -> Scan:
    """Value over the rows up to and including the current one."""
    return Scan(name, kind, value, inclusive=True)


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def _over(kind: str, col: Column, window) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(window)
    return getattr(F, kind)(col).over(window)


def block_of(order: str, width: float) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    scans: Sequence[Scan],
    width: float = WIDTH,
    reverse: bool = False,
) -> DataFrame:
    """Add every running value of ``scans`` to ``df``; blocks follow the first order column.

    With ``reverse`` the rows are walked from the last one back, so "before" means later.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    tmp = {s.name: f"_v_{s.name}" for s in scans}
    # one struct of keys and block: null keys are equal inside it, so the join back needs no
    # null-safe comparison and keeps the partitioning of the block windows
    rows = df.withColumns({tmp[s.name]: s.value for s in scans})
    rows = rows.withColumn(_BLK, F.struct(*keys, block_of(order[0], width).alias("_n")))

    def summary(s: Scan) -> Column:
        col = F.col(tmp[s.name])
        if s.kind == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(col, F.when(col.isNotNull(), _order_key(order)))
        return getattr(F, s.kind)(col)

    blocks = rows.groupBy(_BLK).agg(*[summary(s).alias(f"_s_{s.name}") for s in scans])
    number = F.col(f"{_BLK}._n")
    per_key = Window.partitionBy(*[F.col(_BLK)[k] for k in keys]).orderBy(number.desc() if reverse else number.asc())
    per_key = per_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(_BLK, *[_over(s.kind, F.col(f"_s_{s.name}"), per_key).alias(f"_c_{s.name}") for s in scans])

    row_order = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    base = Window.partitionBy(_BLK).orderBy(*row_order)
    local = rows.withColumns(
        {
            f"_l_{s.name}": _over(
                s.kind,
                F.col(tmp[s.name]),
                base.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1),
            )
            for s in scans
        }
    )
    joined = local.join(carried, _BLK, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            _combine(s.kind, F.col(f"_c_{s.name}"), F.col(f"_l_{s.name}")).alias(s.name)
            for s in scans
        ],
    )


def with_lags(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    n: int,
    width: float = WIDTH,
) -> DataFrame:
    """Add ``lag1 .. lagN``, structs of ``cols`` of the N preceding rows of the key."""
    keys = list(keys)
    rows = df.withColumn(_BLK, block_of(order, width))
    item = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])
    newest = Window.partitionBy(*keys, _BLK).orderBy(F.col(order).desc())
    tails = (
        rows.select(*keys, _BLK, item.alias("_item"), F.row_number().over(newest).alias("_rn"))
        .where(F.col("_rn") <= n)
        .groupBy(*keys, _BLK)
        .agg(F.sort_array(F.collect_list("_item")).alias("_tail"))
    )
    # every block present holds at least one row, so n earlier blocks hold the n earlier rows
    previous = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(-n, -1)
    carried = tails.select(
        *keys, _BLK, F.flatten(F.collect_list("_tail").over(previous)).alias("_carry")
    )
    base = Window.partitionBy(*keys, _BLK).orderBy(order)
    local = rows.withColumns(
        {"_pos": F.row_number().over(base)}
        | {f"_lag{k}": F.lag(item, k).over(base) for k in range(1, n + 1)}
    )
    # null keys are keys like others, so the join back has to match them
    there = carried.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, _BLK)})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, _BLK)]
    joined = local.join(there, same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.coalesce(
                F.col(f"_lag{k}"),
                F.get("_carry", F.size("_carry") - (F.lit(k) - F.col("_pos") + 1)),
            ).alias(f"lag{k}")
            for k in range(1, n + 1)
        ],
    )


def first_rows(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key.  Spark prunes each partition to its own first row before the
    shuffle (window group limit), so a key with many copies stays cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dense_index(df: DataFrame, keys: Sequence[str], order: str, name: str, width: float = WIDTH) -> DataFrame:
    """1-based position of each row in its key."""
    return scan(df, keys, order, [upto(name, "sum", F.lit(1).cast("bigint"))], width)
