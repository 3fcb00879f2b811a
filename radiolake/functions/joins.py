"""Joins on ranges, with an equality key so they shuffle like any other join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    at: str,
    start: str,
    end: str,
    bin_width: float,
    how: str = "inner",
    closed_end: bool = False,
) -> DataFrame:
    """Pairs with ``start <= at < end`` (``<= end`` when closed).

    An interval is listed once per bin it touches and a point has one bin, so each pair
    meets exactly once; long intervals and busy keys spread over many bins.
    """
    width = F.lit(float(bin_width))

    def bin_of(c: Column) -> Column:
        return F.floor(c / width).cast("bigint")

    spans = intervals.where(F.col(start) <= F.col(end)).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end))))
    )
    pts = points.withColumn("_bin", bin_of(F.col(at)))
    upper = (F.col(f"p.{at}") <= F.col(f"i.{end}")) if closed_end else (F.col(f"p.{at}") < F.col(f"i.{end}"))
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bin"]]
    on += [F.col(f"p.{at}") >= F.col(f"i.{start}"), upper]
    joined = pts.alias("p").join(spans.alias("i"), on, how)
    own = [c for c in intervals.columns if c not in keys and c not in points.columns]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in own])
