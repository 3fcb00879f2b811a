"""Live routing: rows of one stream meet the ranges of another (events and epochs, batches and tracks).

The stream's own clock is the event time: a position divided by its rate.  Both sides carry a
watermark on it, and Spark keeps a row only as long as the other side can still bring a partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PT, _ST, _BIN, _AT_BIN = "_point_time", "_span_time", "_bin", "_at_bin"


def position_time(position: Column, rate: float) -> Column:
    """Event time of a position that advances by ``rate`` a second."""
    return F.timestamp_micros(F.floor(position.cast("double") * F.lit(1e6 / rate)).cast("bigint"))


def interval_join_live(
    points: DataFrame,
    spans: DataFrame,
    keys: list[str],
    at: str,
    start: str,
    end: str,
    rate: float,
    max_span_sec: float,
    bin_width: float,
    delay: str = "0 seconds",
    how: str = "inner",
    closed_end: bool = False,
) -> DataFrame:
    """Pairs with ``start <= at < end`` (``<= end`` when closed) of two streams.

    A range is reported when it is over, so its time is its end, and points wait for it
    ``max_span_sec`` behind the watermark.  A range longer than that fails the query instead of
    missing points.  A range is listed once for each bin of ``bin_width`` positions, so state and
    work of a busy key are dealt over its bins.  With ``how="left_outer"`` a point without any range
    is returned once the watermark has passed it.

    The watermark is the smaller one of both streams, ``delay`` behind the largest position seen
    over all keys.  Rows that come behind it are dropped and counted as
    ``numRowsDroppedByWatermark`` in the progress of the query.  Rows with a null key or position
    and ranges that are empty meet nothing.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError(f"unknown join {how!r}")
    rest = [c for c in spans.columns if c not in keys]
    twice = sorted(set(rest) & set(points.columns))
    if twice:
        raise ValueError(f"both sides have {', '.join(twice)}")
    width = F.lit(float(bin_width))
    hold = F.lit(int(max_span_sec * 1e6))
    length = (F.col(end) - F.col(start)) * F.lit(1e6 / rate)
    too_long = F.raise_error(F.concat(F.lit("a range is longer than max_span_sec: "), F.col(end).cast("string")))
    checked = F.when(length > hold, too_long.cast("timestamp")).otherwise(position_time(F.col(end), rate))
    ranges = spans.where(F.col(start) <= F.col(end)).withColumn(_ST, checked).withWatermark(_ST, delay)
    first, last = (F.floor(F.col(c) / width).cast("bigint") for c in (start, end))
    names = {c: f"_s_{c}" for c in keys}
    ranges = ranges.withColumn(_BIN, F.explode(F.sequence(first, last))).withColumnsRenamed(names)
    rows = points.withColumn(_PT, position_time(F.col(at), rate)).withWatermark(_PT, delay)
    rows = rows.withColumn(_AT_BIN, F.floor(F.col(at) / width).cast("bigint"))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed_end else (F.col(at) < F.col(end)))
    # the times follow from the positions; they tell Spark how long a row may have to wait
    wait = F.expr(f"INTERVAL '{max_span_sec:f}' SECOND")
    timely = (F.col(_PT) <= F.col(_ST)) & (F.col(_PT) >= F.col(_ST) - wait - F.expr("INTERVAL '0.000002' SECOND"))
    same = F.col(_AT_BIN) == F.col(_BIN)
    for key, name in names.items():
        same = same & (F.col(key) == F.col(name))
    joined = rows.join(ranges, same & inside & timely, how)
    return joined.select(*points.columns, *rest)


def route_live(
    batches: DataFrame, closed: DataFrame, scope: list[str], rate: float, max_span_sec: float, bin_width: float = 1024,
    delay: str = "0 seconds",
) -> DataFrame:
    """``tracking.route`` on streams: batches (scope, seq) with the tracks (scope, track_id, first_seq,
    closed_seq) that lived in them.  A track is reported when it closes; ``rate`` is batches a second."""
    spans = closed.select(*scope, "track_id", F.col("first_seq").alias("_first"), F.col("closed_seq").alias("_until"))
    out = interval_join_live(
        batches, spans, scope, "seq", "_first", "_until", rate, max_span_sec, bin_width, delay, closed_end=True
    )
    return out.drop("_first", "_until")


def assign_live(
    pdus: DataFrame, closed: DataFrame, scope: list[str], sample: str, rate: float, max_span_sec: float,
    bin_samples: float, delay: str = "0 seconds", keep_unassigned: bool = False,
) -> DataFrame:
    """``activity.assign_to_epochs`` on streams: PDUs with the closed epoch whose [decode_start,
    end_sample) holds them; with ``keep_unassigned`` also those of no epoch, when that is sure."""
    spans = closed.select(*scope, "epoch_id", F.col("decode_start").alias("_from"), F.col("end_sample").alias("_until"))
    how = "left_outer" if keep_unassigned else "inner"
    out = interval_join_live(pdus, spans, scope, sample, "_from", "_until", rate, max_span_sec, bin_samples, delay, how)
    return out.drop("_from", "_until")
