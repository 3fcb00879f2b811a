"""Duplicate removal on streams, bounded by the retained window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.functions.keys import is_persistent, stream_key


def unseen_stream(stream: DataFrame, scope: list[str], event_time: str, retained: str = "8 seconds") -> DataFrame:
    """PDUs not reported before.

    Timed keys are remembered while the retained window covers them, which is the watermark;
    call and session keys are remembered for good.
    """
    rows = stream.withColumns({"_persistent": is_persistent(stream), "ledger_key": F.to_json(stream_key(stream))})
    timed = (
        rows.where("NOT _persistent")
        .withWatermark(event_time, retained)
        .dropDuplicatesWithinWatermark([*scope, "ledger_key"])
    )
    lasting = rows.where("_persistent").dropDuplicates([*scope, "ledger_key"])
    return timed.unionByName(lasting).drop("_persistent")


def first_epochs_stream(stream: DataFrame, event_time: str, retained: str = "10 minutes") -> DataFrame:
    """First report of each closed epoch."""
    return stream.withWatermark(event_time, retained).dropDuplicatesWithinWatermark(["channel_id", "epoch_id"])


def merge_runs_stream(stream: DataFrame, scope: list[str], event_time: str, gap: str, lateness: str) -> DataFrame:
    """Activity joined across pauses shorter than ``gap``."""
    w = F.session_window(event_time, gap)
    return (
        stream.withWatermark(event_time, lateness)
        .groupBy(*scope, w.alias("w"))
        .agg(F.min(event_time).alias("run_start"), F.max(event_time).alias("run_end"), F.count(F.lit(1)).alias("rows"))
        .drop("w")
    )
