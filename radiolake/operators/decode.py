"""Running a user's decoder over windows of samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.functions.joins import interval_join

Decoder = Callable[[np.ndarray, float, dict], pd.DataFrame]


def decode_windows(
    chunks: DataFrame, windows: DataFrame, scope: list[str], decoder: Decoder, out_schema: str, bin_samples: float,
    gaps: str = "split",
) -> DataFrame:
    """Call ``decoder(iq, sample_rate_hz, window)`` for every window and collect its rows.

    ``windows`` has scope, window_id, start_sample and end_sample (exclusive), and any
    columns the decoder wants to see.  Only chunks a window touches travel, and a task
    holds one window's samples, whose length the window split bounds.  ``bin_samples`` is at
    least the length of the longest chunk.

    Samples lie at their own numbers.  Where a window misses some, ``gaps`` says what happens:
    ``split`` calls the decoder once for each unbroken stretch, whose ``start_sample`` and
    ``end_sample`` it then sees in the window; ``zero`` fills with zeros; ``fail`` raises.
    """
    if gaps not in ("split", "zero", "fail"):
        raise ValueError(f"unknown rule for gaps: {gaps}")
    scope = list(scope)
    spans = windows.withColumns({"_w0": F.col("start_sample"), "_w1": F.col("end_sample"), "_w": F.struct(*windows.columns)})
    spans = spans.select(*scope, "_w", "_w0", "_w1")
    chunk = F.struct("start_sample", "i", "q")
    parts = chunks.select(*scope, "start_sample", "end_sample", "sample_rate_hz", chunk.alias("_c"))
    # a chunk is listed at its first sample and, where that lies before the window, at the window's start
    listed = parts.withColumns({"_at": F.col("start_sample")})
    lead = spans.withColumn("_w0", F.col("_w0") - F.lit(float(bin_samples)).cast("bigint"))
    pairs = interval_join(listed, lead, scope, "_at", "_w0", "_w1", bin_samples).where(
        F.col("end_sample") > F.col("_w.start_sample")
    )
    fields = [f.split()[0] for f in out_schema.split(", ")]
    keys = [*scope, "window_id"]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["_w"].iloc[0]
        w0, w1 = int(w["start_sample"]), int(w["end_sample"])
        iq, there = np.zeros(w1 - w0, complex), np.zeros(w1 - w0, bool)
        for c in pdf["_c"]:
            x = np.asarray(c["i"], float) + 1j * np.asarray(c["q"], float)
            at = int(c["start_sample"])
            lo, hi = max(w0, at), min(w1, at + len(x))
            if lo < hi:
                iq[lo - w0 : hi - w0], there[lo - w0 : hi - w0] = x[lo - at : hi - at], True
        if gaps == "fail" and not there.all():
            raise ValueError(f"window {w['window_id']} lacks {int((~there).sum())} samples")
        edges = np.flatnonzero(np.diff(np.r_[False, there, False]))
        spans = zip(edges[::2], edges[1::2], strict=True) if gaps == "split" else [(0, w1 - w0)]
        rate = float(pdf["sample_rate_hz"].iloc[0])
        out = [
            decoder(iq[a:b], rate, {**dict(w), "start_sample": w0 + int(a), "end_sample": w0 + int(b)}) for a, b in spans
        ]
        out = pd.concat([x.reindex(columns=fields) for x in out], ignore_index=True) if out else pd.DataFrame(columns=fields)
        for k in keys:
            out[k] = w[k]
        return out[[*keys, *fields]]

    grouped = pairs.withColumn("window_id", F.col("_w.window_id")).groupBy(*keys)
    return grouped.applyInPandas(run, f"{head}, {out_schema}")
