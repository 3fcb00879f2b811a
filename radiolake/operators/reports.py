"""Quality reports and run metrics: grouped aggregates throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.stats import grouped_quantiles

EPS = 2.220446049250313e-16


def frame_quality(frames: DataFrame, scope: list[str]) -> DataFrame:
    """Valid share, block pass share and mean sync score of valid frames."""
    valid = F.col("frame_valid")
    n = F.count(F.lit(1))
    return frames.groupBy(*scope).agg(
        n.alias("frame_count"),
        F.count_if(valid).alias("valid_frame_count"),
        (F.count_if(valid) / n).alias("valid_frame_ratio"),
        (F.count_if("block_ok") / n).alias("block_pass_ratio"),
        F.coalesce(F.avg(F.when(valid, F.col("sync_score"))), F.lit(0.0)).alias("mean_valid_sync_score"),
    )


def lich_histogram(frames: DataFrame, scope: list[str]) -> DataFrame:
    return frames.groupBy(*scope, "lich").agg(F.count(F.lit(1)).alias("frame_count"))


STRONG = ("LC_HEADER", "TERMINATOR", "LATE_ENTRY")


def decoder_counters(pdus: DataFrame, scope: list[str], candidate: Column) -> DataFrame:
    """Burst candidates, PDUs and strong PDUs per scope.

    ``candidate`` identifies the burst a PDU came from; it is reduced to one row per burst
    first, so no large set is held anywhere."""
    bursts = pdus.groupBy(*scope, candidate.alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("type").isin(*STRONG)).alias("_s")
    )
    return bursts.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.sum("_n").alias("pdu_count"), F.sum("_s").alias("strong_pdu_count")
    )


# Event types a scan summary counts
SUMMARY_TYPES = {
    "dmac_sync_count": "TETRA_DMAC_SYNC",
    "stch_count": "TETRA_STCH",
    "schf_count": "TETRA_SCHF",
    "tch_candidate_count": "TETRA_TCH_CANDIDATE",
    "session_count": "TETRA_SESSION",
}


def scan_summary(pdus: DataFrame, windows: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scan from its events and its window reports (pdu_count,
    confirmed_bursts, dsb_count, dnb_count)."""
    events = pdus.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("pdu_count"),
        *[F.count_if(F.col("type") == t).alias(n) for n, t in SUMMARY_TYPES.items()],
    )
    reports = windows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if(F.col("pdu_count") > 0).alias("decoded_window_count"),
        F.sum("confirmed_bursts").alias("confirmed_burst_count"),
        F.sum("dsb_count").alias("dsb_count"),
        F.sum("dnb_count").alias("dnb_count"),
    )
    out = reports.join(events, list(scope), "left")
    return out.fillna(0, ["pdu_count", *SUMMARY_TYPES])


DIAGNOSTICS = [
    "timing_error_rad", "coarse_frequency_offset_hz", "decision_variant", "confirmed_bursts", "dsb_count", "dnb_count",
    "dmac_sync_count", "stch_count", "schf_count",
]


def window_reports(windows: DataFrame, diagnostics: DataFrame, pdus: DataFrame, on: list[str]) -> DataFrame:
    """Windows with how many PDUs they gave and what the decoder said about them."""
    counts = pdus.groupBy(*on).agg(F.count(F.lit(1)).alias("pdu_count"))
    diag = diagnostics.select(*on, *[c for c in DIAGNOSTICS if c in diagnostics.columns])
    out = windows.join(counts, on, "left").join(diag, on, "left")
    filled = [c for c in out.columns if c.endswith(("_count", "_bursts")) and c not in windows.columns]
    return out.fillna(0, filled)


def _mean(col: str) -> Column:
    """Mean from a decimal sum: the same whatever order tasks finish in."""
    return (F.sum(F.col(col).cast("decimal(28,9)")) / F.count(col)).cast("double")


def decoder_timing(metrics: DataFrame, scope: list[str]) -> DataFrame:
    """Completions and compute / dispatch times per scope, and overall (null scope)."""
    return metrics.rollup(*scope).agg(
        F.count(F.lit(1)).alias("completions"),
        _mean("compute_sec").alias("mean_compute_sec"),
        F.max("compute_sec").alias("max_compute_sec"),
        _mean("dispatch_sec").alias("mean_dispatch_sec"),
        F.max("dispatch_sec").alias("max_dispatch_sec"),
    )


def slowest_feed(metrics: DataFrame, scope: list[str], elapsed: Column, order: str) -> DataFrame:
    """The row of the slowest feed of each scope, the first one on a tie."""
    rest = [c for c in metrics.columns if c not in scope]
    best = metrics.groupBy(*scope).agg(
        F.max_by(F.struct(elapsed.alias("elapsed_sec"), *rest), F.struct(elapsed.alias("e"), (-F.col(order)).alias("o"))).alias("_b")
    )
    return best.select(*scope, "_b.*")


def checkpoints(obs: DataFrame, scope: list[str], at: str, targets: list[float], keep: list[str]) -> DataFrame:
    """First observation at or after each target, one pass over the observations."""
    picks = [
        F.struct(
            F.lit(float(t)).alias("target"),
            F.min_by(F.struct(at, *keep), F.when(F.col(at) >= t, F.struct(at, "seq"))).alias("o"),
        )
        for t in targets
    ]
    rows = obs.groupBy(*scope).agg(*[p.alias(f"_p{i}") for i, p in enumerate(picks)])
    long = rows.select(*scope, F.explode(F.array(*[f"_p{i}" for i in range(len(picks))])).alias("p"))
    return long.where("p.o IS NOT NULL").select(*scope, "p.target", "p.o.*")


def interval_trends(
    obs: DataFrame, scope: list[str], edges: list[float], cell: float = 0.5, min_samples: int = 2
) -> DataFrame:
    """Queue statistics and slopes between checkpoints.

    ``obs`` has logical_sec, wall_sec, queue_sec and seq; an observation on an edge counts
    in both intervals beside it.
    """
    logical = F.col("logical_sec")
    spans = F.array(
        *[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    )
    rows = obs.withColumn("_i", F.explode(F.filter(spans, lambda s: (logical >= s["start"]) & (logical <= s["end"]))))
    by = [*scope, "start_sec", "end_sec"]
    rows = rows.select(
        *scope, F.col("_i.start").alias("start_sec"), F.col("_i.end").alias("end_sec"), "seq", "logical_sec", "wall_sec", "queue_sec"
    )
    at = F.struct("logical_sec", "seq")
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.regr_slope("logical_sec", "wall_sec").alias("logical_rate"),
        F.avg("queue_sec").alias("queue_mean_sec"),
        F.max("queue_sec").alias("queue_max_sec"),
        F.min_by("queue_sec", at).alias("queue_start_sec"),
        F.max_by("queue_sec", at).alias("queue_end_sec"),
        F.regr_slope("queue_sec", "logical_sec").alias("queue_slope"),
        F.regr_slope(F.col("wall_sec") - F.col("logical_sec"), F.col("logical_sec")).alias("lag_slope"),
    )
    p95 = grouped_quantiles(rows, by, "queue_sec", {"queue_p95_sec": ("nearest", 0.95)}, cell)
    return stats.where(F.col("sample_count") >= min_samples).join(p95, by)


def passes_realtime(trends: DataFrame) -> DataFrame:
    """Whether an interval kept up: rate within 2 %, queue not growing, at most 0.25 s."""
    ok = F.col("logical_rate").between(0.98, 1.02) & (F.col("queue_slope") <= 1e-3) & (F.col("queue_max_sec") <= 0.25)
    return trends.withColumn("realtime_pass", ok)


def realtime_factor(runs: DataFrame) -> DataFrame:
    duration = F.col("input_samples") / F.col("sample_rate_hz")
    return runs.withColumns(
        {
            "duration_sec": duration,
            "real_time_factor": F.col("elapsed_sec") / F.greatest(duration, F.lit(EPS)),
            "samples_per_sec": F.col("input_samples") / F.greatest(F.col("elapsed_sec"), F.lit(EPS)),
        }
    )


def channel_counts(channels: DataFrame, pdus: DataFrame, on: list[str]) -> DataFrame:
    """PDUs per tuned channel; channels without any stay with zero."""
    n = pdus.groupBy(*on).agg(F.count(F.lit(1)).alias("pdu_count"))
    return channels.join(n, on, "left").fillna(0, ["pdu_count"])


def carrier_report(pdus: DataFrame, eps: DataFrame, scope: list[str]) -> DataFrame:
    """Per carrier: protocols in order of first sight, PDUs, epochs, samples."""
    scope = list(scope)
    per = pdus.groupBy(*scope, "protocol").agg(F.min("seq").alias("_f"), F.count(F.lit(1)).alias("_n"))
    seen = per.groupBy(*scope).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_f", "protocol"))), lambda x: x["protocol"]).alias("protocols"),
        F.sum("_n").alias("pdu_count"),
    )
    spans = eps.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("epoch_count"), F.sum(F.col("end_sample") - F.col("candidate_start")).alias("epoch_samples")
    )
    out = seen.join(spans, scope, "full")
    return out.withColumn("protocols", F.coalesce("protocols", F.array().cast("array<string>"))).fillna(
        0, ["pdu_count", "epoch_count", "epoch_samples"]
    )
