"""Removing repeats: first-wins by key, ledgers, and merging of near neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.fields import field, round_half_up
from radiolake.functions.keys import dedup_key, is_persistent, stream_key
from radiolake.functions.ordered import before, first_rows, scan, settle, upto


def first_by_key(df: DataFrame, key: Column, scope: list[str], order: list[str]) -> DataFrame:
    """Keep the earliest row of every key within ``scope``.

    A partition keeps only its own first row per key before the shuffle, so even a key
    that holds a third of all rows sends one row per task.
    """
    return first_rows(df.withColumn("_key", key), [*scope, "_key"], order).drop("_key")


def deduplicate_pdus(df: DataFrame, scope: list[str] = ("capture_id",), order: list[str] = ("seq",)) -> DataFrame:
    """Protocol-aware duplicate removal; the first row of each key stays."""
    return first_by_key(df, dedup_key(df), list(scope), list(order))


def unseen(df: DataFrame, ledger: DataFrame, scope: list[str], order: str = "seq") -> DataFrame:
    """Rows a live ledger would emit.

    ``df`` carries ``retained_start`` (earliest sample still buffered when the row was
    reported) and ``sample_rate_hz``; ``ledger`` holds keys already emitted as columns
    ``scope``, ``ledger_key`` and ``seen_sample`` (null for persistent keys).  A timed key
    is forgotten once its sample lies before the retained start, a persistent one never.

    Rows reported in one pass share ``retained_start`` and only the first can be new, so
    they are reduced to one before the short history of a key is walked.
    """
    sample = field(df, "extra.stream.source_sample", "bigint", 0)
    rows = df.withColumns(
        {"_lk": stream_key(df), "_sample": sample, "_persistent": is_persistent(df)}
    )
    rows = rows.withColumn("_ks", F.to_json("_lk"))
    known = ledger.select(
        *scope, F.col("ledger_key").alias("_ks"), F.col("seen_sample").alias("_seen"), F.lit(True).alias("_known")
    )
    once = first_rows(
        rows, [*scope, "_ks", F.when(~F.col("_persistent"), F.col("retained_start"))], [order]
    ).join(known, [*scope, "_ks"], "left")
    persistent = once.where(F.col("_persistent") & F.col("_known").isNull())
    timed = once.where(~F.col("_persistent"))
    # one entry per pass that still covers the 5 ms bucket: as many as the buffer is long
    history = timed.groupBy(*scope, "_ks").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("retained_start").alias("r"), F.col("_sample").alias("s")))).alias("h"),
        F.max("_seen").alias("seen"),
    )
    walked = F.aggregate(
        "h",
        F.struct(F.col("seen").cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.when(
            acc["last"].isNull() | (acc["last"] < x["r"]),
            F.struct(x["s"].alias("last"), F.concat(acc["out"], F.array(x["o"].cast("bigint"))).alias("out")),
        ).otherwise(acc),
    )
    emitted = history.select(*scope, F.explode(walked["out"]).alias(order))
    new_timed = timed.join(emitted, [*scope, order], "left_semi")
    out = persistent.unionByName(new_timed)
    return out.select(*df.columns, F.col("_ks").alias("ledger_key"))


def burst_candidates(df: DataFrame, scope: list[str], window: int = 50) -> DataFrame:
    """First sync candidate per ``window`` samples and sync type."""
    return first_rows(
        df.withColumn("_b", round_half_up(F.round(F.col("center_sample").cast("double")) / window)),
        [*scope, "_b", "sync_type"],
        ["seq"],
    ).drop("_b")


def frame_payloads(df: DataFrame, frame: list[str], order: str = "half_index") -> DataFrame:
    """Identical half payloads of one frame are reported once."""
    return first_rows(df, [*frame, "payload_hex"], [order])


def chain_merge(df: DataFrame, scope: list[str], window: float) -> DataFrame:
    """Walk candidates by position and keep the better of two that lie closer than
    ``window`` to the last kept one (fewer errors, then residual, then higher correlation).

    Two candidates at least ``window`` apart from the one before start a new chain whatever
    happened earlier, so the walk is split there and runs per chain.
    """
    ordered = scan(df, scope, ["fs_start", "seq"], [before("_prev", "max", F.col("fs_start"))])
    starts = F.col("_prev").isNull() | (F.col("fs_start") - F.col("_prev") >= window)
    ordered = settle(ordered.select(*scope, "fs_start", "seq", "errors", "resid", "ncc", starts.alias("_starts")))
    chained = scan(
        ordered, scope, ["fs_start", "seq"], [upto("_chain", "max", F.when(F.col("_starts"), F.col("fs_start")))]
    )
    item = F.struct(
        F.col("fs_start").alias("p"), F.col("errors").alias("e"), F.col("resid").alias("r"),
        (-F.col("ncc")).alias("n"), F.col("seq").alias("s"),
    )

    def step(acc, x):
        last = F.element_at(acc, -1)
        near = F.abs(x["p"] - last["p"]) < window
        better = F.struct(x["e"], x["r"], x["n"]) < F.struct(last["e"], last["r"], last["n"])
        replaced = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        return (
            F.when(F.size(acc) == 0, F.array(x))
            .when(near & better, replaced)
            .when(near, acc)
            .otherwise(F.concat(acc, F.array(x)))
        )

    kept = (
        chained.groupBy(*scope, "_chain")
        # candidate order inside one position: errors, residual, correlation
        .agg(F.sort_array(F.collect_list(item)).alias("_c"))
        .select(*scope, F.explode(F.aggregate("_c", F.slice("_c", 1, 0), step)).alias("_k"))
        .select(*scope, F.col("_k.s").alias("seq"))
    )
    return df.join(kept, [*scope, "seq"], "left_semi")


def merge_detections(df: DataFrame, scope: list[str], tolerance_hz: float = 2500.0, width: float = 50000.0) -> DataFrame:
    """Cluster detections whose neighbours lie within ``tolerance_hz``; the strongest one
    represents the cluster at the power-weighted mean frequency."""
    f = "frequency_offset_hz"
    gaps = scan(df, scope, [f, "seq"], [before("_prev", "max", F.col(f))], width)
    starts = F.col("_prev").isNull() | (F.col(f) - F.col("_prev") > tolerance_hz)
    gaps = settle(gaps.withColumn("_starts", starts))
    clustered = settle(scan(gaps, scope, [f, "seq"], [upto("_cluster", "max", F.when(F.col("_starts"), F.col(f)))], width))
    rest = [c for c in df.columns if c not in scope]
    # weights are relative to the cluster peak; dB offsets cancel in the ratio
    top = clustered.groupBy(*scope, "_cluster").agg(
        F.max("snr_db").alias("_top"),
        F.max_by(F.struct(*rest), F.struct(F.col("snr_db"), -F.col(f), -F.col("seq"))).alias("_best"),
    )
    w = F.pow(F.lit(10.0), (F.col("snr_db") - F.col("_top")) / 10)
    merged = (
        clustered.select(*scope, "_cluster", f, "snr_db")
        .join(top, [*scope, "_cluster"])
        .groupBy(*scope, "_cluster")
        .agg(
            (F.sum(F.col(f) * w) / F.sum(w)).alias("_f"),
            F.count(F.lit(1)).alias("member_count"),
            F.first("_best").alias("_best"),
        )
    )
    best = F.col("_best")
    out = merged.select(*scope, "_f", "member_count", *[best[c].alias(c) for c in rest])
    shift = F.col("_f") - F.col(f)
    cols = {"center_frequency_hz": F.col("center_frequency_hz") + shift, f: F.col("_f")}
    if "coarse_center_offset_hz" in rest:
        cols["residual_offset_hz"] = F.col("_f") - F.col("coarse_center_offset_hz")
    return out.withColumns(cols).drop("_f")


def best_per_slot(df: DataFrame, scope: list[str]) -> DataFrame:
    """One confirmed burst per slot start: lowest error share, then fewest errors."""
    return first_rows(
        df.where("is_confirmed"), [*scope, "slot_start_bit"], ["error_fraction", "total_errors", "seq"]
    )


def first_epochs(df: DataFrame, order: str = "seq") -> DataFrame:
    """First report of each closed epoch."""
    return first_rows(df, ["channel_id", "epoch_id"], [order])
