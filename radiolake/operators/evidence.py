"""Protocol evidence, races between probes, parameter sweeps and decoder health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.fields import field, has_path
from radiolake.functions.ordered import WIDTH, before, scan, settle, upto
from radiolake.functions.stats import grouped_quantiles
from radiolake.registry import PROTOCOLS, canonical_name, literal_map, rank


def probe_evidence(pdus: DataFrame, by: list[str], diagnostics: DataFrame | None = None) -> DataFrame:
    """Verdict per (by, protocol) from decoded rows and optional diagnostics
    (valid_channel_blocks, lich_ok_count, training_good_count)."""
    typ = F.col("type")
    flag = lambda p: field(pdus, p, "boolean", False)
    rs = typ.isin("LC_HEADER", "TERMINATOR") & flag("extra.fec.rs_12_9_4_ok")
    late = (typ == "LATE_ENTRY") & flag("extra.cs5_ok")
    weak = ~rs & ~late & ((typ == "CSBK") | typ.startswith("DMR_"))
    if has_path(pdus.schema, "extra.cch"):
        count = lambda f: F.coalesce(F.size(F.filter("extra.cch", lambda r: F.coalesce(r[f], F.lit(False)))), F.lit(0))
        crc, hamming = count("crc_ok"), count("hamming_ok")
    else:
        crc = hamming = F.lit(0)
    counts = pdus.groupBy(*by, canonical_name(F.col("protocol")).alias("protocol")).agg(
        F.count(F.lit(1)).alias("pdu_count"),
        F.count_if(rs).alias("rs_count"),
        F.count_if(late).alias("late_count"),
        F.count_if(weak).alias("weak_count"),
        F.count_if(flag("extra.valid_bch")).alias("bch_count"),
        F.sum(crc).alias("crc_count"),
        F.sum(hamming).alias("hamming_count"),
        F.count_if(typ.isin("TETRA_DMAC_SYNC", "TETRA_STCH", "TETRA_SCHF")).alias("control_count"),
    )
    extra = ["valid_channel_blocks", "lich_ok_count", "training_good_count"]
    if diagnostics is not None:
        counts = counts.join(diagnostics.select(*by, "protocol", *extra), [*by, "protocol"], "full")
    else:
        counts = counts.withColumns({c: F.lit(0) for c in extra})
    counts = counts.fillna(0, [c for c in counts.columns if c not in (*by, "protocol")])
    c = F.col
    p = c("protocol")

    def verdict(cond: Column, status: str, confidence: float, kind, reason: str) -> tuple:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return cond, F.struct(
            F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), kind.alias("evidence_class"),
            F.lit(reason).alias("reason"),
        )

    rules = [
        verdict(
            (p == "DMR") & (c("rs_count") + c("late_count") > 0), "confirmed", 0.99,
            F.when(c("rs_count") > 0, "rs_valid_full_link_control").otherwise("cs5_valid_late_entry_lc"), "",
        ),
        verdict((p == "DMR") & (c("weak_count") > 0), "candidate", 0.45, "sync_or_csbk_only", "dmr_sync_without_strong_lc_validation"),
        verdict((p == "P25") & (c("bch_count") > 0), "confirmed", 0.99, "bch_valid_nid", ""),
        verdict((p == "dPMR") & (c("crc_count") > 0), "confirmed", 0.99, "crc_valid_cch", ""),
        verdict((p == "dPMR") & (c("hamming_count") >= 2), "confirmed", 0.90, "repeated_hamming_valid_cch", ""),
        verdict((p == "dPMR") & (c("hamming_count") == 1), "candidate", 0.60, "single_hamming_valid_cch", "dpmr_weak_cch_requires_repeat"),
        verdict((p == "NXDN") & (c("valid_channel_blocks") > 0) & (c("lich_ok_count") > 0), "confirmed", 0.99, "crc_valid_channel_block", ""),
        verdict((p == "NXDN") & (c("lich_ok_count") > 0), "candidate", 0.50, "valid_lich_only", "nxdn_lich_without_crc_valid_channel_block"),
        verdict((p == "TETRA") & (c("control_count") > 0), "confirmed", 0.99, "fec_valid_dmo_control_block", ""),
        verdict((p == "TETRA") & (c("training_good_count") > 0), "candidate", 0.45, "training_sequence_only", "tetra_training_without_fec_valid_control_block"),
        verdict(F.lit(True), "no_evidence", 0.0, "", "no_strong_protocol_evidence"),
    ]
    choice = F.when(*rules[0])
    for rule in rules[1:-1]:
        choice = choice.when(*rule)
    out = counts.withColumn("_v", choice.otherwise(rules[-1][1]))
    names = ("status", "confidence", "evidence_class", "reason")
    return out.select(*counts.columns, *[F.col(f"_v.{n}").alias(n) for n in names])


# ------------------------------------------------------------ races


def resolve_race(results: DataFrame, by: list[str] = ("epoch_id", "generation")) -> DataFrame:
    """Outcome of the probes that ran for one epoch and generation."""
    by = list(by)
    n = F.count(F.lit(1))
    ok, bad, err = (F.count_if(F.col("status") == s) for s in ("confirmed", "rejected", "error"))
    entry = F.when(F.col("status") == "confirmed", F.struct(rank(F.col("protocol")), "seq", "protocol"))
    out = results.groupBy(*by).agg(
        n.alias("n"), ok.alias("ok"), bad.alias("bad"), err.alias("err"),
        F.sort_array(F.collect_list(entry)).alias("_c"),
    )
    c = F.col
    outcome = (
        F.when(c("ok") == 1, "confirmed")
        .when(c("ok") > 1, "ambiguous")
        .when(c("bad") == c("n"), "rejected_all")
        .when((c("err") > 0) & (c("err") + c("bad") == c("n")), "error")
        .otherwise("classifying")
    )
    names = F.transform("_c", lambda x: x["protocol"])
    return out.select(
        *by, outcome.alias("outcome"), names.alias("confirmed_protocols"),
        F.when(c("ok") == 1, F.get(names, F.lit(0))).alias("winner"),
    )


def split_stale(results: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, stale) results: current ones match the running epoch, generation, protocol."""
    key = ["epoch_id", "generation", "protocol"]
    keys = active.select(*key).distinct()
    return results.join(keys, key, "left_semi"), results.join(keys, key, "left_anti")


def early_confirm(
    results: DataFrame, by: list[str] = ("epoch_id", "generation"), order: str = "seq", least: float = 0.99
) -> DataFrame:
    """End a race at its first confirmation when that is strong enough; what would have
    come later is pending."""
    by = list(by)
    first = (
        results.where("status = 'confirmed'")
        .groupBy(*by)
        .agg(F.min(F.struct(F.col(order).alias("o"), F.col("confidence").alias("c"))).alias("_f"))
        .where(F.col("_f.c") + 2.220446049250313e-16 >= least)
        .select(*by, F.col("_f.o").alias("_end"))
    )
    rows = results.join(first, by, "left")
    late = F.col("_end").isNotNull() & (F.col(order) > F.col("_end"))
    return rows.withColumns(
        {
            "status": F.when(late, "pending").otherwise(F.col("status")),
            "reason": F.when(late, "not_evaluated_after_strong_winner").otherwise(""),
            "ended_early": F.col("_end").isNotNull(),
        }
    ).drop("_end")


def probe_windows(name: str, growth: float = 2.0) -> list[float]:
    """Window lengths a protocol is probed with."""
    p = PROTOCOLS[name]
    out = [p.probe_initial_sec]
    while out[-1] < p.probe_max_sec:
        longer = min(p.probe_max_sec, out[-1] * growth)
        if longer <= out[-1]:
            break
        out.append(longer)
    return out


def _by_protocol(value) -> Column:
    return literal_map({n: value(p) for n, p in PROTOCOLS.items()})


def probe_schedule(requests: DataFrame) -> DataFrame:
    """One row per request and window of its protocol, shortest first."""
    table = F.create_map(
        *[x for n in PROTOCOLS for x in (F.lit(n), F.array(*[F.lit(w) for w in probe_windows(n)]))]
    )
    return requests.select("*", F.posexplode(F.try_element_at(table, F.col("protocol"))).alias("attempt", "window_sec"))


def probe_status(trials: DataFrame) -> DataFrame:
    """Final status of each attempt and the window to try next.

    A probe that saw its longest window without confirming is rejected.  Needs status,
    protocol, window_samples and sample_rate_hz.
    """
    secs = F.col("window_samples") / F.col("sample_rate_hz")
    longest = F.try_element_at(_by_protocol(lambda p: p.probe_max_sec), F.col("protocol"))
    shortest = F.try_element_at(_by_protocol(lambda p: p.probe_initial_sec), F.col("protocol"))
    done = (secs + 1 / F.col("sample_rate_hz") >= longest) & (F.col("status") != "confirmed") & (F.col("status") != "error")
    status = F.when(done, "rejected").otherwise(F.col("status"))
    grows = status.isin("no_evidence", "candidate", "error")
    return trials.withColumns(
        {
            "final_status": status,
            "final_reason": F.when(done, "max_probe_window_without_strong_confirmation").otherwise(""),
            "next_window_sec": F.when(grows, F.least(longest, F.greatest(shortest, secs * 2.0))),
        }
    )


def probe_ready(states: DataFrame) -> DataFrame:
    """Whether a probe may run: not decided yet, window filled, new samples since last time."""
    rate = F.col("sample_rate_hz")
    reason = (
        F.when(F.col("status").isin("confirmed", "rejected"), "terminal_probe_state")
        .when(F.col("available_samples") / rate + 1 / rate < F.col("next_window_sec"), "awaiting_probe_window")
        .when(F.col("end_sample") <= F.col("last_attempted_end"), "awaiting_new_samples")
        .otherwise("")
    )
    return states.withColumns({"wait_reason": reason, "ready": reason == ""})


# ------------------------------------------------------------ sweeps


def sweep_trials(
    recordings: DataFrame, outcomes: DataFrame, offsets: list[float], snrs: list[float], shifts: list[float],
    windows: list[float], seeds: list[int] = (1,), stop_after_first: bool = True,
) -> DataFrame:
    """Trials of a parameter sweep, in window order up to the first confirmation.

    ``recordings`` has recording_id, sample_count, sample_rate_hz; ``outcomes`` the result of
    each trial that ran (the sweep columns, status, elapsed_sec, evidence_class).  Windows
    longer than the recording are kept as unavailable.
    """

    def axis(name: str, values) -> tuple[str, Column]:
        return name, F.array(*[F.lit(v) for v in values])

    grid = recordings
    for name, values in (axis("offset_sec", offsets), axis("snr_db", snrs), axis("seed", seeds), axis("shift_hz", shifts)):
        grid = grid.withColumn(name, F.explode(values))
    start = F.floor(F.col("offset_sec") * F.col("sample_rate_hz"))
    grid = grid.where(start < F.col("sample_count"))
    grid = grid.select("*", F.posexplode(axis("w", windows)[1]).alias("attempt", "window_sec"))
    left = F.least(F.col("sample_count") - start, F.ceil(max(windows) * F.col("sample_rate_hz")))
    enough = F.ceil(F.col("window_sec") * F.col("sample_rate_hz")) <= left
    key = ["recording_id", "offset_sec", "snr_db", "seed", "shift_hz", "window_sec"]
    rows = grid.withColumn("_enough", enough).join(outcomes, key, "left")
    status = F.when(~F.col("_enough"), "unavailable").otherwise(F.coalesce("status", F.lit("no_evidence")))
    rows = rows.withColumns(
        {
            "status": status,
            "confirmed": status == "confirmed",
            "reason": F.when(~F.col("_enough"), "input_shorter_than_requested_window").otherwise(""),
            "elapsed_sec": F.when(F.col("_enough"), F.coalesce("elapsed_sec", F.lit(0.0))).otherwise(0.0),
        }
    ).drop("_enough")
    if not stop_after_first:
        return rows
    # a condition has as many rows as there are windows
    earlier = Window.partitionBy(*key[:-1]).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_hit", F.coalesce(F.max("confirmed").over(earlier), F.lit(False))).where("NOT _hit").drop("_hit")


CONDITION = ["recording_id", "offset_sec", "snr_db", "seed", "shift_hz"]


def sweep_conditions(trials: DataFrame, by: list[str] = CONDITION) -> DataFrame:
    """Per condition: shortest confirming window, attempts, time spent."""
    ok = F.col("confirmed")
    return trials.groupBy(*by).agg(
        F.max(ok).alias("confirmed"),
        F.min(F.when(ok, F.col("window_sec"))).alias("minimum_sec"),
        F.min_by("evidence_class", F.when(ok, F.col("attempt"))).alias("evidence_class"),
        F.count(F.lit(1)).alias("attempt_count"),
        F.sum("elapsed_sec").alias("elapsed_sec"),
    )


def sweep_summary(conditions: DataFrame, by: list[str] = ("snr_db", "shift_hz"), cell: float = 0.05) -> DataFrame:
    """Success ratio and time-to-confirm percentiles per sweep point."""
    by = list(by)
    counts = conditions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("condition_count"),
        F.count_if("confirmed").alias("confirmed_count"),
        F.max(F.when(F.col("confirmed"), F.col("minimum_sec"))).alias("max_sec"),
    )
    q = grouped_quantiles(
        conditions.where("confirmed"), by, "minimum_sec",
        {"p50_sec": ("linear", 0.50), "p95_sec": ("linear", 0.95), "p99_sec": ("linear", 0.99)}, cell,
    )
    ratio = F.col("confirmed_count") / F.greatest(F.lit(1), F.col("condition_count"))
    return counts.join(q, by, "left").withColumn("success_ratio", ratio)


# ------------------------------------------------------------ epochs and decoder health


def epoch_rollup(eps: DataFrame, by: list[str]) -> DataFrame:
    """Outcome of a recording from its epochs (outcome, protocol, execution_mode, seq)."""
    by = list(by)
    n, ok = F.count(F.lit(1)).alias("epoch_count"), F.count_if(F.col("outcome") == "confirmed").alias("confirmed_count")
    seen = {s: F.count_if(F.col("outcome") == s).alias(f"_{s}") for s in ("ambiguous", "timeout", "error")}
    base = eps.groupBy(*by).agg(n, ok, *seen.values())

    def distinct_in_order(col: str, out: str) -> DataFrame:
        per = eps.where(F.length(col) > 0).groupBy(*by, col).agg(F.min("seq").alias("_f"))
        return per.groupBy(*by).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_f", col))), lambda x: x[col]).alias(out)
        )

    outcome = (
        F.when(F.col("confirmed_count") == F.col("epoch_count"), "confirmed")
        .when(F.col("confirmed_count") > 0, "partial")
        .when(F.col("_ambiguous") > 0, "ambiguous")
        .when(F.col("_timeout") > 0, "timeout")
        .when(F.col("_error") > 0, "error")
        .otherwise("unclassified")
    )
    out = base.join(distinct_in_order("protocol", "protocols"), by, "left")
    out = out.join(distinct_in_order("execution_mode", "_modes"), by, "left")
    none = F.array().cast("array<string>")
    modes = F.coalesce("_modes", none)
    return out.select(
        *by, "epoch_count", "confirmed_count", outcome.alias("outcome"),
        F.coalesce("protocols", none).alias("protocols"),
        F.when(F.size("protocols") == 1, F.get("protocols", F.lit(0))).otherwise("").alias("selected_protocol"),
        F.when(F.size(modes) == 0, "").when(F.size(modes) == 1, F.get(modes, F.lit(0))).otherwise("mixed").alias("execution_mode"),
    )


def decoder_health(
    verdicts: DataFrame, scope: list[str], suspect: int = 3, lost: int = 6, width: float = WIDTH
) -> DataFrame:
    """Health of a locked decoder after each window: misses since the last confirmation
    make it suspect, then lost."""
    scope = list(scope)
    miss = F.col("verdict") != "confirmed"
    rows = settle(scan(verdicts, scope, "seq", [upto("_m", "sum", miss.cast("bigint"))], width))
    rows = scan(rows, scope, "seq", [upto("_base", "max", F.when(F.col("verdict") == "confirmed", F.col("_m")))], width)
    misses = F.col("_m") - F.coalesce("_base", F.lit(0))
    health = (
        F.when(F.col("verdict") == "confirmed", "healthy")
        .when(F.col("verdict") == "error", "error")
        .when(misses >= lost, "lost")
        .when(misses >= suspect, "suspect")
        .otherwise("no_evidence")
    )
    return rows.withColumns({"misses": misses, "health": health}).drop("_m", "_base")


def health_events(health: DataFrame, scope: list[str], width: float = WIDTH) -> DataFrame:
    """Suspect, recovered and lost events; a lost decoder is released and says no more."""
    scope = list(scope)
    seq = F.col("seq")
    gone = F.col("health").isin("lost", "error")
    rows = scan(
        settle(health), scope, "seq",
        [
            before("_bad", "max", F.when(F.col("health") == "suspect", seq)),
            before("_good", "max", F.when(F.col("health") == "healthy", seq)),
            before("_gone", "max", F.when(gone, seq)),
        ],
        width,
    )
    pending = F.coalesce((F.col("_bad") > F.col("_good")) | (F.col("_bad").isNotNull() & F.col("_good").isNull()), F.lit(False))
    state = F.when(pending, "LOSS_PENDING").otherwise("LOCKED")
    event = (
        F.when(gone, "DECODER_LOST")
        .when((F.col("health") == "healthy") & pending, "DECODER_RECOVERED")
        .when((F.col("health") == "suspect") & ~pending, "DECODER_SUSPECT")
    )
    to_state = F.when(gone, "RECLASSIFYING").when(F.col("health") == "healthy", "LOCKED").otherwise("LOSS_PENDING")
    return rows.where(F.col("_gone").isNull() & event.isNotNull()).select(
        *scope, "seq", event.alias("event"), state.alias("from_state"), to_state.alias("to_state")
    )


def protocol_rollover(winners: DataFrame, scope: list[str], width: float = WIDTH) -> DataFrame:
    """Epochs as the winning protocol changes.

    A change closes the epoch at the last strong sample (never before the epoch began) and
    leaves the stretch up to the decision ambiguous; the same winner just goes on.
    ``winners`` has seq, sample, protocol, last_strong_sample.
    """
    scope = list(scope)
    rows = scan(winners, scope, "seq", [before("_old", "last", F.col("protocol"))], width)
    switch = F.coalesce(F.col("_old") != F.col("protocol"), F.lit(False))
    edge = F.when(F.col("last_strong_sample") > 0, F.col("last_strong_sample")).otherwise(F.col("sample"))
    first = F.col("_old").isNull()
    rows = settle(
        rows.withColumns({"is_switch": switch, "_edge": F.when(switch, edge).when(first, F.col("start_sample"))})
    )
    rows = scan(
        rows, scope, "seq",
        [
            upto("boundary", "max", F.col("_edge")),
            upto("epoch_id", "sum", (F.col("is_switch") | F.col("_old").isNull()).cast("bigint")),
        ],
        width,
    )
    return rows.withColumn("previous_protocol", F.col("_old")).drop("_edge", "_old")


def catchup_range(eps: DataFrame, pre_trigger_sec: float = 0.5) -> DataFrame:
    """What a winner can still decode: from the pre-trigger, as far back as samples are kept.

    Needs candidate_start, retained_start, retained_end, end_sample, sample_rate_hz.
    """
    pre = F.round(F.lit(pre_trigger_sec) * F.col("sample_rate_hz")).cast("bigint")
    wanted = F.greatest(F.lit(0).cast("bigint"), F.col("candidate_start") - pre)
    start = F.greatest("retained_start", wanted)
    end = F.col("end_sample")
    error = F.when((end > F.col("retained_end")) | (end < F.col("retained_start")), "end outside retained range").when(
        start >= end, "nothing retained"
    )
    return eps.withColumns(
        {
            "desired_start": wanted,
            "catchup_start": start,
            "truncated": start > wanted,
            "samples": end - start,
            "at_live_edge": end == F.col("retained_end"),
            "error": error,
        }
    )


def best_variant(variants: DataFrame, by: list[str], order: str) -> DataFrame:
    """Highest scoring decision variant; the first one wins a tie."""
    score = F.col("score") + 1000 * F.col("good_count") + 100 * F.col("candidate_count")
    fields = [c for c in variants.columns if c not in by]
    best = variants.groupBy(*by).agg(
        F.max_by(F.struct(*fields), F.struct(score.alias("s"), (-F.col(order)).alias("o"))).alias("_b")
    )
    return best.select(*by, "_b.*")


def frame_quality(frames: DataFrame) -> DataFrame:
    """Usability and confidence of dPMR frames from ``cch`` records, ``color_code`` and the
    symbol residual ``resid``."""
    rec = F.coalesce("cch", F.slice("cch", 1, 0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    count = lambda f: F.coalesce(F.size(F.filter(rec, lambda r: yes(r[f]))), F.lit(0))
    crc, hamming = count("crc_ok"), count("hamming_ok")
    usable = F.filter(rec, lambda r: yes(r["crc_ok"]) | yes(r["hamming_ok"]))
    numbers = F.transform(usable, lambda r: r["frame_number"].cast("int"))
    has = lambda a, b: F.array_contains(numbers, a) & F.array_contains(numbers, b)
    pair = yes(has(0, 1) | has(2, 3))
    known = F.coalesce(F.col("color_code") >= 0, F.lit(False))
    return frames.withColumns(
        {
            "crc_ok_count": crc,
            "hamming_ok_count": hamming,
            "valid_frame_pair": pair,
            "usable": known & (F.size(usable) > 0),
            "confidence": F.when(crc > 0, "high").when(pair, "medium").when(hamming > 0, "low").otherwise("none"),
            "header_score": 8.0 * crc + 2.0 * hamming + F.when(known, 2.0).otherwise(0.0)
            + F.when(pair, 3.0).otherwise(0.0) - 0.2 * F.col("resid"),
        }
    )
