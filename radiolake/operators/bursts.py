"""Slot and burst tables over bit strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.bits import bits_to_dibits
from radiolake.functions.ordered import dense_index, settle
from radiolake.operators.conform import time_of_bit
from radiolake.operators.spectrum import TRAINING
from radiolake.registry import literal_map
from radiolake.session import spread

SLOT_BITS = 510
MIN_VALID_RATIO = 0.70

# What a training sequence says about its burst
BURST_CLASS = {"normal_1": "DNB", "normal_2": "DNB", "normal_3": "DNB", "extended": "extended", "sync": "DSB"}

# Field positions (1-based) and patterns of the three direct-mode bursts
PREAMBLE_START, TAIL_START, TAIL_BITS, FREQUENCY_START = 35, 503, "00", 49
FREQUENCY_BITS = "1" * 8 + "0" * 64 + "1" * 8
BURSTS = (
    # name, type, training, preamble, training start, has frequency field,
    # first block (start, end, channel), second block
    ("DSB_sync", "DSB", "sync", "000101000111", 249, True, (129, 248, "SCH/S"), (287, 502, "SCH/H")),
    ("DNB_normal_1", "DNB", "normal_1", "001100100011", 265, False, (49, 264, "TCH or SCH/F"), (287, 502, "TCH or SCH/F")),
    ("DNB_normal_2", "DNB", "normal_2", "100110101001", 265, False, (49, 264, "STCH"), (287, 502, "TCH or STCH")),
)
MAX_PREAMBLE_ERRORS, MAX_TAIL_ERRORS = 2, 1
MAX_TRAINING_FRACTION, MAX_FREQUENCY_FRACTION, MAX_TOTAL_FRACTION = 0.18, 0.10, 0.18


def _layout_start(name: Column) -> Column:
    """First bit of the centred training sequence in its slot."""
    return F.try_element_at(literal_map({n: (SLOT_BITS - len(s)) // 2 + 1 for n, s in TRAINING.items()}), name)


def slot_candidates(hits: DataFrame, bits: str = "bits") -> DataFrame:
    """Slots implied by training hits (name, length, bit_offset, errors, error_fraction,
    is_good and the bit string they were found in)."""
    layout = _layout_start(F.col("name")).cast("bigint")
    start = F.col("bit_offset") - layout + 1
    end = start + SLOT_BITS - 1
    complete = (start >= 1) & (end <= F.length(bits))
    text = F.when(complete, F.substring(F.col(bits), start.cast("int"), F.lit(SLOT_BITS))).otherwise("")
    rows = hits.where(layout.isNotNull()).withColumns(
        {
            "burst_class": F.try_element_at(literal_map(BURST_CLASS), F.col("name")),
            "slot_start_bit": start,
            "slot_end_bit": end,
            "is_complete": complete,
            "symbol_aligned": F.pmod(start, F.lit(2)) == 1,
            "training_start_in_slot": layout,
            "bit_string": text,
        }
    )
    return rows.withColumn("dibit_string", bits_to_dibits(F.col("bit_string")))


def limit_slots(slots: DataFrame, scope: list[str], limit: int | None = None, per_training: int | None = None) -> DataFrame:
    """Best slots of each scope: at most ``per_training`` of one sequence, ``limit`` in all; all
    of them where both are None.

    The first limit never depends on the second, so both are plain ranks.  ``n_dropped``, where
    a limit is given, is the number of slots of the scope that it leaves out.  The slots are
    written once, with the columns they come with, since they are counted and ranked."""
    if limit is None and per_training is None:
        return slots
    slots = settle(slots)
    order = [
        F.col("is_complete").desc(), F.col("is_good").desc(), "error_fraction", "errors", "slot_start_bit", "bit_offset", "name",
    ]
    totals = slots.groupBy(*scope).agg(F.count(F.lit(1)).alias("_total"))
    for keys, most in (([*scope, "name"], per_training), (scope, limit)):
        if most is not None:
            w = Window.partitionBy(*keys).orderBy(*order)
            slots = slots.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    kept = slots.groupBy(*scope).agg(F.count(F.lit(1)).alias("_kept"))
    dropped = totals.join(kept, list(scope)).select(*scope, (F.col("_total") - F.col("_kept")).alias("n_dropped"))
    return slots.join(dropped, list(scope))


def _differences(bits: Column, start: int, pattern: str) -> Column:
    """Bits of ``pattern`` that differ from the text at ``start``."""
    total = None
    for at in range(0, len(pattern), 40):  # parts that fit an integer
        part = pattern[at : at + 40]
        word = F.conv(F.substring(bits, start + at, len(part)), 2, 10).cast("bigint")
        n = F.bit_count(word.bitwiseXOR(F.lit(int(part, 2)).cast("bigint")))
        total = n if total is None else total + n
    return total.cast("bigint")


def _most(length: int, fraction: float) -> int:
    return int(length * fraction + 1e-9)


def _field_errors(bits: Column) -> dict[str, Column]:
    """Differing bits of every field of every burst definition."""
    out = {}
    for k, (_, _, training, preamble, t0, has_freq, _, _) in enumerate(BURSTS):
        out[f"_pre{k}"] = _differences(bits, PREAMBLE_START, preamble)
        out[f"_trn{k}"] = _differences(bits, t0, TRAINING[training])
        if has_freq:
            out[f"_freq{k}"] = _differences(bits, FREQUENCY_START, FREQUENCY_BITS)
    out["_tail"] = _differences(bits, TAIL_START, TAIL_BITS)
    return out


def _best_definition() -> Column:
    """Best matching burst definition from the field errors: confirmed first, then the
    smaller share of errors, fewer errors, earlier definition."""

    def one(k: int, d: tuple) -> Column:
        name, kind, training, preamble, _, has_freq, b1, b2 = d
        word = TRAINING[training]
        pre, trn, tail = F.col(f"_pre{k}"), F.col(f"_trn{k}"), F.col("_tail")
        freq = F.col(f"_freq{k}") if has_freq else F.lit(0).cast("bigint")
        checked = len(preamble) + len(word) + len(TAIL_BITS) + (len(FREQUENCY_BITS) if has_freq else 0)
        total = pre + trn + tail + freq
        ok = (
            (trn <= _most(len(word), MAX_TRAINING_FRACTION))
            & (pre <= MAX_PREAMBLE_ERRORS)
            & (tail <= MAX_TAIL_ERRORS)
            & (total <= _most(checked, MAX_TOTAL_FRACTION))
        )
        if has_freq:
            ok = ok & (freq <= _most(len(FREQUENCY_BITS), MAX_FREQUENCY_FRACTION))
        share = total / checked
        return F.struct(
            (~ok).alias("rank_confirmed"), share.alias("error_fraction"), total.alias("total_errors"), F.lit(k).alias("k_definition"),
            F.lit(name).alias("burst_name"), F.lit(kind).alias("burst_type"), F.lit(training).alias("training_name"),
            ok.alias("is_confirmed"), F.greatest(F.lit(0.0), 1 - share).alias("confidence"),
            pre.alias("preamble_errors"), trn.alias("training_errors"), freq.alias("frequency_errors"), tail.alias("tail_errors"),
            F.lit(b1[0]).alias("bkn1_start"), F.lit(b1[1]).alias("bkn1_end"), F.lit(b1[2]).alias("bkn1_channel"),
            F.lit(b2[0]).alias("bkn2_start"), F.lit(b2[1]).alias("bkn2_end"), F.lit(b2[2]).alias("bkn2_channel"),
        )

    return F.array_min(F.array(*[one(k, d) for k, d in enumerate(BURSTS)]))


def classify_slots(slots: DataFrame, bits: str = "bit_string") -> DataFrame:
    """Classify complete slots.

    Comparing bits is the costly step and its result is filtered and ranked in several
    ways afterwards, so it is written once.
    """
    names = [
        "burst_name", "burst_type", "training_name", "is_confirmed", "confidence", "error_fraction", "total_errors",
        "preamble_errors", "training_errors", "frequency_errors", "tail_errors", "bkn1_start", "bkn1_end", "bkn1_channel",
        "bkn2_start", "bkn2_end", "bkn2_channel",
    ]
    rows = slots.where(F.length(bits) == SLOT_BITS).drop(*[n for n in names if n in slots.columns])
    rows = spread(rows, bits)
    errors = _field_errors(F.col(bits))
    rows = rows.withColumns(errors).select("*", F.inline(F.array(_best_definition())))
    return settle(rows.drop("rank_confirmed", "k_definition", *errors))


def limit_bursts(bursts: DataFrame, scope: list[str], limit: int | None = None) -> DataFrame:
    """All confirmed candidates of a scope, and the best rejected ones up to ``limit`` in all (all
    of them where it is None).  ``n_dropped``, where a limit is given, counts the ones left out."""
    if limit is None:
        return bursts
    w = Window.partitionBy(*scope).orderBy("error_fraction", "total_errors", "slot_start_bit", "seq")
    rejected = bursts.where("NOT is_confirmed").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    n = bursts.groupBy(*scope).agg(
        F.count_if("is_confirmed").alias("_n"), F.count_if(~F.col("is_confirmed")).alias("_rejected")
    )
    left = F.greatest(F.lit(limit) - F.col("_n"), F.lit(0))
    n = n.select(*scope, left.alias("_room"), F.greatest(F.col("_rejected") - left, F.lit(0)).alias("n_dropped"))
    confirmed = bursts.where("is_confirmed").withColumn("_rn", F.lit(0))
    both = confirmed.unionByName(rejected).join(n, list(scope))
    return both.where(F.col("_rn") <= F.col("_room")).drop("_rn", "_room")


def _valid(mask: Column) -> Column:
    return F.length(F.replace(mask, F.lit("0"), F.lit(""))).cast("bigint")


def payload_blocks(bursts: DataFrame) -> DataFrame:
    """The two payload blocks of each confirmed burst, with their share of valid bits
    (``valid_mask`` is a 0/1 text; a burst without one counts as valid throughout)."""
    mask = F.coalesce("valid_mask", F.lit("1" * SLOT_BITS))

    def block(i: int) -> Column:
        s, e = F.col(f"bkn{i}_start"), F.col(f"bkn{i}_end")
        n = (e - s + 1).cast("bigint")
        good = _valid(F.substring(mask, s, e - s + 1))
        return F.struct(
            F.lit(i).alias("block_index"), F.lit(f"BKN{i}").alias("block_name"), F.col(f"bkn{i}_channel").alias("channel_hint"),
            s.alias("start_in_slot"), e.alias("end_in_slot"),
            (F.col("slot_start_bit") + s - 1).alias("absolute_start_bit"), (F.col("slot_start_bit") + e - 1).alias("absolute_end_bit"),
            n.alias("length"), good.alias("valid_bits"), (n - good).alias("invalid_bits"), (good / n).alias("valid_ratio"),
            (good == n).alias("all_valid"), F.substring(F.col("bit_string"), s, e - s + 1).alias("block_bits"),
        )

    rows = bursts.where("is_confirmed").withColumn("_b", F.explode(F.array(block(1), block(2))))
    return rows.select(*[c for c in bursts.columns if not c.startswith("bkn")], "_b.*")


def route_blocks(bursts: DataFrame) -> DataFrame:
    """Logical channel, attempt and status of the blocks of normal bursts.

    Each row is a confirmed DNB burst with ``blocks`` (the two payload blocks),
    ``context_valid``, and what the channel decoder reported: ``stch1_ok``,
    ``second_half_stolen``, ``stch2_ok``, ``schf_ok``.
    """
    b1, b2 = F.col("blocks")[0], F.col("blocks")[1]

    def part(channel: str, name: Column, index, start, end, valid, length, decoded, reason=None) -> Column:
        ratio = F.coalesce(valid / length, F.lit(1.0))
        usable = ratio >= MIN_VALID_RATIO
        attempted = F.lit(False) if reason else usable & F.col("context_valid")
        ok = attempted & F.coalesce(decoded, F.lit(False))
        status = F.lit(reason) if reason else (
            F.when(~usable, F.format_string("skipped: low burst-valid ratio %.3f", ratio))
            .when(~F.col("context_valid"), "skipped: no DCC context")
            .when(ok, "decoded")
            .otherwise("channel decode failed")
        )
        return F.struct(
            F.lit(channel).alias("logical_channel"), name.alias("block_name"), index.cast("int").alias("block_index"),
            start.alias("absolute_start_bit"), end.alias("absolute_end_bit"), valid.alias("valid_bits"),
            length.alias("length"), ratio.alias("valid_ratio"), attempted.alias("attempted"), ok.alias("decode_ok"), status.alias("status"),
        )

    def single(b: Column, channel: str, decoded: Column, reason=None) -> Column:
        return part(
            channel, b["block_name"], b["block_index"], b["absolute_start_bit"], b["absolute_end_bit"], b["valid_bits"], b["length"],
            decoded, reason,
        )

    first = single(b1, "STCH", F.col("stch1_ok"))
    stolen = first["decode_ok"] & F.coalesce("second_half_stolen", F.lit(False))
    kept = "BKN2 kept as TCH candidate; first-half STCH did not steal second half"
    second = F.when(stolen, single(b2, "STCH", F.col("stch2_ok"))).otherwise(single(b2, "TCH", F.lit(False), kept))
    whole = part(
        "SCH/F", F.lit("BKN1+BKN2"), F.lit(12), b1["absolute_start_bit"], b2["absolute_end_bit"], b1["valid_bits"] + b2["valid_bits"],
        b1["length"] + b2["length"], F.col("schf_ok"),
    )
    routed = F.when(F.col("training_name") == "normal_2", F.array(first, second)).when(
        F.col("training_name") == "normal_1", F.array(whole)
    )
    rows = bursts.where("burst_type = 'DNB'").withColumn("_r", F.explode(routed))
    return rows.select(*[c for c in bursts.columns if c != "blocks"], "_r.*")


def burst_events(syncs: DataFrame, blocks: DataFrame, symbol_rate: float = 18000.0) -> DataFrame:
    """PDU rows of sync bursts and routed blocks.

    A decoded block is a signalling PDU; an undecoded SCH/F or a TCH block is a traffic
    candidate.  Addresses the PDU lacks come from the sync context.
    """
    zero = F.lit(0).cast("bigint")

    def base(df: DataFrame, typ: Column, src: Column, dst: Column, flco: Column, channel: Column, block: Column, keep: Column) -> DataFrame:
        return df.where(keep).select(
            "channel_id", "seq", F.lit("TETRA").alias("protocol"), typ.alias("type"), src.alias("src_num"), dst.alias("dst_num"),
            flco.alias("flco"), channel.alias("logical_channel"), block.alias("block_name"), "frame_number", "slot_number",
            "slot_start_bit", time_of_bit(F.col("slot_start_bit"), F.col("active_start_sec"), symbol_rate).alias("start_time_s"),
            time_of_bit(F.col("slot_start_bit") + SLOT_BITS - 1, F.col("active_start_sec"), symbol_rate).alias("end_time_s"),
        )

    none = F.lit(None).cast("string")
    sync = base(
        syncs, F.lit("TETRA_DMAC_SYNC"), F.coalesce("src", zero), F.coalesce("dst", zero), F.col("message"), F.lit("SCH/S"), none,
        F.col("dmac_sync_ok"),
    )
    ok = F.col("decode_ok")
    src = F.when(ok, F.coalesce("src", "context_src", zero)).otherwise(F.coalesce("context_src", zero))
    dst = F.when(ok, F.coalesce("dst", "context_dst", zero)).otherwise(F.coalesce("context_dst", zero))
    typ = F.when(~ok, "TETRA_TCH_CANDIDATE").when(F.col("logical_channel") == "SCH/F", "TETRA_SCHF").otherwise("TETRA_STCH")
    channel = F.when(ok, F.col("logical_channel")).otherwise("TCH")
    flco = F.when(~ok, "TCH").when(F.col("null_pdu"), "NULL").otherwise(F.col("message"))
    mac = base(
        blocks, typ, src, dst, flco, channel, F.col("block_name"), ok | F.col("logical_channel").isin("SCH/F", "TCH")
    )
    return sync.unionByName(mac)


def burst_report(bursts: DataFrame, scope: list[str]) -> DataFrame:
    """Counts over the bursts of a scope."""
    on = lambda c: F.count_if(F.col(c))
    kind = F.col("burst_type")
    return bursts.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        on("is_complete").alias("complete_count"),
        on("is_confirmed").alias("confirmed_count"),
        F.count_if(F.col("is_confirmed") & (kind == "DSB")).alias("dsb_count"),
        F.count_if(F.col("is_confirmed") & (kind == "DNB")).alias("dnb_count"),
        on("dmac_sync_ok").alias("dmac_sync_count"),
        F.sum("stch_count").alias("stch_count"),
        on("schf_ok").alias("schf_count"),
        F.count_if(F.col("frame_number").isNotNull() & F.col("slot_number").isNotNull()).alias("timing_count"),
    )


def order_events(events: DataFrame, scope: list[str], width_sec: float = 3600.0) -> DataFrame:
    """Add the reporting order: sessions by end time, events by start time, then as they
    came; rows without a time go last."""
    t = F.when(F.col("type") == "TETRA_SESSION", F.col("end_time_s")).otherwise(F.col("start_time_s"))
    rows = events.withColumn("sort_time", F.coalesce(t, F.lit(1e12)))
    return dense_index(settle(rows), scope, ["sort_time", "seq"], "position", width_sec)
