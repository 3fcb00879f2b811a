"""Call and session assembly.

Sessions are found with running values (see ``functions.ordered``): a row belongs to the
session opened by the last boundary before it, so each rule becomes "where is the last
boundary" plus one grouped aggregate.  No channel is ever collected into one task.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.blockstate import run_blocks
from radiolake.functions.fields import field, has_path, nonempty
from radiolake.functions.lookups import dmr_call_type, dpmr_air_id
from radiolake.functions.ordered import WIDTH, before, scan, settle, upto, with_lags

SYMBOL_RATE = 4800.0
SAMPLE_RATE = 48000.0


def _none_before(a: Column, b: Column) -> Column:
    """``a`` exists and lies after ``b`` (or ``b`` does not exist)."""
    return F.coalesce(a > b, a.isNotNull())


def _duration(first: Column, last: Column, rate: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), (last - first) / F.lit(rate)), 3)


# ---------------------------------------------------------------- DMR


def dmr_signalling(df: DataFrame, scope: list[str], *keep: str) -> DataFrame:
    """What calls are made of: the four row types with the fields they carry."""
    typ = F.col("type")
    return df.where(typ.isin("LC_HEADER", "LATE_ENTRY", "TERMINATOR", "CSBK")).select(
        *scope,
        "seq",
        *keep,
        "type",
        field(df, "src_num", "bigint").alias("src"),
        field(df, "dst_num", "bigint").alias("dst"),
        nonempty(field(df, "flco", "string")).alias("flco"),
        nonempty(field(df, "fid", "string")).alias("fid"),
        field(df, "extra.color_code", "bigint").alias("color_code"),
        field(df, "extra.fs_start", "bigint").alias("sample"),
        nonempty(field(df, "extra.flc.call_type", "string")).alias("stated_type"),
        field(df, "extra.data_type_name", "string").alias("data_type_name"),
        field(df, "extra.sync_type", "string").alias("sync_type"),
    )


def dmr_call_columns(calls: DataFrame, scope: list[str], *keep: str) -> DataFrame:
    """Call rows from their summaries."""
    empty = F.lit("")
    return calls.select(
        *scope,
        F.lit("DMR").alias("protocol"),
        F.lit("DMR_CALL").alias("type"),
        "start_seq",
        F.coalesce("src", F.lit(0)).alias("src"),
        F.coalesce("dst", F.lit(0)).alias("dst"),
        F.coalesce("flco", empty).alias("flco"),
        F.coalesce("fid", empty).alias("fid"),
        F.coalesce("call_type", empty).alias("call_type"),
        "color_code",
        "start_sample",
        "end_sample",
        _duration(F.coalesce("start_sample", F.lit(0)), F.coalesce("end_sample", "start_sample", F.lit(0)), 10 * SYMBOL_RATE).alias("duration_s"),
        "signalling_count",
        "late_entry_count",
        "csbk_count",
        F.when(F.col("_closed"), "terminator").otherwise("end_of_scan").alias("closed_by"),
        "close_seq",
        F.coalesce("last_data_type_name", empty).alias("last_data_type_name"),
        F.coalesce("last_sync_type", empty).alias("last_sync_type"),
        *keep,
    )


def dmr_calls(df: DataFrame, scope: list[str] = ("channel_id",), width: float = WIDTH) -> DataFrame:
    """Calls from LC_HEADER / LATE_ENTRY / CSBK / TERMINATOR rows.

    A call opens at a header, a late entry, or a CSBK with an address, and closes at a
    terminator.  A terminator without an open call does nothing, so signalling seen before
    a call opens counts towards it.
    """
    scope = list(scope)
    typ = F.col("type")
    nonzero = lambda n: F.coalesce(F.col(n) != 0, F.lit(False))
    rows = dmr_signalling(df, scope)
    lc = typ.isin("LC_HEADER", "LATE_ENTRY")
    starter = lc | ((typ == "CSBK") & (nonzero("src") | nonzero("dst")))
    term = typ == "TERMINATOR"
    # any terminator leaves the channel without a call, so these two decide "open"
    seen = scan(
        rows, scope, "seq",
        [
            before("_start", "max", F.when(starter, F.col("seq"))),
            before("_term", "max", F.when(term, F.col("seq"))),
        ],
        width,
    )
    is_open = _none_before(F.col("_start"), F.col("_term"))
    closes = term & is_open
    updates = lc | closes | ((typ == "CSBK") & starter & ~is_open)
    flagged = seen.withColumns({"_closes": closes, "_updates": updates, "_starter": starter}).drop("_start", "_term")
    grouped = scan(
        settle(flagged), scope, "seq",
        [
            before("_sid", "max", F.when(F.col("_closes"), F.col("seq"))),
            upto("_flco", "last", F.when(F.col("_updates") & F.col("flco").isNotNull(), F.struct("seq", "flco"))),
        ],
        width,
    )
    own_flco = F.when(F.coalesce(F.col("_flco.seq") > F.col("_sid"), F.lit(True)), F.col("_flco.flco"))
    grouped = grouped.withColumn(
        "_type", F.when(F.col("_updates"), F.coalesce("stated_type", nonempty(dmr_call_type(own_flco))))
    )

    def last(col: str, cond: Column | None = None) -> Column:
        ok = F.col("_updates") & F.col(col).isNotNull()
        return F.max_by(col, F.when(ok if cond is None else ok & cond, F.col("seq")))

    signalling = F.col("type") != "TERMINATOR"
    calls = (
        grouped.groupBy(*scope, "_sid")
        .agg(
            F.min(F.when(F.col("_starter"), F.col("seq"))).alias("start_seq"),
            last("src", F.col("src") != 0).alias("src"),
            last("dst", F.col("dst") != 0).alias("dst"),
            last("flco").alias("flco"),
            last("fid").alias("fid"),
            F.max_by("_type", F.when(F.col("_type").isNotNull(), F.col("seq"))).alias("call_type"),
            last("color_code").alias("color_code"),
            F.min_by("sample", F.when(F.col("_updates") & F.col("sample").isNotNull(), F.col("seq"))).alias("start_sample"),
            last("sample").alias("end_sample"),
            F.count_if(signalling).alias("signalling_count"),
            F.count_if(F.col("type") == "LATE_ENTRY").alias("late_entry_count"),
            F.count_if(F.col("type") == "CSBK").alias("csbk_count"),
            F.max("_closes").alias("_closed"),
            F.max(F.when(F.col("_closes"), F.col("seq"))).alias("close_seq"),
            F.max_by("data_type_name", F.when(F.col("_closes"), F.col("seq"))).alias("last_data_type_name"),
            F.max_by("sync_type", F.when(F.col("_closes"), F.col("seq"))).alias("last_sync_type"),
        )
        .where(F.col("start_seq").isNotNull())
    )
    return dmr_call_columns(calls, scope)


# ---------------------------------------------------------------- P25

P25_STARTERS = ("HDU", "LDU1", "LDU2")
P25_TERMINATORS = ("TDU", "TDULC")
P25_VOICE = ("LDU1", "LDU2")


def p25_call_columns(calls: DataFrame, scope: list[str], *keep: str) -> DataFrame:
    """Call rows from their summaries (link control as struct ``lc``)."""
    return calls.select(
        *scope,
        F.lit("P25").alias("protocol"),
        F.lit("P25_CALL").alias("type"),
        "start_seq",
        F.coalesce("lc.src", F.lit(0)).alias("src"),
        F.coalesce("lc.dst", F.lit(0)).alias("dst"),
        F.when(F.coalesce("lc.is_group", F.lit(False)), "GROUP").otherwise("").alias("flco"),
        "nac",
        F.round((F.col("end_sample") - F.col("first_sample")) / F.lit(10 * SYMBOL_RATE), 3).alias("duration_s"),
        "ldu_count",
        F.col("end_sample").alias("fs_start"),
        "close_seq",
        *keep,
    )


def p25_calls(
    df: DataFrame, scope: list[str] = ("channel_id",), emit_open: bool = False, width: float = WIDTH
) -> DataFrame:
    """Calls from P25 frames (``duid_name``, ``nac``, ``fs_start``, struct ``lc``).

    Link control is overwritten by each later one.  A call without a terminator is not
    reported unless ``emit_open`` asks for it.
    """
    scope = list(scope)
    duid = F.col("duid_name")
    term = duid.isin(*P25_TERMINATORS)
    rows = scan(df, scope, "seq", [before("_sid", "max", F.when(term, F.col("seq")))], width)
    starter = duid.isin(*P25_STARTERS)
    seq = F.col("seq")
    has_lc = F.col("lc").isNotNull() & ~term
    calls = (
        rows.groupBy(*scope, "_sid")
        .agg(
            F.min(F.when(starter, seq)).alias("start_seq"),
            F.min_by(F.struct("nac", "fs_start"), F.when(starter, seq)).alias("_first"),
            F.max(F.when(term, F.col("fs_start"))).alias("_end"),
            F.max(F.when(term, seq)).alias("close_seq"),
            F.max("fs_start").alias("_last"),
            F.max_by(F.struct(seq.alias("seq"), F.col("lc").alias("lc")), F.when(has_lc, seq)).alias("_lc"),
            F.count_if(duid.isin(*P25_VOICE)).alias("ldu_count"),
        )
        .where(F.col("start_seq").isNotNull())
    )
    if not emit_open:
        calls = calls.where(F.col("_end").isNotNull())
    return p25_call_columns(
        calls.select(
            *scope, "start_seq", F.when(F.col("_lc.seq") >= F.col("start_seq"), F.col("_lc.lc")).alias("lc"), "_first.nac",
            F.col("_first.fs_start").alias("first_sample"), F.coalesce("_end", "_last").alias("end_sample"), "ldu_count", "close_seq",
        ),
        scope,
    )


# ---------------------------------------------------------------- NXDN

NXDN_ENDS = ("NXDN_TX_REL", "NXDN_TX_REL_EX", "NXDN_DISC")


def assemble_alias(df: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Talker alias from numbered parts: the latest bytes of each part up to the latest
    total, printable characters only, trimmed.  One row per ``by``."""
    part, total = F.col("alias_segment"), F.col("alias_total")
    ok = df.where((part >= 1) & (total >= part))
    parts = ok.groupBy(*by, "alias_segment").agg(
        F.max_by("alias_bytes", order).alias("_b"),
        F.max(F.struct(F.col(order), F.col("alias_total"))).alias("_t"),
    )
    whole = parts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("alias_segment", "_b"))).alias("_p"),
        F.max("_t").alias("_t"),
    )
    used = F.filter("_p", lambda p: p["alias_segment"] <= F.col("_t.alias_total"))
    codes = F.filter(F.flatten(F.transform(used, lambda p: p["_b"])), lambda c: (c >= 32) & (c <= 126))
    text = F.trim(F.concat_ws("", F.transform(codes, lambda c: F.chr(c))))
    return whole.select(*by, text.alias("alias"))


def nxdn_messages(df: DataFrame, scope: list[str], *keep: str) -> DataFrame:
    """VCALL, alias and release messages with the fields they carry."""
    return df.select(
        *scope,
        "seq",
        *keep,
        "type",
        field(df, "src_num", "bigint").alias("src"),
        field(df, "dst_num", "bigint").alias("dst"),
        field(df, "extra.call_type", "string").alias("call_type"),
        field(df, "extra.ran", "bigint").alias("ran"),
        field(df, "extra.fs_start", "bigint").alias("sample"),
        field(df, "extra.alias_segment", "bigint", 0).alias("alias_segment"),
        field(df, "extra.alias_total", "bigint", 0).alias("alias_total"),
        (F.col("extra.alias_bytes") if has_path(df.schema, "extra.alias_bytes") else F.array().cast("array<bigint>")).alias("alias_bytes"),
        field(df, "extra.payload_hex", "string", "").alias("payload_hex"),
    ).where(F.col("type").isin("NXDN_VCALL", "NXDN_PROP_ALIAS", *NXDN_ENDS))


def nxdn_call_columns(calls: DataFrame, scope: list[str], *keep: str) -> DataFrame:
    """Call rows from their summaries."""
    empty = F.lit("")
    return calls.select(
        *scope,
        F.lit("NXDN").alias("protocol"),
        F.lit("NXDN_CALL").alias("type"),
        "start_seq",
        "src",
        "dst",
        F.upper("call_type").alias("flco"),
        "call_type",
        "ran",
        "start_sample",
        "end_sample",
        _duration(F.coalesce("start_sample", F.lit(0)), F.coalesce("end_sample", "start_sample", F.lit(0)), SAMPLE_RATE).alias("duration_s"),
        "message_count",
        F.coalesce("alias", empty).alias("alias"),
        F.coalesce("end_type", F.lit("end_of_input")).alias("closed_by"),
        F.coalesce("end_payload_hex", empty).alias("last_payload_hex"),
        "close_seq",
        *keep,
    )


def nxdn_calls(df: DataFrame, scope: list[str] = ("channel_id",), width: float = WIDTH) -> DataFrame:
    """Calls from VCALL, alias and release messages."""
    scope = list(scope)
    rows = nxdn_messages(df, scope)
    typ, seq = F.col("type"), F.col("seq")
    vcall, alias, release = typ == "NXDN_VCALL", typ == "NXDN_PROP_ALIAS", typ.isin(*NXDN_ENDS)
    rows = scan(
        rows, scope, "seq",
        [
            before("_vcall", "max", F.when(vcall, seq)),
            before("_sid", "max", F.when(release, seq)),
        ],
        width,
    )
    is_open = _none_before(F.col("_vcall"), F.col("_sid"))
    rows = rows.where(vcall | is_open)  # what happens outside a call leaves no trace
    group = F.coalesce("_sid", F.lit(-1))
    rows = rows.withColumn("_sid", group)

    def last(col: str) -> Column:
        return F.max_by(col, F.when(vcall & F.col(col).isNotNull(), seq))

    calls = rows.groupBy(*scope, "_sid").agg(
        F.min(F.when(vcall, seq)).alias("start_seq"),
        last("src").alias("src"),
        last("dst").alias("dst"),
        last("call_type").alias("call_type"),
        last("ran").alias("ran"),
        F.min_by("sample", F.when(vcall, seq)).alias("start_sample"),
        F.max_by("sample", seq).alias("end_sample"),
        F.count_if(vcall).alias("message_count"),
        F.max_by(F.struct("type", "payload_hex"), F.when(release, seq)).alias("_end"),
        F.max(F.when(release, seq)).alias("close_seq"),
    )
    names = assemble_alias(rows.where(alias), [*scope, "_sid"])
    out = calls.join(names, [*scope, "_sid"], "left")
    out = out.withColumns({"end_type": F.col("_end.type"), "end_payload_hex": F.col("_end.payload_hex")})
    return nxdn_call_columns(out, scope)


# ---------------------------------------------------------------- TETRA

TETRA_STARTS = ("DM-SETUP", "DM-OCCUPIED")
TETRA_RELEASES = ("DM-RELEASE", "DM-TX CEASED")


def tetra_sessions(df: DataFrame, scope: list[str] = ("channel_id",), width_sec: float = 3600.0) -> DataFrame:
    """Direct-mode sessions in time order.

    A start message with other addresses opens a new session, a release only marks one.
    Blocks are ``width_sec`` of air time, which bounds their rows by the slot rate.
    """
    scope = list(scope)
    start = field(df, "extra.start_time_s", "double")
    end = field(df, "extra.end_time_s", "double")
    clean = lambda c: F.when(~F.isnan(c), c)
    rows = df.where(F.col("type").startswith("TETRA_") & (F.col("type") != "TETRA_SESSION")).select(
        *scope,
        F.coalesce(clean(start), clean(end), F.col("seq").cast("double")).alias("_t"),
        "seq",
        "type",
        "flco",
        field(df, "src_num", "bigint", 0).alias("src"),
        field(df, "dst_num", "bigint", 0).alias("dst"),
        start.alias("start_time_s"),
        end.alias("end_time_s"),
        field(df, "extra.slot_start_bit", "bigint").alias("slot_start_bit"),
        field(df, "extra.slot_end_bit", "bigint").alias("slot_end_bit"),
        field(df, "extra.frame_number", "bigint").alias("frame_number"),
        field(df, "extra.slot_number", "bigint").alias("slot_number"),
        field(df, "extra.mni", "bigint").alias("mni"),
        field(df, "extra.dcc", "string", "").alias("dcc"),
        nonempty(field(df, "extra.service", "string")).alias("service"),
    )
    tch = F.col("type") == "TETRA_TCH_CANDIDATE"
    starts = ~tch & F.col("flco").isin(*TETRA_STARTS)
    at = F.struct("_t", "seq")
    who = F.struct("src", "dst")
    order = ["_t", "seq"]
    rows = scan(rows, scope, order, [before("_who", "last", F.when(starts, who))], width_sec)
    opens = starts & (F.col("_who").isNull() | (F.col("_who") != who))
    rows = scan(settle(rows.withColumn("_opens", opens)), scope, order, [upto("_sid", "last", F.when(F.col("_opens"), at))], width_sec)
    rows = rows.where(F.col("_sid").isNotNull())

    def first(col: str) -> Column:
        return F.max(F.when(F.col("_opens"), F.col(col)))

    def last(col: str, cond: Column) -> Column:
        return F.max_by(col, F.when(cond & F.col(col).isNotNull(), at))

    every, control = F.lit(True), ~tch
    sessions = rows.groupBy(*scope, "_sid").agg(
        first("src").alias("src"),
        first("dst").alias("dst"),
        first("mni").alias("mni"),
        first("dcc").alias("dcc"),
        first("start_time_s").alias("start_time_s"),
        last("end_time_s", every).alias("end_time_s"),
        first("slot_start_bit").alias("start_bit"),
        last("slot_end_bit", every).alias("end_bit"),
        first("frame_number").alias("start_frame_number"),
        first("slot_number").alias("start_slot_number"),
        last("frame_number", control).alias("end_frame_number"),
        last("slot_number", control).alias("end_slot_number"),
        F.min_by("service", F.when(control & F.col("service").isNotNull(), at)).alias("service"),
        F.count_if(F.col("type") == "TETRA_DMAC_SYNC").alias("sync_event_count"),
        F.count_if(F.col("type") == "TETRA_STCH").alias("stch_event_count"),
        F.count_if(control).alias("control_event_count"),
        F.count_if(tch).alias("tch_candidate_count"),
        F.max_by("flco", F.when(control & F.col("flco").isin(*TETRA_RELEASES), at)).alias("release_message"),
    )
    newest = sessions.groupBy(*scope).agg(F.max("_sid").alias("_newest"))
    out = sessions.join(newest, scope)
    is_last = F.col("_sid") == F.col("_newest")
    end_time = F.coalesce("end_time_s", "start_time_s")
    return out.select(
        *scope,
        F.lit("TETRA").alias("protocol"),
        F.lit("TETRA_SESSION").alias("type"),
        F.col("_sid.seq").alias("start_seq"),
        "src",
        "dst",
        F.lit("DMO_SESSION").alias("flco"),
        F.when(~is_last, "closed_by_new_session")
        .when(F.col("release_message").isNotNull(), "closed")
        .otherwise("open")
        .alias("state"),
        "start_time_s",
        end_time.alias("end_time_s"),
        (end_time - F.col("start_time_s")).alias("duration_s"),
        "start_bit",
        F.coalesce("end_bit", "start_bit").alias("end_bit"),
        "start_frame_number",
        "start_slot_number",
        "end_frame_number",
        "end_slot_number",
        "mni",
        "dcc",
        "sync_event_count",
        "stch_event_count",
        "control_event_count",
        "tch_candidate_count",
        F.coalesce("release_message", F.lit("")).alias("release_message"),
        F.coalesce("service", F.lit("")).alias("service"),
    )


# ---------------------------------------------------------------- dPMR


def dpmr_split_step(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Decide for each frame whether it opens a new call, and who is talking.

    ``state`` is what the decision needs of the open call: colour, addresses, and the best
    control-channel record of each frame number.
    """
    out_split, out_src, out_dst = [], [], []
    for color, src, dst, records in zip(rows["color_code"], rows["src"], rows["dst"], rows["cch"], strict=True):
        color = None if pd.isna(color) else int(color)
        src, dst = src or "", dst or ""
        active, held = state["active"], state["color"]
        split = active and color is not None and held is not None and color != held
        if active and not split and src and dst and state["src"] and state["dst"]:
            split = src != state["src"] or dst != state["dst"]
        if split or not active:
            state = {"active": True, "color": None, "src": "", "dst": "", "records": {}}
        state["src"], state["dst"] = src or state["src"], dst or state["dst"]
        if color is not None and color >= 0:
            state["color"] = color
        found = state["records"]
        for r in [] if records is None else records:
            number = r["frame_number"]
            if number is None or not (r["crc_ok"] or r["hamming_ok"]):
                continue
            number, ok = str(int(number)), bool(r["crc_ok"])
            if number not in found or (ok and not found[number][1]):
                found[number] = [int(r["id_half"] or 0), ok]
        for name, a, b in (("dst", "0", "1"), ("src", "2", "3")):
            if a in found and b in found and found[a][1] and found[b][1]:
                state[name] = _air_id_text((found[a][0] << 12 | found[b][0]) & 0xFFFFFF)
        out_split.append(split or not active)
        out_src.append(state["src"])
        out_dst.append(state["dst"])
    out = pd.DataFrame({"seq": rows["seq"].to_numpy(), "opens": out_split, "src": out_src, "dst": out_dst})
    return state, out


def _air_id_text(value: int) -> str:
    digits = []
    for power in range(6, -1, -1):
        digit, value = divmod(value, 11**power)
        digits.append("*" if digit == 10 else str(digit))
    return "".join(digits)


DPMR_FRESH = {"active": False, "color": None, "src": "", "dst": "", "records": {}}


def dpmr_calls(df: DataFrame, scope: list[str] = ("channel_id",), width: float = WIDTH) -> DataFrame:
    """Calls from header and voice frames.

    Where a call splits depends on addresses collected so far, which is walked in blocks;
    counts and lists are then plain aggregates over the split rows.
    """
    scope = list(scope)
    frames = df.where(F.col("type").isin("DPMR_HEADER", "DPMR_VOICE")).select(
        *scope,
        "seq",
        "type",
        field(df, "src", "string", "").alias("src"),
        field(df, "dst", "string", "").alias("dst"),
        field(df, "extra.color_code", "bigint").alias("color_code"),
        field(df, "extra.fs_start", "bigint").alias("sample"),
        field(df, "extra.sync_type", "string").alias("sync_type"),
        field(df, "extra.superframe_part", "string").alias("superframe_part"),
        F.col("extra.cch").alias("cch"),
    )
    needed = frames.select(
        *scope, "seq", "color_code", "src", "dst",
        F.transform("cch", lambda r: F.struct(r["frame_number"].alias("frame_number"), r["id_half"].alias("id_half"), r["crc_ok"].alias("crc_ok"), r["hamming_ok"].alias("hamming_ok"))).alias("cch"),
    )
    splits = run_blocks(
        needed, scope, ["seq"], dpmr_split_step, DPMR_FRESH, "seq long, opens boolean, src string, dst string", width
    )
    # a call's number is found from the narrow rows; frames are joined to it once, and written once
    # for the counts and lists that read them
    splits = scan(settle(splits), scope, "seq", [upto("_sid", "max", F.when(F.col("opens"), F.col("seq")))], width)
    rows = settle(frames.drop("src", "dst").join(splits.drop("opens"), [*scope, "seq"]))
    return _dpmr_summary(rows, scope)


def _dpmr_summary(rows: DataFrame, scope: list[str]) -> DataFrame:
    seq = F.col("seq")
    usable = F.filter("cch", lambda r: F.coalesce(r["crc_ok"], F.lit(False)) | F.coalesce(r["hamming_ok"], F.lit(False)))
    calls = rows.groupBy(*scope, "_sid").agg(
        F.max_by("src", seq).alias("src"),
        F.max_by("dst", seq).alias("dst"),
        F.max_by("color_code", F.when(F.col("color_code") >= 0, seq)).alias("color_code"),
        F.min_by("sample", F.when(F.col("sample").isNotNull(), seq)).alias("start_sample"),
        F.max_by("sample", F.when(F.col("sample").isNotNull(), seq)).alias("end_sample"),
        F.count_if(F.col("type") == "DPMR_HEADER").alias("header_count"),
        F.count_if(F.col("type") == "DPMR_VOICE").alias("voice_count"),
        F.sum(F.coalesce(F.size(usable), F.lit(0))).alias("cch_count"),
    )
    calls = settle(calls)  # the newest one closes otherwise
    # distinct values in order of first sight: reduce to one row per value first
    numbers = {
        "communication_modes": "communication_mode",
        "versions": "version",
        "comms_formats": "comms_format",
        "emergency_priorities": "emergency_priority",
    }
    texts = F.array(
        F.struct(F.lit("sync_types").alias("list"), nonempty(F.col("sync_type")).alias("v"), F.lit(-1).alias("n")),
        F.struct(F.lit("superframe_parts").alias("list"), nonempty(F.col("superframe_part")).alias("v"), F.lit(-1).alias("n")),
    )
    per_record = F.flatten(
        F.transform(
            F.filter(usable, lambda r: r["frame_number"].isNotNull()),
            lambda r, i: F.array(
                *[F.struct(F.lit(name).alias("list"), r[f].cast("string").alias("v"), i.alias("n")) for name, f in numbers.items()]
            ),
        )
    )
    values = (
        rows.select(*scope, "_sid", "seq", F.explode(F.concat(texts, F.coalesce(per_record, F.slice(texts, 1, 0)))).alias("x"))
        .where(F.col("x.v").isNotNull())
        .groupBy(*scope, "_sid", F.col("x.list").alias("list"), F.col("x.v").alias("v"))
        .agg(F.min(F.struct(seq, F.col("x.n"))).alias("_at"))
    )
    names = ["sync_types", "superframe_parts", *numbers]
    lists = values.groupBy(*scope, "_sid").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("list") == n, F.struct("_at", "v")))), lambda s: s["v"]
            ).alias(n)
            for n in names
        ]
    )
    newest = calls.groupBy(*scope).agg(F.max("_sid").alias("_newest"))
    out = calls.join(lists, [*scope, "_sid"], "left").join(newest, scope)
    none = F.array().cast("array<string>")
    return out.select(
        *scope,
        F.lit("dPMR").alias("protocol"),
        F.lit("dPMR_CALL").alias("type"),
        F.col("_sid").alias("start_seq"),
        "src",
        "dst",
        F.when(F.col("voice_count") > 0, "VOICE").otherwise("HEADER").alias("flco"),
        "color_code",
        "start_sample",
        "end_sample",
        _duration(F.coalesce("start_sample", F.lit(0)), F.coalesce("end_sample", "start_sample", F.lit(0)), 20 * 2400.0).alias("duration_s"),
        "header_count",
        "voice_count",
        "cch_count",
        *[F.coalesce(n, none).alias(n) for n in names[:2]],
        *[F.coalesce(n, none).cast("array<bigint>").alias(n) for n in names[2:]],
        F.when(F.col("_sid") < F.col("_newest"), "new_session").otherwise("end_of_scan").alias("closed_by"),
    )


def cch_ids(df: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Addresses spread over control-channel frames: destination in 0+1, source in 2+3.

    The first valid record of each frame number counts; an id needs both its halves.
    """
    halves = df.where("crc_ok").groupBy(*by).agg(
        *[F.min_by("id_half", F.when(F.col("frame_number") == n, F.col(order))).alias(f"h{n}") for n in range(4)]
    )

    def joined(a: str, b: str) -> Column:
        value = F.shiftleft(F.col(a), 12).bitwiseOR(F.col(b)).bitwiseAND(F.lit(0xFFFFFF).cast("bigint"))
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), dpmr_air_id(value))

    return halves.select(*by, joined("h2", "h3").alias("src"), joined("h0", "h1").alias("dst"))


def stable_color(df: DataFrame, scope: list[str], min_repeats: int = 2) -> DataFrame:
    """Keep the rows of each scope's dominant dPMR colour.

    Needs ``protocol, type, seq, color_code, confidence``.  Colours rank by count, then
    earliest, then summed quality.  Frames below medium confidence are kept only where the
    colour has no better ones.  A scope without a repeated colour passes unchanged.
    """
    scope = list(scope)
    is_dpmr = F.col("protocol") == "dPMR"
    call = is_dpmr & (F.col("type") == "dPMR_CALL")
    conf = F.coalesce("confidence", F.lit("none"))
    good = conf.isin("high", "medium")
    quality = F.when(conf == "high", 10).when(conf == "medium", 6).when(conf == "low", 1).otherwise(0)
    colors = (
        df.where(is_dpmr & ~call & (F.col("color_code") >= 0))
        .groupBy(*scope, "color_code")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.sum(quality).alias("q"), F.max(good).alias("good"))
    )
    best = colors.groupBy(*scope).agg(
        F.max(F.struct("n", (-F.col("first")).alias("f"), "q", "color_code", "good")).alias("_best")
    )
    frames = df.where(is_dpmr & ~call).groupBy(*scope).agg(F.count(F.lit(1)).alias("_frames"))
    ranked = best.join(frames, scope).where((F.col("_best.n") >= min_repeats) & (F.col("_frames") >= min_repeats))
    out = df.join(ranked.select(*scope, "_best"), scope, "left")
    same = F.col("color_code") == F.col("_best.color_code")
    keep = F.col("_best").isNull() | ~is_dpmr | (same & (call | ~F.col("_best.good") | good))
    stamped = F.col("_best").isNotNull() & is_dpmr
    return (
        out.where(keep)
        .withColumns(
            {
                "stable_color_code": F.when(stamped, F.col("_best.color_code")),
                "stable_color_repeats": F.when(stamped, F.col("_best.n")),
            }
        )
        .drop("_best")
    )


def stable_nac(
    df: DataFrame, scope: list[str], min_count: int = 5, min_ratio: float = 0.4, last_invalid: int | None = None
) -> DataFrame:
    """Frames worth keeping: the valid ones, or without any the ones of the dominant NAC.

    ``last_invalid`` looks only at that many latest frames, as a live decoder does.
    """
    scope = list(scope)
    if last_invalid is not None:
        valid_scopes = df.where("valid_bch").select(*scope).distinct()
        bad = df.join(valid_scopes, scope, "left_anti")
        df = df.where("valid_bch").unionByName(
            _latest(bad, scope, last_invalid)
        )
    nacs = df.groupBy(*scope, "nac").agg(F.count(F.lit(1)).alias("n"), F.max("valid_bch").alias("v"))
    best = nacs.groupBy(*scope).agg(
        F.max("v").alias("_any_valid"),
        F.sum("n").alias("_total"),
        F.max(F.struct("n", (-F.col("nac")).alias("m"))).alias("_top"),
    )
    need = F.greatest(F.lit(min_count), F.floor(F.lit(min_ratio) * F.col("_total")))
    modal = F.when(F.col("_top.n") >= need, -F.col("_top.m"))
    out = df.join(best.select(*scope, "_any_valid", modal.alias("_nac")), scope)
    keep = F.when(F.col("_any_valid"), F.col("valid_bch")).otherwise(F.coalesce(F.col("nac") == F.col("_nac"), F.lit(False)))
    return out.where(keep).drop("_any_valid", "_nac")


def _latest(df: DataFrame, scope: list[str], n: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*scope).orderBy(F.col("seq").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- sequences of fragments

FRAME_SAMPLES = 1920
GAP_TOLERANCE = 20


def assemble_superframes(df: DataFrame, scope: list[str], width: float = WIDTH) -> DataFrame:
    """Join parts 1-2-3-4 of a superframe that follow each other without a break.

    Valid blocks outside a superframe pass through alone and do not disturb an assembly;
    an invalid block, another context or a gap does.
    """
    scope = list(scope)
    cols = ["part", "crc_ok", "superframe", "ran", "direction", "rf_channel_type", "fs_start", "bits"]
    single = df.where(F.col("crc_ok") & ~F.col("superframe")).select(
        *scope, "seq", "ran", F.col("fs_start").alias("first_sample"), F.col("fs_start").alias("last_sample"),
        F.col("bits").alias("layer3_bits"), F.lit(False).alias("superframe"),
    )
    rest = with_lags(df.where(~(F.col("crc_ok") & ~F.col("superframe"))), scope, "seq", cols, 3, width)
    here = {c: F.col(c) for c in cols}
    chain = [here, *[{c: F.col(f"lag{k}.{c}") for c in cols} for k in (1, 2, 3)]]
    ok = F.lit(True)
    for back, row in enumerate(chain):
        ok = ok & row["crc_ok"] & row["superframe"] & (row["part"] == 4 - back)
        for c in ("ran", "direction", "rf_channel_type"):
            ok = ok & (row[c] == here[c])
        if back < 3:
            gap = F.abs(row["fs_start"] - chain[back + 1]["fs_start"] - FRAME_SAMPLES)
            ok = ok & (gap <= GAP_TOLERANCE)
    whole = rest.where(ok).select(
        *scope, "seq", "ran", F.col("lag3.fs_start").alias("first_sample"), F.col("fs_start").alias("last_sample"),
        F.concat("lag3.bits", "lag2.bits", "lag1.bits", "bits").alias("layer3_bits"), F.lit(True).alias("superframe"),
    )
    return single.unionByName(whole)


LATE_ENTRY_ORDER = (1, 3, 3, 2)


def assemble_late_entry(df: DataFrame, scope: list[str], width: float = WIDTH) -> DataFrame:
    """Join four embedded fragments whose sequence marks read 1, 3, 3, 2."""
    rows = with_lags(df, list(scope), "seq", ["lcss", "bits"], 3, width)
    first, second, third, fourth = LATE_ENTRY_ORDER
    ok = (
        (F.col("lcss") == fourth)
        & (F.col("lag1.lcss") == third)
        & (F.col("lag2.lcss") == second)
        & (F.col("lag3.lcss") == first)
    )
    return rows.where(ok).select(
        *scope, "seq", F.col("lag3._o").alias("first_seq"),
        F.concat("lag3.bits", "lag2.bits", "lag1.bits", "bits").alias("embedded_bits"),
    )


# ---------------------------------------------------------------- context and timing


def carry_context(df: DataFrame, scope: list[str], valid: Column, context: list[str], order: str = "slot_start_bit",
                  width: float = float(1 << 24)) -> DataFrame:
    """Attach the latest valid sync context (own row included) to every burst."""
    rows = scan(
        df, list(scope), [order, "seq"],
        [upto("context", "last", F.when(valid, F.struct(*context)))], width,
    )
    return rows.withColumn("context_valid", F.col("context").isNotNull())


def infer_timing(df: DataFrame, scope: list[str], slot_bits: int = 510, width: float = float(1 << 24)) -> DataFrame:
    """Frame and slot of bursts without own timing, counted in slots from the nearest
    reference burst (``sch_s_ok`` with frame and slot); the earlier one wins a tie.

    Reference bursts fill a slot, so they lie at least one slot apart.
    """
    scope = list(scope)
    ref = F.struct(
        F.col("slot_start_bit").alias("bit"), F.col("frame_number").alias("fn"), F.col("slot_number").alias("tn")
    )
    usable = F.col("sch_s_ok") & F.col("frame_number").isNotNull() & F.col("slot_number").isNotNull()
    order = ["slot_start_bit", "seq"]
    rows = scan(df, scope, order, [before("_prev", "last", F.when(usable, ref))], width)
    rows = scan(settle(rows), scope, order, [before("_next", "last", F.when(usable, ref))], width, reverse=True)

    def delta(r: str) -> Column:
        return F.round((F.col("slot_start_bit") - F.col(f"{r}.bit")) / slot_bits).cast("bigint")

    use_prev = F.coalesce(F.abs(delta("_prev")) <= F.abs(delta("_next")), F.col("_prev").isNotNull())
    pick = F.when(use_prev, F.col("_prev")).otherwise(F.col("_next"))
    d = F.when(use_prev, delta("_prev")).otherwise(delta("_next"))
    infer = ~F.col("sch_s_ok") & pick.isNotNull()
    slot = F.pmod((pick["fn"] - 1) * 4 + (pick["tn"] - 1) + d, F.lit(72))
    return rows.withColumns(
        {
            "frame_number": F.when(infer, F.floor(slot / 4) + 1).otherwise(F.col("frame_number")),
            "slot_number": F.when(infer, slot % 4 + 1).otherwise(F.col("slot_number")),
            "timing_source": F.when(infer, "inferred_from_SCH/S").when(F.col("sch_s_ok"), "SCH/S"),
            "timing_slot_delta": F.when(infer, d),
        }
    ).drop("_prev", "_next")
