"""Projections, conformance, lookups and formatting."""

from pyspark.sql import functions as F

from radiolake.functions import bits as B
from radiolake.functions import lookups as L
from radiolake.functions import payload
from radiolake.functions.fields import field, first_field
from radiolake.functions.formats import with_line
from radiolake.operators import conform as C
from radiolake.plans.catalog import query
from radiolake.registry import target_rate

R6 = lambda c: F.round(c, 6)


@query(
    "prj1_conform_pdus",
    """SELECT seq, coalesce(protocol, 'DMR') AS protocol, type, CAST(src_num AS STRING) AS src, src_num,
         CAST(dst_num AS STRING) AS dst, dst_num, flco, '' AS fid, fo_hz FROM v_pdus""",
)
def _(v):
    df = v.pdus.drop("fid").withColumnRenamed("fo_hz", "x_fo_hz")
    return C.conform_pdus(df).select(
        "seq", "protocol", "type", "src", "src_num", "dst", "dst_num", "flco", "fid", "fo_hz"
    )


@query(
    "prj2_append_pdus",
    """SELECT seq, coalesce(protocol, 'DMR') AS protocol, fo_hz, NULL::DOUBLE AS start_time_s FROM v_pdus
       UNION ALL SELECT seq, protocol, NULL, round(start_time_s, 6) FROM v_pdus_tetra""",
)
def _(v):
    both = C.append_pdus(
        C.conform_pdus(v.pdus), C.conform_pdus(v.pdus_tetra)
    )
    return both.select("seq", "protocol", "fo_hz", R6("start_time_s").alias("start_time_s"))


@query("prj3_add_meta", "SELECT seq, k * 10e0 AS fo_hz, 'site-a' AS site FROM v_pdus")
def _(v):
    df = C.add_meta(v.pdus, "_fo_hz", F.col("k") * 10.0)
    return C.add_meta(df, "site", "site-a").select("seq", "fo_hz", "site")


@query(
    "prj4_nested_field",
    """SELECT event_id AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         'none' AS missing FROM events""",
)
def _(v):
    df = v.table("events").withColumnRenamed("props", "extra_json")
    return df.select(
        F.col("event_id").alias("seq"),
        field(df, "extra.k", "bigint").alias("k"),
        field(df, "extra.fec.name", "string", "none").alias("missing"),
    )


@query("prj5_alias_field", "SELECT seq, coalesce(fo_hz, value) AS fo_hz FROM v_pdus")
def _(v):
    df = v.pdus.withColumnRenamed("value", "x_fo_hz")
    return df.select("seq", first_field(df, ["fo_hz", "_fo_hz", "x_fo_hz"], "double").alias("fo_hz"))


_SPELLED = """SELECT o_custkey AS request, o_orderkey AS position,
  CASE o_orderkey % 7 WHEN 0 THEN 'dmr' WHEN 1 THEN 'P25' WHEN 2 THEN 'DPMR' WHEN 3 THEN 'nxdn96'
    WHEN 4 THEN 'Nxdn' WHEN 5 THEN 'TETRA' ELSE 'am' END AS name FROM orders"""


@query(
    "prj6_canonical_protocols",
    f"""asked AS ({_SPELLED}), named AS (SELECT *, CASE lower(name) WHEN 'dmr' THEN 'DMR' WHEN 'p25' THEN 'P25'
         WHEN 'dpmr' THEN 'dPMR' WHEN 'nxdn' THEN 'NXDN' WHEN 'nxdn96' THEN 'NXDN' WHEN 'tetra' THEN 'TETRA' END AS protocol
         FROM asked),
       numbered AS (SELECT *, row_number() OVER (PARTITION BY request, protocol ORDER BY position) AS rn FROM named)
       SELECT request, position, name, protocol FROM numbered WHERE protocol IS NULL OR rn = 1""",
)
def _(v):
    o = v.table("orders")
    spelled = F.array(*[F.lit(n) for n in ("dmr", "P25", "DPMR", "nxdn96", "Nxdn", "TETRA", "am")])
    asked = o.select(
        F.col("o_custkey").alias("request"),
        F.col("o_orderkey").alias("position"),
        F.get(spelled, (F.col("o_orderkey") % 7).cast("int")).alias("name"),
    )
    return C.canonical_protocols(asked, "request", "position", "name").select(
        "request", "position", "name", "protocol"
    )


@query(
    "prj7_resolve_protocols",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'TETRA,NXDN'
         WHEN o_orderstatus = 'F' THEN 'DMR,P25,dPMR,NXDN'
         WHEN o_orderstatus = 'O' THEN 'DMR,P25,dPMR,NXDN,TETRA' ELSE 'DMR,P25,dPMR,NXDN' END AS protocols
       FROM orders""",
)
def _(v):
    asked = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("tetra"), F.lit("nxdn96"), F.lit("NXDN")))
    df = v.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "blind")
        .when(F.col("o_orderstatus") == "O", "frequency_list")
        .otherwise("baseband")
        .alias("mode"),
        asked.alias("asked"),
    )
    return C.resolve_protocols(df, "mode", "asked").select(
        "o_orderkey", F.concat_ws(",", "protocols").alias("protocols")
    )


@query(
    "prj8_split_scan_modes",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NXDN' ELSE 'DMR,P25,dPMR,NXDN' END AS narrowband,
         CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderkey % 4 = 0 THEN 'TETRA'
           WHEN o_orderstatus = 'O' THEN 'TETRA' ELSE '' END AS windowed,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'windowed protocol in blind search' END AS error
       FROM orders""",
)
def _(v):
    asked = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("tetra"), F.lit("NXDN")))
    df = v.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "blind")
        .when(F.col("o_orderstatus") == "O", "frequency_list")
        .otherwise("baseband")
        .alias("mode"),
        asked.alias("asked"),
        asked.isNotNull().alias("explicit"),
    )
    out = C.split_by_mode(C.resolve_protocols(df, "mode", "asked"))
    return out.select(
        "o_orderkey",
        F.concat_ws(",", "narrowband").alias("narrowband"),
        F.concat_ws(",", "windowed").alias("windowed"),
        "error",
    )


@query(
    "prj9_pdu_table",
    """SELECT coalesce(protocol, 'DMR') AS protocol, type, CAST(src_num AS STRING) AS src,
         CAST(dst_num AS STRING) AS dst, flco, fo_hz FROM v_pdus""",
)
def _(v):
    return C.pdu_table(C.conform_pdus(v.pdus))


_FO = "CASE WHEN fo_hz IS NULL THEN '' ELSE printf(' (fo=%+.1fkHz)', fo_hz / 1000) END"


@query(
    "prj10_line_dmr",
    f"""SELECT seq, printf('[%-12s] PROTO=%s SRC=%d DST=%d FLCO=%s FID=%s', type, coalesce(protocol, 'DMR'),
         src_num, dst_num, flco, fid) || {_FO} AS line FROM v_pdus""",
)
def _(v):
    return with_line(C.conform_pdus(v.pdus)).select("seq", "line")


@query(
    "prj10_line_p25",
    """SELECT seq, printf('[%-12s] PROTO=P25', type) || CASE type
         WHEN 'P25_HDU' THEN ' FRAME=HDU' WHEN 'P25_LDU2' THEN ' FRAME=LDU2'
         WHEN 'P25_LDU1' THEN ' FRAME=LDU1' || CASE WHEN lc_is_group THEN printf(' SRC=%d TGID=%d', lc_src, lc_dst)
           WHEN NOT lc_is_group THEN printf(' SRC=%d DEST=%d', lc_src, lc_dst) ELSE '' END
         ELSE ' FRAME=' || duid_name END || printf(' NAC=0x%03X', nac)
       || printf(' DUID=0x%X BCH=%s CORR=0', k, CASE WHEN valid_bch THEN 'OK' ELSE 'FAIL' END)
       || CASE type WHEN 'P25_HDU' THEN printf(' MI=0x%018X MFID=0x%02X ALGID=0x80 KID=0x0000 TGID=%d', k * 77, k, k)
         WHEN 'P25_LDU1' THEN printf(' LCF=0x00 MFID=0x%02X CALL=%s LCW16=0x0000', k,
           CASE WHEN lc_is_group THEN 'group' WHEN NOT lc_is_group THEN 'unit_to_unit' ELSE '' END)
         WHEN 'P25_LDU2' THEN printf(' ES_MI=0x%018X ES_ALGID=0x00 ES_KID=0x%04X', k * 99, k) ELSE '' END AS line
       FROM v_pdus_p25""",
)
def _(v):
    k = F.col("k")
    df = v.pdus_p25.select(
        "seq", "protocol", "type", F.col("duid_name").alias("flco"),
        F.col("lc_src").alias("src"), F.col("lc_dst").alias("dst"),
        F.struct(
            "nac", k.alias("duid"), "valid_bch", (k * 77).alias("mi"), k.alias("hdu_mfid"),
            F.lit(128).alias("algid"), k.alias("hdu_tgid"), k.alias("mfid"), F.col("lc_dst").alias("tgid"),
            F.when(F.col("lc_is_group"), "group").when(~F.col("lc_is_group"), "unit_to_unit").alias("call_type"),
            (k * 99).alias("es_mi"), k.alias("es_kid"),
        ).alias("extra"),
    )
    return with_line(df).select("seq", "line")


@query(
    "prj10_line_dpmr",
    """SELECT seq, printf('[%-12s] PROTO=dPMR SRC=%s DST=%s CC=%s SYNC=%s POL=%s', type, src, dst,
         CASE WHEN color_code >= 0 THEN printf('%02d', color_code) ELSE '--' END, sync_type,
         CASE WHEN k % 2 = 1 THEN 'INV' ELSE 'NORM' END)
         || printf(' CCH=[FN=%d IDH=0x%03X M=%d V=%d F=%d E=%d RES=0 SLD=0x00000]', frame_number, id_half,
           communication_mode, version, comms_format, emergency_priority) AS line FROM v_cch""",
)
def _(v):
    cch = F.struct(
        "frame_number", "id_half", "communication_mode", "version", "comms_format", "emergency_priority",
        F.lit(None).cast("bigint").alias("reserved"), F.lit(None).cast("bigint").alias("slow_data"),
    )
    df = v.cch.select(
        "seq", "protocol", "type", "src", "dst",
        F.struct(
            "color_code", "sync_type", (F.col("k") % 2 == 1).alias("polarity_inverted"), F.array(cch).alias("cch")
        ).alias("extra"),
    )
    return with_line(df).select("seq", "line")


@query(
    "prj10_line_nxdn",
    """SELECT seq, printf('[%-18s] PROTO=NXDN CH=SACCH RAN=%d SRC=%d DST=%d MSG=%s DATA=%s', type, ran, src_num,
         dst_num, upper(call_type), payload_hex) AS line FROM v_pdus_nxdn""",
)
def _(v):
    df = v.pdus_nxdn.select(
        "seq", "protocol", "type", F.col("src_num").alias("src"), F.col("dst_num").alias("dst"),
        F.upper("call_type").alias("flco"),
        F.struct("ran", "payload_hex", F.lit("SACCH").alias("functional_channel")).alias("extra"),
    )
    return with_line(df).select("seq", "line")


@query(
    "prj10_line_tetra",
    """t AS (SELECT *, CASE WHEN start_time_s IS NULL THEN '' ELSE printf(' T=%.3fs', start_time_s) END AS tt FROM v_pdus_tetra)
       SELECT seq, printf('[%-18s] PROTO=TETRA SRC=%d DST=%d MNI=%d FN=%d TN=%d', type, src_num, dst_num, mni,
         frame_number, slot_number) || CASE
           WHEN type = 'TETRA_DMAC_SYNC' THEN ' MSG=' || flco || ' FC=' || ' DCC=' || tt
           WHEN type = 'TETRA_TCH_CANDIDATE' THEN printf(' LCH=TCH SCHF_ERR=%d/%s STATUS=', k,
             CASE WHEN k % 2 = 0 THEN printf('%d', CAST(floor(k / 2) AS BIGINT)) ELSE printf('%.1f', k / 2) END) || tt
           ELSE printf(' LCH=%s PDU= MSG=%s ST2=%d', logical_channel, flco, k % 2) || tt END AS line FROM t""",
)
def _(v):
    df = v.pdus_tetra.select(
        "seq", "protocol", "type", F.col("src_num").alias("src"), F.col("dst_num").alias("dst"), "flco",
        F.struct(
            "mni", "frame_number", "slot_number", "start_time_s", "logical_channel",
            F.col("k").alias("schf_block_code_errors"), (F.col("k") / 2).alias("schf_tail_errors"),
            (F.col("k") % 2 == 1).alias("second_half_slot_stolen"),
        ).alias("extra"),
    )
    return with_line(df).select("seq", "line")


def _case(col: str, names: dict, other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in names.items()) + f" ELSE {other} END"


@query(
    "prj11_code_names",
    f"""SELECT seq, {_case("k % 64", L.DMR_FLCO, "printf('UNKNOWN_0x%02X', k % 64)")} AS flco_name,
         {_case("k * 2 % 256", L.DMR_FID, "printf('FID_0x%02X', k * 2 % 256)")} AS fid_name,
         {_case("k % 64", L.NXDN_MESSAGES, "'UNKNOWN'")} AS message_name,
         {_case("k % 9", dict(enumerate(L.NXDN_CALL_TYPES)), "'unknown'")} AS call_type,
         {_case("k % 17", {d: f[0] for d, f in L.P25_FRAMES.items()}, "printf('P25_UNKNOWN_0x%X', k % 17)")} AS pdu_type,
         {_case("k % 17", {d: f[1] for d, f in L.P25_FRAMES.items()}, "'unknown'")} AS category,
         k % 17 IN (5, 10) AS is_voice, k % 17 IN (3, 15) AS is_terminator
       FROM v_payload""",
)
def _(v):
    k = F.col("k")
    frame = L.p25_frame(k % 17)
    return v.payload.select(
        "seq",
        L.dmr_flco_name(k % 64).alias("flco_name"),
        L.dmr_fid_name(k * 2 % 256).alias("fid_name"),
        L.nxdn_message_name(k % 64).alias("message_name"),
        L.nxdn_call_type(k % 9).alias("call_type"),
        frame["pdu_type"].alias("pdu_type"),
        frame["category"].alias("category"),
        frame["is_voice"].alias("is_voice"),
        frame["is_terminator"].alias("is_terminator"),
    )


@query(
    "prj12_lich_attributes",
    """p AS (SELECT l_orderkey, l_linenumber, lich, CAST(lich AS INT) >> 5 & 3 AS rf, CAST(lich AS INT) >> 3 & 3 AS fc,
         CAST(lich AS INT) >> 1 & 3 AS op, CAST(lich AS INT) & 1 AS d FROM v_frame_quality),
       n AS (SELECT *, CASE WHEN rf = 0 THEN CASE WHEN d = 1 AND fc = 0 THEN 'CAC_OUTBOUND' WHEN d = 0 AND fc = 1
           THEN 'CAC_LONG_INBOUND' WHEN d = 0 AND fc = 3 THEN 'CAC_SHORT_INBOUND' ELSE 'CAC_RESERVED' END
         WHEN fc = 1 THEN CASE op WHEN 0 THEN 'FACCH2' WHEN 3 THEN 'UDCH' ELSE 'USC_RESERVED' END
         WHEN fc = 3 THEN 'SACCH_IDLE' ELSE 'SACCH' END AS functional_channel,
         CASE WHEN rf = 0 OR fc IN (1, 3) THEN 'none' WHEN op IN (0, 1) THEN 'FACCH1' ELSE 'VCH' END AS half1_type,
         CASE WHEN rf = 0 OR fc IN (1, 3) THEN 'none' WHEN op IN (0, 2) THEN 'FACCH1' ELSE 'VCH' END AS half2_type FROM p)
       SELECT l_orderkey, l_linenumber, lich, functional_channel, half1_type, half2_type,
         CASE rf WHEN 0 THEN 'RCCH' WHEN 1 THEN 'RTCH' WHEN 2 THEN 'RDCH' ELSE 'RTCH_C_OR_TYPE_D' END AS rf_channel_type,
         CASE d WHEN 0 THEN 'inbound' ELSE 'outbound' END AS direction,
         rf <> 0 AND fc <> 1 AS sacch, rf <> 0 AND fc IN (2, 3) AS superframe,
         half1_type = 'VCH' OR half2_type = 'VCH' AS voice_present,
         functional_channel NOT IN ('CAC_RESERVED', 'USC_RESERVED') AS supported FROM n""",
)
def _(v):
    df = v.frame_quality.select("l_orderkey", "l_linenumber", "lich", L.nxdn_lich(F.col("lich")).alias("f"))
    names = [
        "functional_channel", "half1_type", "half2_type", "rf_channel_type", "direction", "sacch",
        "superframe", "voice_present", "supported",
    ]
    return df.select("l_orderkey", "l_linenumber", "lich", *[F.col(f"f.{n}").alias(n) for n in names])


@query(
    "prj13_call_type",
    """SELECT seq, CASE flco WHEN 'GroupVoiceChannelUser' THEN 'group'
         WHEN 'UnitToUnitVoiceChannelUser' THEN 'unit_to_unit' ELSE '' END AS call_type FROM v_pdus""",
)
def _(v):
    return v.pdus.select("seq", L.dmr_call_type(F.col("flco")).alias("call_type"))


def _hex_int(text: str, first: int, last: int) -> str:
    """DuckDB integer of bits first..last of a bit string column."""
    return f"CAST(('0b' || substr({text}, {first}, {last - first + 1})) AS BIGINT)"


_NIB = (
    "list_transform(range(1, length({h}) + 1), lambda i: lpad(bin(('0x' || substr({h}, i, 1))::INT), 4, '0'))"
)


def _bits(h: str) -> str:
    return f"array_to_string({_NIB.format(h=h)}, '')"


# opcode byte from k, remaining bytes from the hash, so every layout occurs
_LC = "printf('%02X', CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE k END) || substr(hex, 1, 16)"
_L3 = "printf('%02X', CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 63 WHEN 3 THEN 24 ELSE k % 64 END) || CASE WHEN k % 6 = 2 THEN '688204' ELSE '' END || substr(hex, 1, 12)"


def _lc_hex():
    k = F.col("k")
    op = F.when(k % 3 == 0, 0).when(k % 3 == 1, 3).otherwise(k)
    return F.concat(F.format_string("%02X", op.cast("bigint")), F.substring("hex", 1, 16))


def _l3_hex():
    k = F.col("k")
    op = (
        F.when(k % 6 == 0, 1).when(k % 6 == 1, 8).when(k % 6 == 2, 63).when(k % 6 == 3, 24).otherwise(k % 64)
    )
    form = F.when(k % 6 == 2, "688204").otherwise("")
    return F.concat(F.format_string("%02X", op.cast("bigint")), form, F.substring("hex", 1, 12))


@query(
    "prj14_dmr_link_control",
    f"""b AS (SELECT seq, {_bits(f"({_LC})")} AS b FROM v_payload),
       f AS (SELECT seq, b, {_hex_int("b", 3, 8)} AS flco, {_hex_int("b", 9, 16)} AS fid FROM b)
       SELECT seq, flco, fid, {_case("flco", L.DMR_FLCO, "printf('UNKNOWN_0x%02X', flco)")} AS flco_name,
         CASE WHEN flco IN (0, 3) THEN {_hex_int("b", 49, 72)} ELSE 0 END AS src,
         CASE WHEN flco IN (0, 3) THEN {_hex_int("b", 25, 48)} ELSE 0 END AS dst FROM f""",
)
def _(v):
    df = v.payload.select("seq", B.hex_to_bits(_lc_hex()).alias("b"))
    df = df.select("seq", F.inline(F.array(payload.dmr_full_link_control(F.col("b")))))
    return df.select("seq", "flco", "fid", "flco_name", "src", "dst")


@query(
    "prj14_p25_link_control",
    f"""b AS (SELECT seq, {_bits(f"({_LC})")} AS b FROM v_payload),
       f AS (SELECT seq, b, {_hex_int("b", 1, 8)} AS lco FROM b)
       SELECT seq, lco, {_hex_int("b", 9, 16)} AS mfid, {_hex_int("b", 17, 32)} AS lc_info,
         CASE WHEN lco = 0 THEN substr(b, 17, 1) = '1' END AS emergency,
         CASE lco WHEN 0 THEN {_hex_int("b", 18, 32)} WHEN 3 THEN {_hex_int("b", 17, 24)} ELSE {_hex_int("b", 17, 32)} END AS reserved,
         CASE WHEN lco IN (0, 3) THEN {_hex_int("b", 49, 72)} ELSE 0 END AS src,
         CASE lco WHEN 0 THEN {_hex_int("b", 33, 48)} WHEN 3 THEN {_hex_int("b", 25, 48)} ELSE 0 END AS dst,
         CASE lco WHEN 0 THEN 'group' WHEN 3 THEN 'unit_to_unit' ELSE printf('unknown_0x%02X', lco) END AS call_type FROM f""",
)
def _(v):
    df = v.payload.select("seq", B.hex_to_bits(_lc_hex()).alias("b"))
    df = df.select("seq", F.inline(F.array(payload.p25_link_control(F.col("b")))))
    return df.select("seq", "lco", "mfid", "lc_info", "emergency", "reserved", "src", "dst", "call_type")


@query(
    "prj14_nxdn_layer3",
    f"""h AS (SELECT seq, {_L3} AS h FROM v_payload),
       b AS (SELECT seq, h, {_bits("h")} AS b, length(h) * 4 AS n FROM h),
       f AS (SELECT *, {_hex_int("b", 3, 8)} AS m FROM b),
       g AS (SELECT *, m IN (1, 7, 8, 17) AND n >= 64 AS is_call, m = 63 AND n >= 40 AND substr(h, 3, 6) = '688204' AS is_alias FROM f)
       SELECT seq, m AS message_type, CASE WHEN is_alias THEN 'PROP_ALIAS' ELSE
           {_case("m", L.NXDN_MESSAGES, "'UNKNOWN'")} END AS message_name, h AS payload_hex,
         CASE WHEN is_call THEN {_hex_int("b", 25, 40)} ELSE 0 END AS src,
         CASE WHEN is_call THEN {_hex_int("b", 41, 56)} ELSE 0 END AS dst,
         CASE WHEN is_call THEN {_hex_int("b", 17, 19)} END AS call_type_code,
         CASE WHEN is_call THEN substr(b, 9, 1) = '1' END AS emergency,
         CASE WHEN is_call THEN substr(b, 20, 1) = '1' END AS duplex,
         CASE WHEN is_call THEN {_hex_int("b", 22, 24)} END AS transmission_mode,
         CASE WHEN is_alias THEN {_hex_int("b", 33, 36)} END AS alias_segment,
         CASE WHEN is_alias THEN concat_ws(',', {_hex_int("b", 41, 48)}, {_hex_int("b", 49, 56)}, {_hex_int("b", 57, 64)},
           {_hex_int("b", 65, 72)}) END AS alias_bytes,
         CASE WHEN m IN (24, 25, 26, 27) THEN {_hex_int("b", 9, 32)} END AS location_id FROM g""",
)
def _(v):
    df = v.payload.select("seq", B.hex_to_bits(_l3_hex()).alias("b"))
    df = df.select("seq", F.inline(F.array(payload.nxdn_layer3(F.col("b")))))
    names = [
        "message_type", "message_name", "payload_hex", "src", "dst", "call_type_code", "emergency", "duplex",
        "transmission_mode", "alias_segment", "location_id",
    ]
    joined = F.when(
        F.col("alias_bytes").isNotNull(), F.concat_ws(",", F.col("alias_bytes").cast("array<string>"))
    )
    return df.select("seq", *names, joined.alias("alias_bytes"))


@query(
    "prj15_bit_conversions",
    f"""b AS (SELECT seq, hex, {_bits("hex")} AS b, k FROM v_payload)
       SELECT seq, {_hex_int("b", 1, 24)} AS msb_int, lpad(bin(k), 12, '0') AS fixed_bits, b AS bits,
         hex AS hex_text, substr(hex, 1, 2) || printf('%X', {_hex_int("b", 9, 10)} * 4) AS padded_hex,
         array_to_string(list_transform(range(1, 32, 2), lambda i: CAST(('0b' || substr(b, i, 2)) AS BIGINT)), '') AS dibits
       FROM b""",
)
def _(v):
    b = B.hex_to_bits(F.col("hex"))
    dibits = B.bits_to_dibits(F.substring("bits", 1, 32))
    return v.payload.select("seq", "k", b.alias("bits")).select(
        "seq",
        B.bit_field(F.col("bits"), 1, 24).alias("msb_int"),
        B.int_to_bits(F.col("k"), 12).alias("fixed_bits"),
        B.dibits_to_bits(B.bits_to_dibits(F.col("bits"))).alias("bits"),
        B.bits_to_hex(F.col("bits")).alias("hex_text"),
        B.bits_to_hex(F.substring("bits", 1, 10)).alias("padded_hex"),
        dibits.alias("dibits"),
    )


@query(
    "prj16_air_id",
    """v AS (SELECT seq, CAST(('0x' || substr(hex, 1, 6)) AS BIGINT) AS x FROM v_payload)
       SELECT seq, array_to_string(list_transform(range(6, -1, -1), lambda p: CASE
         WHEN p = 6 THEN CASE WHEN x // 1771561 = 10 THEN '*' ELSE CAST(x // 1771561 AS STRING) END
         WHEN (x // CAST(pow(11, p) AS BIGINT)) % 11 = 10 THEN '*'
         ELSE CAST((x // CAST(pow(11, p) AS BIGINT)) % 11 AS STRING) END), '') AS air_id FROM v""",
)
def _(v):
    x = F.conv(F.substring("hex", 1, 6), 16, 10).cast("bigint")
    return v.payload.select("seq", L.dpmr_air_id(x).alias("air_id"))


_WORDS = [int(h, 16) for h in L.DPMR_CHANNEL_CODES]


@query(
    "prj17_color_code",
    f"""SELECT seq, CASE WHEN k % 10 = 0 THEN -1 ELSE k % 64 END AS color_code FROM v_payload""",
)
def _(v):
    # a word with random even bits set; one in ten is no valid word
    words = F.array(*[F.lit(w) for w in _WORDS])
    word = F.get(words, (F.col("k") % 64).cast("int"))
    noise = F.conv(F.substring("hex", 1, 6), 16, 10).cast("bigint").bitwiseAND(0x555555)
    code = F.when(F.col("k") % 10 == 0, F.lit(0)).otherwise(
        word.bitwiseAND(0xAAAAAA).bitwiseOR(noise.cast("int"))
    )
    return v.payload.select("seq", L.dpmr_color_code(code).alias("color_code"))


@query(
    "prj18_stream_position",
    """w AS (SELECT *, start_sample AS w0, end_sample AS w1 FROM v_chunks),
       p AS (SELECT seq, w0, w1, CASE WHEN k % 4 = 0 THEN NULL ELSE k * 30 END AS fs,
         CASE WHEN k % 3 = 0 THEN NULL ELSE k * 20 END AS ss, CASE WHEN k % 5 = 0 THEN NULL ELSE k / 1000 END AS ts FROM w),
       s AS (SELECT *, coalesce(fs / 48000, ss / 48000, ts, 0) AS sec, CASE WHEN fs IS NOT NULL THEN 'extra.fs_start'
         WHEN ss IS NOT NULL THEN 'extra.start_sample' WHEN ts IS NOT NULL THEN 'extra.start_time_s'
         ELSE 'window_start_fallback' END AS position_basis FROM p)
       SELECT seq, position_basis, least(w1 - 1, w0 + CAST(round(sec * 48000) AS BIGINT)) AS source_sample,
         round(least(w1 - 1, w0 + CAST(round(sec * 48000) AS BIGINT)) / 48000, 6) AS source_time_sec FROM s""",
)
def _(v):
    k = F.col("k")
    df = v.chunks.select(
        "seq", "sample_rate_hz", F.lit("DMR").alias("protocol"), F.lit(1).alias("epoch_id"),
        F.col("start_sample").alias("window_start_sample"), F.col("end_sample").alias("window_end_sample"),
        F.struct(
            F.when(k % 4 != 0, k * 30).alias("fs_start"),
            F.when(k % 3 != 0, k * 20).alias("start_sample"),
            F.when(k % 5 != 0, k / 1000).alias("start_time_s"),
        ).alias("extra"),
    )
    s = "extra.stream."
    return C.stamp_positions(df).select(
        "seq",
        F.col(s + "position_basis").alias("position_basis"),
        F.col(s + "source_sample").alias("source_sample"),
        R6(s + "source_time_sec").alias("source_time_sec"),
    )


@query(
    "prj19_native_position",
    """SELECT seq, seq * 480 + 7 AS source_sample, round((seq * 480 + 7) / 48000, 6) AS source_time_sec,
         'native_incremental_state' AS position_basis FROM v_pdus""",
)
def _(v):
    pdus = v.pdus.select(
        "seq", "channel_id", F.lit("DMR").alias("protocol"), F.lit(1).alias("epoch_id"),
        F.lit(48000.0).alias("sample_rate_hz"), F.struct("fs_start").alias("extra"),
    )
    samples = v.table("events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") * 480 + 7).alias("source_sample")
    )
    return C.stamp_native_positions(pdus, samples, ["seq"]).select(
        "seq",
        F.col("extra.stream.source_sample").alias("source_sample"),
        R6("extra.stream.source_time_sec").alias("source_time_sec"),
        F.col("extra.stream.position_basis").alias("position_basis"),
    )


@query(
    "prj20_wideband_position",
    """t AS (SELECT c_custkey AS track_id, c_custkey * 100 AS o0, c_custkey * 1000 AS w0, 20.5e0 AS per FROM customer)
       SELECT seq, track_id, greatest(0, CAST(round(w0 + (fs_start - o0) * per) AS BIGINT)) AS source_sample,
         round(w0 + (fs_start - o0) * per, 6) AS source_sample_exact
       FROM v_pdus JOIN t ON track_id = seq % 150""",
)
def _(v):
    c = F.col("c_custkey")
    tracks = v.table("customer").select(
        c.alias("track_id"), (c * 100).alias("mapping_output_start"), (c * 1000).alias("mapping_wideband_sample"),
        F.lit(20.5).alias("samples_per_output"), (F.lit(4e8) + c).alias("center_frequency_hz"),
        c.cast("double").alias("frequency_offset_hz"), c.cast("int").alias("coarse_bin"),
        c.cast("double").alias("coarse_center_offset_hz"),
    )
    pdus = v.pdus.select(
        "seq",
        (F.col("seq") % 150).alias("track_id"),
        F.struct(F.struct(F.col("fs_start").alias("source_sample")).alias("stream")).alias("extra"),
    )
    w = "extra.wideband."
    return C.stamp_wideband(pdus, tracks, ["track_id"]).select(
        "seq",
        "track_id",
        F.col(w + "source_sample").alias("source_sample"),
        R6(w + "source_sample_exact").alias("source_sample_exact"),
    )


@query(
    "prj21_tuned_metadata",
    """SELECT seq, channel_id, 4e8 + coalesce(fo_hz, 0) AS target_frequency_hz, fs_start * 20 AS wideband_sample,
         20 AS decimation_factor FROM v_pdus""",
)
def _(v):
    df = v.pdus.select(
        "seq", "channel_id", F.lit(4e8).alias("input_center_hz"), F.coalesce("fo_hz", F.lit(0.0)).alias("offset_hz"),
        F.lit(2.4e6).alias("input_rate_hz"), F.lit(1.2e5).alias("baseband_rate_hz"), F.lit(20).alias("decimation"),
        F.struct(F.struct(F.col("fs_start").alias("source_sample")).alias("stream")).alias("extra"),
    )
    t = "extra.tuned."
    return C.stamp_tuned(df, streaming=True).select(
        "seq",
        F.col(t + "channel_id").alias("channel_id"),
        F.col(t + "target_frequency_hz").alias("target_frequency_hz"),
        F.col(t + "wideband_source_sample_approx").alias("wideband_sample"),
        F.col(t + "decimation_factor").alias("decimation_factor"),
    )


@query(
    "prj22_absolute_bits",
    """SELECT seq, CASE WHEN slot_start_bit IS NOT NULL THEN CAST(round(rel * 36000) AS BIGINT) + 1 END AS slot_start_bit,
         slot_start_bit AS window_relative_slot_start_bit, CAST(round(rel * 36000) AS BIGINT) + 1 AS start_bit,
         round(2.5e0 + greatest(0, start_bit - 1) / 36000, 6) AS bit_time_s
       FROM (SELECT *, start_time_s - 1704067200 AS rel FROM v_pdus_tetra)""",
)
def _(v):
    df = v.pdus_tetra.withColumn("start_time_s", F.col("start_time_s") - 1704067200)
    out = C.to_absolute_bits(df.select("seq", F.struct("slot_start_bit", "start_bit", "start_time_s").alias("extra")))
    return out.select(
        "seq",
        F.col("extra.slot_start_bit").alias("slot_start_bit"),
        F.col("extra.window_relative_slot_start_bit").alias("window_relative_slot_start_bit"),
        F.col("extra.start_bit").alias("start_bit"),
        R6(C.time_of_bit(F.col("extra.window_relative_start_bit"), F.lit(2.5))).alias("bit_time_s"),
    )


@query(
    "prj23_bounded_diagnostics",
    """SELECT doc_id, CAST(length(text) > 256 AS BIGINT) + CAST(n_chars % 32 + 1 > 16 AS BIGINT) AS omitted,
         length(text) <= 256 AS has_text, n_chars % 32 + 1 <= 16 AS has_levels, lang FROM documents""",
)
def _(v):
    d = v.table("documents")
    diag = F.to_json(
        F.struct(
            "doc_id", "text",
            F.struct("lang", F.sequence(F.lit(0), (F.col("n_chars") % 32).cast("int")).alias("levels")).alias("nested"),
        )
    )
    out = d.select("doc_id", C.bounded_diagnostics(diag).alias("j"))
    shape = "text string, nested struct<lang string, levels array<int>>, streamOmittedValueCount bigint"
    j = F.from_json("j", shape)
    return out.select("doc_id", j.alias("j")).select(
        "doc_id",
        F.col("j.streamOmittedValueCount").alias("omitted"),
        F.col("j.text").isNotNull().alias("has_text"),
        F.col("j.nested.levels").isNotNull().alias("has_levels"),
        F.col("j.nested.lang").alias("lang"),
    )


@query(
    "prj24_chunk_contract",
    """SELECT seq, concat_ws(',', CASE WHEN k % 20 = 3 THEN 'sample_rate' END, CASE WHEN end_sample < s THEN 'sample_range' END,
         CASE WHEN end_sample >= s AND end_sample - s <> 4800 THEN 'sample_count' END,
         CASE WHEN k % 30 = 4 THEN 'discontinuity' END) AS violations
       FROM (SELECT *, CASE WHEN k % 40 = 5 THEN start_sample + 9000 ELSE start_sample END AS s FROM v_chunks)""",
)
def _(v):
    k = F.col("k")
    df = v.chunks.withColumns(
        {
            "sample_rate_hz": F.when(k % 20 == 3, F.lit(float("nan"))).otherwise(F.col("sample_rate_hz")),
            "discontinuity": F.when(k % 30 != 4, F.col("discontinuity")),
            "start_sample": F.when(k % 40 == 5, F.col("start_sample") + 9000).otherwise(F.col("start_sample")),
            "sample_count": F.lit(4800),
        }
    )
    return C.chunk_violations(df).select("seq", F.concat_ws(",", "violations").alias("violations"))


@query(
    "prj25_decimated_rate",
    """r AS (SELECT o_orderkey, (o_orderkey % 400 + 1) * 16000e0 AS r FROM orders),
       c AS (SELECT o_orderkey, min(i) AS i FROM r, (VALUES (0, 125000e0), (1, 120000e0), (2, 128000e0)) AS t(i, c)
         WHERE abs(r / c - round(r / c)) < 1e-9 GROUP BY 1),
       o AS (SELECT r.o_orderkey, r, abs(r / 120000 - round(r / 120000)) > 1e-9 AS adapted,
         CASE i WHEN 0 THEN 125000e0 WHEN 1 THEN 120000e0 WHEN 2 THEN 128000e0 END AS c FROM r LEFT JOIN c ON c.o_orderkey = r.o_orderkey)
       SELECT o_orderkey, adapted, CASE WHEN adapted THEN c ELSE 120000e0 END AS output_rate_hz,
         CAST(round(r / CASE WHEN adapted THEN c ELSE 120000e0 END) AS BIGINT) AS decimation FROM o""",
)
def _(v):
    df = v.table("orders").select("o_orderkey", ((F.col("o_orderkey") % 400 + 1) * 16000.0).alias("input_rate_hz"))
    return C.decimated_rate(df).select("o_orderkey", "adapted", "output_rate_hz", "decimation")
