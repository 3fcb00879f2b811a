"""Code-to-name lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.registry import literal_map

# DMR full link control opcodes
DMR_FLCO = {
    0: "GroupVoiceChannelUser",
    3: "UnitToUnitVoiceChannelUser",
    4: "TalkerAliasHeader",
    5: "TalkerAliasBlock1",
    6: "TalkerAliasBlock2",
    7: "TalkerAliasBlock3",
    8: "GPSInfo",
    48: "TerminatorDataLinkControl",
}
# DMR feature set ids
DMR_FID = {0: "StandardizedFID", 128: "ReservedForFutureMFID"}
# NXDN layer-3 message types
NXDN_MESSAGES = {
    0: "CALL_RESP", 1: "VCALL", 2: "VCALL_REC_REQ", 3: "VCALL_IV", 4: "VCALL_ASSGN",
    5: "VCALL_ASSGN_DUP", 6: "CALL_CONN_RESP", 7: "TX_REL_EX", 8: "TX_REL", 9: "DCALL_HEADER",
    10: "DCALL_REC_REQ", 11: "DCALL_DATA", 12: "DCALL_ACK", 13: "DCALL_ASSGN_DUP",
    14: "DCALL_ASSGN", 15: "HEAD_DLY", 16: "IDLE", 17: "DISC", 23: "DST_ID_INFO",
    24: "SITE_INFO", 25: "SRV_INFO", 26: "CCH_INFO", 27: "ADJ_SITE_INFO", 28: "FAIL_STAT_INFO",
    32: "REG_RESP", 34: "REG_C_RESP", 35: "REG_COMM", 36: "GRP_REG_RESP", 40: "AUTH_INQ_REQ",
    41: "AUTH_INQ_RESP", 42: "AUTH_INQ_REQ2", 43: "AUTH_INQ_RESP2", 48: "STAT_INQ_REQ",
    49: "STAT_INQ_RESP", 50: "STAT_REQ", 51: "STAT_RESP", 52: "REM_CON_REQ", 53: "REM_CON_RESP",
    54: "REM_CON_E_REQ", 55: "REM_CON_E_RESP", 56: "SDCALL_REQ_HEADER", 57: "SDCALL_REQ_DATA",
    58: "SDCALL_IV", 59: "SDCALL_RESP", 63: "PROP_FORM",
}
# NXDN call types 0..7
NXDN_CALL_TYPES = [
    "broadcast", "conference_group", "unspecified", "reserved",
    "individual", "reserved", "interconnect", "speed_dial",
]
# P25 data unit ids -> type, category, voice, control, terminator, link control
P25_FRAMES = {
    0: ("P25_HDU", "header", False, False, False, False),
    3: ("P25_TDU", "terminator", False, False, True, False),
    5: ("P25_LDU1", "voice", True, False, False, True),
    7: ("P25_TSBK", "trunking_control", False, True, False, False),
    10: ("P25_LDU2", "voice", True, False, False, False),
    12: ("P25_PDU", "packet_data", False, True, False, False),
    15: ("P25_TDULC", "terminator", False, False, True, True),
}
# dPMR channel codes of colour 0..63 (after setting every odd bit)
DPMR_CHANNEL_CODES = """
    575F77 577577 57DD75 57F775 55577D 557D7D 55D57F 55FF7F
    5F555F 5F7F5F 5FD75D 5FFD5D 5D5D55 5D7755 5DDF57 5DF557
    775DD7 7777D7 77DFD5 77F5D5 7555DD 757FDD 75D7DF 75FDDF
    7F57FF 7F7DFF 7FD5FD 7FFFFD 7D5FF5 7D75F5 7DDDF7 7DF7F7
    D755F7 D77FF7 D7D7F5 D7FDF5 D55DFD D577FD D5DFFF D5F5FF
    DF5FDF DF75DF DFDDDD DFF7DD DD57D5 DD7DD5 DDD5D7 DDFFD7
    F75757 F77D57 F7D555 F7FF55 F55F5D F5755D F5DD5F F5F75F
    FF5D7F FF777F FFDF7D FFF57D FD5575 FD7F75 FDD777 FDFD77
""".split()
DPMR_CODE_MASK = 0x555555


def _named(col: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(literal_map(names), col.cast("int"))


def hex_text(col: Column, digits: int) -> Column:
    return F.format_string(f"%0{digits}X", col.cast("bigint"))


def dmr_flco_name(col: Column) -> Column:
    return F.coalesce(_named(col, DMR_FLCO), F.concat(F.lit("UNKNOWN_0x"), hex_text(col, 2)))


def dmr_fid_name(col: Column) -> Column:
    return F.coalesce(_named(col, DMR_FID), F.concat(F.lit("FID_0x"), hex_text(col, 2)))


def nxdn_message_name(col: Column) -> Column:
    return F.coalesce(_named(col, NXDN_MESSAGES), F.lit("UNKNOWN"))


def nxdn_call_type(col: Column) -> Column:
    return F.coalesce(_named(col, dict(enumerate(NXDN_CALL_TYPES))), F.lit("unknown"))


def dmr_call_type(flco_name: Column) -> Column:
    """Call type implied by a link control name, '' when none is."""
    return (
        F.when(flco_name == "GroupVoiceChannelUser", "group")
        .when(flco_name == "UnitToUnitVoiceChannelUser", "unit_to_unit")
        .otherwise("")
    )


def p25_frame(duid: Column) -> Column:
    """Frame attributes of a data unit id."""

    def attribute(i: int, other: Column) -> Column:
        return F.coalesce(_named(duid, {d: v[i] for d, v in P25_FRAMES.items()}), other)

    no = F.lit(False)
    return F.struct(
        attribute(0, F.concat(F.lit("P25_UNKNOWN_0x"), F.format_string("%X", duid.cast("bigint")))).alias("pdu_type"),
        attribute(1, F.lit("unknown")).alias("category"),
        attribute(2, no).alias("is_voice"),
        attribute(3, no).alias("is_control"),
        attribute(4, no).alias("is_terminator"),
        attribute(5, no).alias("has_link_control"),
    )


def nxdn_lich(lich: Column) -> Column:
    """Channel attributes packed in a LICH byte: rf(2) function(2) option(2) direction(1)."""
    v = lich.cast("int")
    rf = F.shiftright(v, 5).bitwiseAND(3)
    fc = F.shiftright(v, 3).bitwiseAND(3)
    op = F.shiftright(v, 1).bitwiseAND(3)
    direction = v.bitwiseAND(1)
    control = rf == 0
    sacch = ~control & (fc != 1)
    typed = ~control & fc.isin(0, 2)
    cac = (
        F.when((direction == 1) & (fc == 0), "CAC_OUTBOUND")
        .when((direction == 0) & (fc == 1), "CAC_LONG_INBOUND")
        .when((direction == 0) & (fc == 3), "CAC_SHORT_INBOUND")
        .otherwise("CAC_RESERVED")
    )
    channel = (
        F.when(control, cac)
        .when(fc.isin(0, 2), "SACCH")
        .when(fc == 3, "SACCH_IDLE")
        .when(op == 0, "FACCH2")
        .when(op == 3, "UDCH")
        .otherwise("USC_RESERVED")
    )
    first = F.when(~typed, "none").when(op >= 2, "VCH").otherwise("FACCH1")
    second = F.when(~typed, "none").when(op.isin(1, 3), "VCH").otherwise("FACCH1")
    return F.struct(
        rf.alias("rf_channel_code"),
        F.element_at(F.array(*[F.lit(x) for x in ("RCCH", "RTCH", "RDCH", "RTCH_C_OR_TYPE_D")]), rf + 1).alias(
            "rf_channel_type"
        ),
        fc.alias("functional_channel_code"),
        op.alias("option"),
        direction.alias("direction_code"),
        F.when(direction == 0, "inbound").otherwise("outbound").alias("direction"),
        channel.alias("functional_channel"),
        sacch.alias("sacch"),
        (sacch & (fc != 0)).alias("superframe"),
        first.alias("half1_type"),
        second.alias("half2_type"),
        ((first == "VCH") | (second == "VCH")).alias("voice_present"),
        (~channel.isin("CAC_RESERVED", "USC_RESERVED")).alias("supported"),
        (rf == 3).alias("ambiguous_type_d"),
    )


def dpmr_color_code(code: Column) -> Column:
    """Colour of a 24-bit channel code, -1 when it is none of the 64 words."""
    words = {int(h, 16): i for i, h in enumerate(DPMR_CHANNEL_CODES)}
    key = code.cast("bigint").bitwiseOR(F.lit(DPMR_CODE_MASK).cast("bigint")).cast("int")
    return F.coalesce(F.try_element_at(literal_map(words), key), F.lit(-1))


def dpmr_air_id(value: Column) -> Column:
    """24-bit id as seven base-11 digits, ten written '*'."""
    v = value.cast("bigint")
    digits = []
    for power in range(6, -1, -1):
        d = F.floor(v / F.lit(11**power)).cast("bigint")
        if power < 6:
            d = d % 11
        digits.append(F.when(d == 10, "*").otherwise(d.cast("string")))
    return F.concat(*digits)
