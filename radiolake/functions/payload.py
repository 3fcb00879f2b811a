"""Fixed-position fields of link-control and layer-3 payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.functions.bits import bit_field, bits_to_hex
from radiolake.functions.lookups import (
    dmr_fid_name,
    dmr_flco_name,
    hex_text,
    nxdn_call_type,
    nxdn_message_name,
)


def dmr_full_link_control(bits: Column) -> Column:
    """Opcode, feature set and addresses of a 72-bit full link control; null when shorter."""
    flco, fid = bit_field(bits, 3, 8), bit_field(bits, 9, 16)
    addressed = flco.isin(0, 3)
    zero = F.lit(0).cast("bigint")
    return F.when(
        F.length(bits) >= 72,
        F.struct(
            flco.alias("flco"),
            dmr_flco_name(flco).alias("flco_name"),
            fid.alias("fid"),
            dmr_fid_name(fid).alias("fid_name"),
            F.when(addressed, bit_field(bits, 49, 72)).otherwise(zero).alias("src"),
            F.when(addressed, bit_field(bits, 25, 48)).otherwise(zero).alias("dst"),
        ),
    )


def p25_link_control(bits: Column) -> Column:
    """Fields of a 72-bit link control word; group, unit-to-unit and unknown layouts."""
    lco = bit_field(bits, 1, 8)
    octet2, info = bit_field(bits, 17, 24), bit_field(bits, 17, 32)
    group, unit = lco == 0, lco == 3
    zero = F.lit(0).cast("bigint")
    tgid = F.when(group, bit_field(bits, 33, 48)).otherwise(zero)
    return F.when(
        F.length(bits) == 72,
        F.struct(
            lco.alias("lco"),
            bit_field(bits, 9, 16).alias("mfid"),
            octet2.alias("svc"),
            info.alias("lc_info"),
            octet2.alias("octet2"),
            bit_field(bits, 25, 32).alias("octet3"),
            F.when(group, bit_field(bits, 17, 17) == 1).alias("emergency"),
            F.when(group, bit_field(bits, 18, 32)).when(unit, octet2).otherwise(info).alias("reserved"),
            F.when(group, 15).when(unit, 8).otherwise(16).alias("reserved_bits"),
            F.when(group | unit, bit_field(bits, 49, 72)).otherwise(zero).alias("src"),
            F.when(group, tgid).when(unit, bit_field(bits, 25, 48)).otherwise(zero).alias("dst"),
            tgid.alias("tgid"),
            group.alias("is_group"),
            F.when(group, "group")
            .when(unit, "unit_to_unit")
            .otherwise(F.concat(F.lit("unknown_0x"), hex_text(lco, 2)))
            .alias("call_type"),
        ),
    )


# Message types that carry a call, a proprietary form, site information
CALL_MESSAGES = (1, 7, 8, 17)
SITE_MESSAGES = (24, 25, 26, 27)
ALIAS_MFID, ALIAS_FORM = 0x68, 0x8204


def nxdn_layer3(bits: Column) -> Column:
    """Fields of an NXDN layer-3 message; fields another message type uses are null."""
    n = F.length(bits)
    kind = bit_field(bits, 3, 8)
    is_call = kind.isin(*CALL_MESSAGES) & (n >= 64)
    is_form = (kind == 63) & (n >= 40)
    is_site = kind.isin(*SITE_MESSAGES) & (n >= 32)

    def call(a: int, b: int) -> Column:
        return F.when(is_call, bit_field(bits, a, b))

    mfid = F.when(is_form, bit_field(bits, 9, 16))
    form = F.when(is_form, bit_field(bits, 17, 32))
    is_alias = F.coalesce((mfid == ALIAS_MFID) & (form == ALIAS_FORM), F.lit(False))
    name = F.when(is_alias, "PROP_ALIAS").otherwise(nxdn_message_name(kind))
    option, voice = call(9, 16), call(20, 24)
    byte_count = F.least(F.lit(4), F.floor((n - 40) / 8).cast("int"))
    alias_bytes = F.when(
        is_alias,
        F.transform(
            F.when(byte_count > 0, F.sequence(F.lit(0), byte_count - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.conv(F.substring(bits, i * 8 + 41, F.lit(8)), 2, 10).cast("bigint"),
        ),
    )
    zero = F.lit(0).cast("bigint")
    return F.when(
        n >= 8,
        F.struct(
            F.when(name == "UNKNOWN", "NXDN_L3_UNKNOWN").otherwise(F.concat(F.lit("NXDN_"), name)).alias("type"),
            F.coalesce(call(25, 40), zero).alias("src"),
            F.coalesce(call(41, 56), zero).alias("dst"),
            kind.alias("message_type"),
            name.alias("message_name"),
            (bit_field(bits, 1, 1) == 1).alias("flag1"),
            (bit_field(bits, 2, 2) == 1).alias("flag2"),
            bits_to_hex(bits).alias("payload_hex"),
            option.alias("cc_option"),
            call(17, 19).alias("call_type_code"),
            F.when(is_call, nxdn_call_type(call(17, 19))).alias("call_type"),
            voice.alias("voice_call_option"),
            (voice.bitwiseAND(16) != 0).alias("duplex"),
            voice.bitwiseAND(7).alias("transmission_mode"),
            call(57, 58).alias("cipher_type"),
            call(59, 64).alias("key_id"),
            (option.bitwiseAND(128) != 0).alias("emergency"),
            (option.bitwiseAND(64) != 0).alias("visitor"),
            (option.bitwiseAND(32) != 0).alias("priority_paging"),
            mfid.alias("mfid"),
            form.alias("proprietary_id"),
            F.when(is_alias, bit_field(bits, 33, 36)).alias("alias_segment"),
            F.when(is_alias, bit_field(bits, 37, 40)).alias("alias_total"),
            alias_bytes.alias("alias_bytes"),
            F.when(is_site, bit_field(bits, 9, 32)).alias("location_id"),
        ),
    )
