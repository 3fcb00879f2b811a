"""Protocol-aware duplicate keys.

Every key is one struct of the same shape, so rows of all protocols can be grouped in one
pass.  Numbers and texts sit in separate slots: the number 1 and the text "1" differ, and
a missing value (null) differs from zero unless the protocol's own default says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.functions.fields import field, has_path, offset_hz, round_half_up
from radiolake.registry import canonical_name

DMR_BUCKET_HZ = 5000.0
P25_BUCKET_SAMPLES = 8640
DPMR_BUCKET_SAMPLES = 3840
TIME_BUCKET_SEC = 0.005

NUMS = 8
TEXTS = 3


def _key(kind: Column | str, src: Column, dst: Column, nums=(), texts=()) -> Column:
    """One key struct; ids go into the number or the text slot they came from."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    nums = [n.cast("bigint") for n in nums] + [F.lit(None).cast("bigint")] * (NUMS - len(nums))
    texts = [t.cast("string") for t in texts] + [F.lit(None).cast("string")] * (TEXTS - len(texts))
    return F.struct(
        kind.alias("kind"),
        src.cast("string").alias("src"),
        dst.cast("string").alias("dst"),
        *[n.alias(f"n{i}") for i, n in enumerate(nums)],
        *[t.alias(f"t{i}") for i, t in enumerate(texts)],
    )


def _ids(df: DataFrame, default: int | None = 0) -> tuple[Column, Column]:
    """Source and destination, numbers marked so that 1 and "1" stay apart."""

    def one(name: str) -> Column:
        num = field(df, f"{name}_num", "bigint")
        text = field(df, name, "string")
        other = F.lit(None).cast("string") if default is None else F.lit(f"#{default}")
        return F.coalesce(F.concat(F.lit("#"), num.cast("string")), text, other)

    return one("src"), one("dst")


def _type(df: DataFrame) -> Column:
    return field(df, "type", "string", "")


def dmr_key(df: DataFrame) -> Column:
    src, dst = _ids(df)
    fo = F.coalesce(offset_hz(df), F.lit(0.0))
    bucket = round_half_up(fo / DMR_BUCKET_HZ) * int(DMR_BUCKET_HZ)
    proto = field(df, "protocol", "string", "DMR")
    proto = F.when(F.upper(proto) == "DMR", "DMR").otherwise(proto)
    return _key(proto, src, dst, [bucket], [_type(df)])


def p25_key(df: DataFrame) -> Column:
    src, dst = _ids(df)
    typ, flco = _type(df), field(df, "flco", "string", "")

    def num(name: str, default=None) -> Column:
        return field(df, f"extra.{name}", "bigint", default)

    def any_of(*names: str) -> Column:
        present = [field(df, f"extra.{n}", "string") for n in names]
        return F.coalesce(*present).isNotNull()

    nac = num("nac")
    none = F.lit(None).cast("string")
    ldu1_dst = F.when((dst == "#0") | (dst == ""), F.concat(F.lit("#"), num("tgid", 0).cast("string"))).otherwise(dst)
    hdu_tgid = F.coalesce(F.concat(F.lit("#"), num("hdu_tgid").cast("string")), dst)
    bucket = round_half_up(field(df, "extra.fs_start", "double", 0) / P25_BUCKET_SAMPLES)
    return (
        F.when(typ == "P25_CALL", _key("P25:CALL", src, dst, [nac], [flco]))
        .when(
            (typ == "P25_HDU") & any_of("mi", "hdu_mfid", "algid", "kid", "hdu_tgid"),
            _key("P25:HDU", none, hdu_tgid, [nac, num("mi"), num("hdu_mfid"), num("algid"), num("kid")]),
        )
        .when(
            (typ == "P25_LDU1") & any_of("lco", "mfid", "call_type", "lc_info"),
            _key(
                "P25:LDU1", src, ldu1_dst, [nac, num("lco"), num("mfid"), num("lc_info")],
                [field(df, "extra.call_type", "string", "")],
            ),
        )
        .when(
            (typ == "P25_LDU2") & any_of("es_mi", "es_algid", "es_kid"),
            _key("P25:LDU2", none, none, [nac, num("es_mi"), num("es_algid"), num("es_kid")]),
        )
        .otherwise(_key("P25", none, none, [nac, bucket], [typ]))
    )


CCH_FIELDS = ("frame_number", "id_half", "communication_mode", "comms_format", "emergency_priority")


def cch_signature(df: DataFrame) -> Column:
    """Text of the identifying fields of each control-channel record; null without records."""
    if not has_path(df.schema, "extra.cch") or not isinstance(df.select("extra.cch").schema[0].dataType, T.ArrayType):
        return F.lit(None).cast("string")
    records = F.col("extra.cch")
    one = F.transform(records, lambda r: F.to_json(F.struct(*[r[f].alias(f) for f in CCH_FIELDS])))
    return F.when(F.size(records) > 0, F.concat_ws("|", one))


def dpmr_key(df: DataFrame) -> Column:
    typ = _type(df)

    def known(name: str) -> Column:
        num, text = field(df, f"{name}_num", "bigint"), field(df, name, "string")
        text = F.when(F.length(text) > 0, text)
        number = F.when(num != 0, F.concat(F.lit("#"), num.cast("string")))
        return F.coalesce(number, F.when(num.isNull(), text), F.lit(""))

    src, dst = known("src"), known("dst")
    color = field(df, "extra.color_code", "bigint")
    sync = field(df, "extra.sync_type", "string", "")
    none = F.lit(None).cast("string")

    def listed(name: str) -> Column:
        if not has_path(df.schema, f"extra.{name}"):
            return F.lit("[]")
        return F.coalesce(F.to_json(F.col(f"extra.{name}")), F.lit("[]"))

    signature = cch_signature(df)
    bucket = round_half_up(field(df, "extra.fs_start", "double", 0) / DPMR_BUCKET_SAMPLES)
    return (
        F.when(
            typ == "dPMR_CALL",
            _key(
                "dPMR:CALL", src, dst, [color],
                [field(df, "flco", "string", ""), listed("communication_modes"), listed("comms_formats")],
            ),
        )
        .when((src != "") | (dst != ""), _key("dPMR:ADDRESSED", src, dst, [color], [typ, sync]))
        .when(signature.isNotNull(), _key("dPMR:CCH", none, none, [color], [typ, sync, signature]))
        .otherwise(_key("dPMR", none, none, [color, bucket], [typ, sync]))
    )


def nxdn_key(df: DataFrame) -> Column:
    src, dst = _ids(df)
    typ, ran = _type(df), field(df, "extra.ran", "bigint")
    call = _key(
        "NXDN:CALL", src, dst, [ran, field(df, "extra.start_sample", "bigint")], [field(df, "flco", "string", "")]
    )
    other = _key("NXDN", src, dst, [ran], [typ, field(df, "extra.payload_hex", "string", "")])
    return F.when(typ == "NXDN_CALL", call).otherwise(other)


def tetra_key(df: DataFrame) -> Column:
    src, dst = _ids(df)
    typ = _type(df)
    slot_bit, bit = field(df, "extra.slot_start_bit", "bigint"), field(df, "extra.start_bit", "bigint")
    start = F.coalesce(slot_bit, bit, F.lit(0))
    session = _key("TETRA:SESSION", src, dst, [F.coalesce(bit, start)], [typ])
    event = _key(
        "TETRA", src, dst,
        [start, field(df, "extra.frame_number", "bigint"), field(df, "extra.slot_number", "bigint")],
        [typ, field(df, "extra.block_name", "string", ""), field(df, "flco", "string", "")],
    )
    return F.when(typ == "TETRA_SESSION", session).otherwise(event)


def dedup_key(df: DataFrame) -> Column:
    """The key of whatever protocol a row has; unknown protocols use the DMR key."""
    name = canonical_name(field(df, "protocol", "string", "DMR"))
    return (
        F.when(name == "P25", p25_key(df))
        .when(name == "dPMR", dpmr_key(df))
        .when(name == "NXDN", nxdn_key(df))
        .when(name == "TETRA", tetra_key(df))
        .otherwise(dmr_key(df))
    )


def scan_key(df: DataFrame) -> Column:
    """Key across overlapping scan windows: identity plus a 5 ms time bucket."""
    src, dst = _ids(df)
    start = field(df, "extra.start_time_s", "double")
    start = F.when(~F.isnan(start), start)
    sec = F.coalesce(start, field(df, "extra.end_time_s", "double"), F.lit(0.0))
    return _key(
        F.concat(F.lit("SCAN:"), _type(df)), src, dst, [round_half_up(sec / TIME_BUCKET_SEC)],
        [
            field(df, "flco", "string", ""),
            field(df, "extra.logical_channel", "string", ""),
            field(df, "extra.block_name", "string", ""),
        ],
    )


def is_persistent(df: DataFrame, semantic: bool = True) -> Column:
    """Rows that are reported once per epoch, however long it lasts."""
    typ = F.upper(_type(df))
    return F.lit(semantic) & (typ.contains("CALL") | typ.contains("SESSION"))


def stream_key(df: DataFrame, semantic: bool = True, key: Column | None = None) -> Column:
    """Ledger key of a live stream: the semantic key, plus a 5 ms sample bucket for rows
    that are not persistent.  Needs ``sample_rate_hz``."""
    persistent = is_persistent(df, semantic)
    width = F.greatest(F.lit(1).cast("bigint"), round_half_up(F.lit(TIME_BUCKET_SEC) * F.col("sample_rate_hz")))
    sample = field(df, "extra.stream.source_sample", "double", 0)
    return F.struct(
        persistent.alias("persistent"),
        (dedup_key(df) if key is None else key).alias("key"),
        F.when(~persistent, round_half_up(sample / width)).alias("bucket"),
    )
