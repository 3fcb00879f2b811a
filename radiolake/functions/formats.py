"""One display line per PDU, in the layout of its protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.fields import field, has_path
from radiolake.functions.lookups import hex_text
from radiolake.registry import canonical_name


def number_text(col: Column) -> Column:
    """Up to four decimals, no trailing zeros; whole numbers without a point."""
    v = col.cast("double")
    fixed = F.format_string("%.4f", v)
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "[.]$", "")
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(trimmed)


def fixed_text(col: Column, digits: int, sign: bool = False) -> Column:
    """Fixed decimals of the number a double really holds (a printed 0.0005 may lie below
    the tie); a true tie goes to the even digit."""
    v = col.cast("double")
    size, ten = F.abs(v), 10**digits
    whole = F.floor(size)
    part = F.bround((size - whole) * ten).cast("bigint")
    whole = F.when(part == ten, whole + 1).otherwise(whole).cast("string")
    part = F.lpad((part % ten).cast("string"), digits, "0")
    lead = F.when(v < 0, "-").otherwise("+" if sign else "")
    return F.when(v.isNotNull(), F.concat(lead, whole, F.lit("."), part))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scaled(size: Column, ten: Column) -> Column:
    """Whole number next to ``size`` * ``ten``, by the exact product; a true tie goes to the even one."""

    def halves(x: Column) -> tuple[Column, Column]:
        """Parts of few enough bits that their products are exact."""
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    def rounded(s: Column) -> Column:
        (a, b), (c, d) = (s["ah"], s["al"]), (s["bh"], s["bl"])
        lost = ((a * c - s["p"]) + a * d + b * c) + b * d  # what the product lost by rounding
        whole = F.floor(s["p"])
        rest = s["p"] - whole
        up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
        return whole + up.cast("bigint")

    def split(s: Column) -> Column:
        (a, b), (c, d) = halves(s["x"]), halves(s["t"])
        return F.struct((s["x"] * s["t"]).alias("p"), a.alias("ah"), b.alias("al"), c.alias("bh"), d.alias("bl"))

    return _let(_let(F.struct(size.alias("x"), ten.alias("t")), split), rounded)


def general_text(col: Column) -> Column:
    """Six significant digits of the number a double really holds, as printed by %g (a true tie
    goes to the even digit); whole numbers are printed in full."""
    v = col.cast("double")
    size = F.abs(v)

    def bare(text: Column) -> Column:
        """Without zeros behind the decimal point."""
        return F.regexp_replace(F.regexp_replace(text, "([.][0-9]*?)0+$", "$1"), "[.]$", "")

    def plain(s: Column) -> Column:
        digits, m = s["n"].cast("string"), s["m"]
        digits, m = F.substring(digits, 1, 6), F.when(s["n"] == 10**6, m + 1).otherwise(m)
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -m - 1), digits)
        text = F.when(m < 0, below).otherwise(F.concat(F.substring(digits, F.lit(1), m + 1), F.lit("."), F.substring(digits, m + 2, F.lit(6))))
        power = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.lit("e-"), F.lpad((-m).cast("string"), 2, "0"))
        return F.when(m == 6, "1e+06").when(m < -4, power).otherwise(bare(text))

    m, ten = F.lit(-17), F.lit(1e22)  # the greatest power of ten that a double holds
    for k in range(-16, 6):
        m, ten = F.when(size >= float(f"1e{k}"), k).otherwise(m), F.when(size >= float(f"1e{k}"), float(10 ** (5 - k))).otherwise(ten)
    held = F.struct(_scaled(size, ten).alias("n"), m.alias("m"))
    # fractions above and numbers below that range have no ties at six digits
    long = F.format_string("%.5e", v)
    long = F.concat(bare(F.substring_index(long, "e", 1)), F.lit("e"), F.substring_index(long, "e", -1))
    sign = F.when(v < 0, "-").otherwise("")
    out = F.when((size >= 1e-17) & (size < 1e6), F.concat(sign, _let(held, plain))).otherwise(long)
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.when(v.isNotNull(), out))


def _part(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix + value + suffix, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix)), F.lit(""))



def cch_text(records: Column) -> Column:
    """The control-channel records of a dPMR frame."""

    def num(r: Column, name: str) -> Column:
        return F.coalesce(r[name].cast("string"), F.lit("0"))

    one = F.transform(
        records,
        lambda r: F.concat(
            F.lit("FN="), num(r, "frame_number"),
            F.lit(" IDH=0x"), hex_text(F.coalesce(r["id_half"], F.lit(0)), 3),
            F.lit(" M="), num(r, "communication_mode"), F.lit(" V="), num(r, "version"),
            F.lit(" F="), num(r, "comms_format"), F.lit(" E="), num(r, "emergency_priority"),
            F.lit(" RES="), num(r, "reserved"),
            F.lit(" SLD=0x"), hex_text(F.coalesce(r["slow_data"], F.lit(0)), 5),
        ),
    )
    return F.when(F.size(records) > 0, F.concat(F.lit(" CCH=["), F.concat_ws("; ", one), F.lit("]"))).otherwise("")


def with_line(df: DataFrame) -> DataFrame:
    """Add ``line``; unknown protocols use the DMR layout."""

    def txt(path: str, default: str = "") -> Column:
        return field(df, path, "string", default)

    def num(path: str, default: int = 0) -> Column:
        return field(df, path, "bigint", default).cast("string")

    typ, proto = txt("type"), txt("protocol", "DMR")
    src, dst = txt("src", "0"), txt("dst", "0")
    flco, fid = txt("flco"), txt("fid")
    hz = field(df, "fo_hz", "double")
    fo = F.when(
        hz.isNotNull(), F.concat(F.lit(" (fo="), fixed_text(hz / 1000.0, 1, sign=True), F.lit("kHz)"))
    ).otherwise("")
    seconds = number_text(field(df, "extra.duration_s", "double"))
    head12 = F.format_string("[%-12s]", typ)
    head18 = F.format_string("[%-18s]", typ)
    duration = F.when(
        field(df, "extra.duration_s", "double").isNotNull(),
        F.concat(F.lit(" DUR="), seconds, F.lit("s")),
    ).otherwise("")

    dmr_call = F.concat(
        head12, F.lit(" PROTO=DMR CALL="), F.upper(txt("extra.call_type", "unknown")),
        F.lit(" SRC="), src, F.lit(" DST="), dst,
        _part(" CC=", field(df, "extra.color_code", "bigint")),
        F.lit(" FLCO="), flco, F.lit(" FID="), fid, duration,
        F.lit(" SIG="), num("extra.signalling_count"), F.lit(" LATE="), num("extra.late_entry_count"),
        F.lit(" CSBK="), num("extra.csbk_count"), F.lit(" CLOSED="), txt("extra.closed_by"), fo,
    )
    dmr = F.concat(
        head12, F.lit(" PROTO="), proto, F.lit(" SRC="), src, F.lit(" DST="), dst,
        F.lit(" FLCO="), flco, F.lit(" FID="), fid, fo,
    )

    ran = _part(" RAN=", field(df, "extra.ran", "bigint"))
    nxdn_call = F.concat(
        head18, F.lit(" PROTO=NXDN CALL="), flco, F.lit(" SRC="), src, F.lit(" DST="), dst, ran,
        F.lit(" DUR="), F.coalesce(seconds, F.lit("0")), F.lit("s ALIAS="), txt("extra.alias"), fo,
    )
    nxdn = F.concat(
        head18, F.lit(" PROTO=NXDN CH="), txt("extra.functional_channel"), ran,
        F.lit(" SRC="), src, F.lit(" DST="), dst, F.lit(" MSG="), flco,
        F.lit(" DATA="), txt("extra.payload_hex"), fo,
    )

    def hx(path: str, digits: int) -> Column:
        return F.concat(F.lit("0x"), hex_text(field(df, path, "bigint", 0), digits))

    p25_head = F.concat(head12, F.lit(" PROTO=P25"))
    nac = field(df, "extra.nac", "bigint")
    nac_text = F.when(nac.isNotNull(), F.concat(F.lit(" NAC=0x"), hex_text(nac, 3))).otherwise("")
    duid = field(df, "extra.duid", "bigint")
    detail = F.when(
        duid.isNotNull(),
        F.concat(
            F.lit(" DUID=0x"), F.format_string("%X", duid),
            F.lit(" BCH="), F.when(field(df, "extra.valid_bch", "boolean", False), "OK").otherwise("FAIL"),
            F.lit(" CORR="), field(df, "extra.corrected", "boolean", False).cast("int").cast("string"),
        ),
    ).otherwise("")
    hdu = F.concat(
        p25_head, F.lit(" FRAME=HDU"), nac_text, detail, F.lit(" MI="), hx("extra.mi", 18),
        F.lit(" MFID="), hx("extra.hdu_mfid", 2), F.lit(" ALGID="), hx("extra.algid", 2),
        F.lit(" KID="), hx("extra.kid", 4), F.lit(" TGID="), num("extra.hdu_tgid"), fo,
    )
    call_type = txt("extra.call_type")
    party = (
        F.when(call_type == "group", F.concat(F.lit(" SRC="), src, F.lit(" TGID="), num("extra.tgid")))
        .when(call_type == "unit_to_unit", F.concat(F.lit(" SRC="), src, F.lit(" DEST="), dst))
        .otherwise("")
    )
    ldu1 = F.concat(
        p25_head, F.lit(" FRAME=LDU1"), party, nac_text, detail, F.lit(" LCF="), hx("extra.lco", 2),
        F.lit(" MFID="), hx("extra.mfid", 2), F.lit(" CALL="), call_type,
        F.lit(" LCW16="), hx("extra.lc_info", 4), fo,
    )
    ldu2 = F.concat(
        p25_head, F.lit(" FRAME=LDU2"), nac_text, detail, F.lit(" ES_MI="), hx("extra.es_mi", 18),
        F.lit(" ES_ALGID="), hx("extra.es_algid", 2), F.lit(" ES_KID="), hx("extra.es_kid", 4), fo,
    )
    group = flco == "GROUP"
    p25_call = F.concat(
        p25_head, F.lit(" CALL="), F.when(group, "GROUP").otherwise("UNIT"),
        F.lit(" SRC="), src, F.when(group, " TGID=").otherwise(" DEST="), dst, nac_text, duration,
        _part(" LDUS=", field(df, "extra.ldu_count", "bigint")), fo,
    )
    frame = F.coalesce(field(df, "flco", "string"), txt("extra.duid_name"))
    p25_other = F.concat(p25_head, F.lit(" FRAME="), frame, nac_text, detail, fo)
    p25 = (
        F.when(typ == "P25_HDU", hdu)
        .when(typ == "P25_LDU1", ldu1)
        .when(typ == "P25_LDU2", ldu2)
        .when(typ == "P25_CALL", p25_call)
        .otherwise(p25_other)
    )

    cc = field(df, "extra.color_code", "bigint", -1)
    cc_text = F.when(cc >= 0, F.format_string("%02d", cc)).otherwise("--")
    polarity = F.when(field(df, "extra.polarity_inverted", "boolean", False), "INV").otherwise("NORM")
    cch = cch_text(F.col("extra.cch")) if _is_array(df, "cch") else F.lit("")
    dpmr = F.concat(
        head12, F.lit(" PROTO=dPMR SRC="), txt("src"), F.lit(" DST="), txt("dst"), F.lit(" CC="), cc_text,
        F.lit(" SYNC="), txt("extra.sync_type"), F.lit(" POL="), polarity, cch, fo,
    )

    def listed(name: str) -> Column:
        return F.concat_ws(",", F.col(f"extra.{name}").cast("array<string>")) if _is_array(df, name) else F.lit("")

    dpmr_call = F.concat(
        head12, F.lit(" PROTO=dPMR CALL="), flco, F.lit(" SRC="), txt("src"), F.lit(" DST="), txt("dst"),
        F.lit(" CC="), cc_text, duration, F.lit(" HDR="), num("extra.header_count"),
        F.lit(" VOICE="), num("extra.voice_count"), F.lit(" CCH="), num("extra.cch_count"),
        F.lit(" SYNC="), listed("sync_types"), F.lit(" MODE="), listed("communication_modes"),
        F.lit(" FMT="), listed("comms_formats"), F.lit(" E="), listed("emergency_priorities"),
        F.lit(" CLOSED="), txt("extra.closed_by"), fo,
    )

    return df.withColumn(
        "line",
        F.when(canonical_name(proto) == "NXDN", F.when(typ == "NXDN_CALL", nxdn_call).otherwise(nxdn))
        .when(canonical_name(proto) == "P25", p25)
        .when(canonical_name(proto) == "dPMR", F.when(typ == "dPMR_CALL", dpmr_call).otherwise(dpmr))
        .when(canonical_name(proto) == "TETRA", _tetra(df, head18, fo))
        .otherwise(F.when(typ == "DMR_CALL", dmr_call).otherwise(dmr)),
    )


def _is_array(df: DataFrame, name: str) -> bool:
    extra = df.schema["extra"].dataType if "extra" in df.columns else None
    return extra is not None and name in extra.names and extra[name].dataType.typeName() == "array"


def _tetra(df: DataFrame, head: Column, fo: Column) -> Column:
    def val(path: str, default: str = "") -> Column:
        """Fractions as %g with n/a for NaN, everything else as it is."""
        text = field(df, path, "string")
        if has_path(df.schema, path) and df.select(path).schema[0].dataType.typeName() in ("double", "float"):
            num = field(df, path, "double")
            text = F.when(F.isnan(num), "n/a").when(num.isNotNull(), general_text(num))
        return F.coalesce(text, F.lit(default))

    typ, flco = field(df, "type", "string", ""), field(df, "flco", "string", "")
    fn, tn = field(df, "extra.frame_number", "bigint"), field(df, "extra.slot_number", "bigint")
    timing = F.when(
        fn.isNotNull() & tn.isNotNull(),
        F.concat(F.lit("FN="), fn.cast("string"), F.lit(" TN="), tn.cast("string")),
    ).otherwise("")

    def seconds(path: str) -> Column:
        return fixed_text(field(df, path, "double"), 3)

    t = field(df, "extra.start_time_s", "double")
    time = F.when(t.isNotNull() & ~F.isnan(t), F.concat(F.lit(" T="), seconds("extra.start_time_s"), F.lit("s"))).otherwise("")
    start = F.concat(head, F.lit(" PROTO=TETRA SRC="), val("src", "0"), F.lit(" DST="), val("dst", "0"))
    mni = F.concat(F.lit(" MNI="), val("extra.mni"))

    def flag(prefix: str, path: str) -> Column:
        v = field(df, path, "boolean").cast("int").cast("string")
        return _part(prefix, v)

    sync = F.concat(
        start, mni, F.lit(" "), timing, F.lit(" MSG="), flco, F.lit(" FC="), val("extra.frame_countdown_text"),
        F.lit(" DCC="), val("extra.dcc"), time, fo,
    )
    control = F.concat(
        start, mni, F.lit(" "), timing, F.lit(" LCH="), val("extra.logical_channel"),
        F.lit(" PDU="), val("extra.pdu_name"), F.lit(" MSG="), flco,
        flag(" ST2=", "extra.second_half_slot_stolen"), flag(" NULL=", "extra.null_pdu"), time, fo,
    )
    traffic = F.concat(
        start, mni, F.lit(" "), timing, F.lit(" LCH=TCH SCHF_ERR="), val("extra.schf_block_code_errors"),
        F.lit("/"), val("extra.schf_tail_errors"), F.lit(" STATUS="), val("extra.status"), time, fo,
    )
    dur = field(df, "extra.duration_s", "double")
    session = F.concat(
        start, mni, F.lit(" STATE="), val("extra.state"),
        F.lit(" START="), F.coalesce(seconds("extra.start_time_s"), F.lit("NaN")),
        F.lit("s END="), F.coalesce(seconds("extra.end_time_s"), F.lit("NaN")), F.lit("s"),
        F.when(dur.isNotNull() & ~F.isnan(dur), F.concat(F.lit(" DUR="), seconds("extra.duration_s"), F.lit("s"))).otherwise(""),
        F.lit(" CTRL="), val("extra.control_event_count", "0"), F.lit(" STCH="), val("extra.stch_event_count", "0"),
        F.lit(" TCH="), val("extra.tch_candidate_count", "0"), F.lit(" RELEASE="), val("extra.release_message"), fo,
    )
    other = F.concat(start, F.lit(" "), timing, F.lit(" FLCO="), flco, time, fo)
    return (
        F.when(typ == "TETRA_DMAC_SYNC", sync)
        .when(typ.isin("TETRA_STCH", "TETRA_SCHF"), control)
        .when(typ == "TETRA_TCH_CANDIDATE", traffic)
        .when(typ == "TETRA_SESSION", session)
        .otherwise(other)
    )
