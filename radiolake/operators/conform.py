"""Bringing PDU and chunk rows into shape: defaults, names, positions, metadata, checks."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.functions.fields import field, has_path, offset_hz, round_half_up
from radiolake.registry import PROTOCOLS, canonical_name, default_names, rank, target_rate


def conform_pdus(df: DataFrame) -> DataFrame:
    """Fill the common PDU columns: protocol DMR, empty texts, zero ids, one ``fo_hz``."""
    text = {c: field(df, c, "string", "") for c in ("type", "flco", "fid")}
    proto = field(df, "protocol", "string")
    ids = {}
    for name in ("src", "dst"):
        num = field(df, f"{name}_num", "bigint")
        ids[name] = F.coalesce(field(df, name, "string"), num.cast("string"), F.lit("0"))
        ids[f"{name}_num"] = F.coalesce(num, F.when(ids[name].rlike("^[0-9]+$"), ids[name].cast("bigint")))
    out = df.withColumns(
        {"protocol": F.when(F.length(proto) > 0, proto).otherwise("DMR")}
        | text
        | ids
        | {"ts": field(df, "ts", "bigint"), "fo_hz": offset_hz(df)}
    )
    return out.drop("_fo_hz", "x_fo_hz")


def append_pdus(a: DataFrame, b: DataFrame) -> DataFrame:
    """One set of rows from two; fields only one side has are null on the other."""
    return a.unionByName(b, allowMissingColumns=True)


def add_meta(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn("fo_hz" if name == "_fo_hz" else name, value if isinstance(value, Column) else F.lit(value))


def with_extra(df: DataFrame, **fields: Column) -> DataFrame:
    """Set fields of the ``extra`` struct, keeping the others."""
    if not has_path(df.schema, "extra"):
        return df.withColumn("extra", F.struct(*[v.alias(k) for k, v in fields.items()]))
    extra = F.col("extra")
    for name, value in fields.items():
        extra = extra.withField(name, value)
    return df.withColumn("extra", extra)


def pdu_table(df: DataFrame) -> DataFrame:
    """The columns people scan, ids as text."""
    return df.select(
        "protocol",
        "type",
        F.col("src").cast("string").alias("src"),
        F.col("dst").cast("string").alias("dst"),
        "flco",
        F.col("fo_hz").cast("double").alias("fo_hz"),
    )


def canonical_protocols(df: DataFrame, request: str, position: str, name: str) -> DataFrame:
    """Requested names of each request in canonical spelling: first mention wins, order kept.

    Names no protocol knows come back with a null ``protocol`` so a caller can reject them.
    """
    named = df.withColumn("protocol", canonical_name(F.col(name)))
    w = Window.partitionBy(request, "protocol").orderBy(position)
    return (
        named.withColumn("_rn", F.row_number().over(w))
        .where(F.col("protocol").isNull() | (F.col("_rn") == 1))
        .drop("_rn")
    )


def require_known(df: DataFrame, name: str) -> DataFrame:
    """Fail on a name no protocol knows."""
    message = F.concat(F.lit("Unsupported protocol: "), F.lower(F.col(name)))
    known = F.when(F.col("protocol").isNull(), F.raise_error(message)).otherwise(F.col("protocol"))
    return df.withColumn("protocol", known)


def resolve_protocols(df: DataFrame, mode: str = "mode", explicit: str | None = None) -> DataFrame:
    """Add ``protocols``: the explicit list where one is given, else the mode's default set."""
    names = default_names(F.col(mode))
    if explicit:
        asked = F.filter(F.array_distinct(F.transform(F.col(explicit), canonical_name)), lambda n: n.isNotNull())
        names = F.when(F.size(F.col(explicit)) > 0, asked).otherwise(names)
    return df.withColumn("protocols", names)


def split_by_mode(df: DataFrame, mode: str = "mode", explicit: str = "explicit") -> DataFrame:
    """Split ``protocols`` into narrowband and windowed lists, in registry order.

    Windowed protocols cannot be found by a blind search: they are dropped, and asking for
    one by name is an error.
    """

    def of(scan_mode: str) -> Column:
        members = [p.name for p in PROTOCOLS.values() if p.scan_mode == scan_mode]
        ordered = F.array(*[F.lit(m) for m in members])
        return F.filter(ordered, lambda m: F.array_contains("protocols", m))

    blind = F.col(mode) == "blind"
    windowed = of("windowed_iq")
    refused = blind & F.col(explicit) & (F.size(windowed) > 0)
    return df.withColumns(
        {
            "narrowband": of("narrowband_4fsk"),
            "windowed": F.when(blind, F.array().cast("array<string>")).otherwise(windowed),
            "error": F.when(refused, "windowed protocol in blind search"),
        }
    )


def _finite(col: Column) -> Column:
    bad = F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(col.isNotNull() & ~bad, col)


def stamp_positions(df: DataFrame) -> DataFrame:
    """Absolute sample of each PDU inside its window.

    Needs window_start_sample, window_end_sample, sample_rate_hz and epoch_id.  The first
    finite of frame start, start sample and start time counts; else the window start.
    """
    rate = F.col("sample_rate_hz").cast("double")
    native = target_rate(F.col("protocol"), rate)
    fs = _finite(field(df, "extra.fs_start", "double"))
    start = _finite(field(df, "extra.start_sample", "double"))
    secs = _finite(field(df, "extra.start_time_s", "double"))
    found = F.coalesce(fs / native, start / native, secs, F.lit(0.0))
    local = F.greatest(F.lit(0.0), found)
    basis = (
        F.when(fs.isNotNull(), "extra.fs_start")
        .when(start.isNotNull(), "extra.start_sample")
        .when(secs.isNotNull(), "extra.start_time_s")
        .otherwise("window_start_fallback")
    )
    w0, w1 = F.col("window_start_sample"), F.col("window_end_sample")
    sample = w0 + F.greatest(F.lit(0).cast("bigint"), round_half_up(local * rate))
    sample = F.when(w1 > w0, F.least(sample, w1 - 1)).otherwise(sample)
    return with_extra(
        df,
        stream=F.struct(
            F.col("epoch_id").cast("bigint").alias("epoch_id"),
            sample.alias("source_sample"),
            (sample / rate).alias("source_time_sec"),
            w0.alias("window_start_source_sample"),
            w1.alias("window_end_source_sample"),
            basis.alias("position_basis"),
        ),
    )


def stamp_native_positions(df: DataFrame, samples: DataFrame, on: list[str]) -> DataFrame:
    """Attach absolute samples delivered beside the PDUs, one per PDU.

    A PDU without a sample, or a sample without a PDU, is a count mismatch and fails.
    """
    both = df.withColumn("_pdu", F.lit(True)).join(
        samples.select(*on, F.col("source_sample").alias("_sample")), on, "full"
    )
    mismatch = F.col("_pdu").isNull() | F.col("_sample").isNull()
    sample = F.when(
        mismatch, F.raise_error(F.lit("Native source-sample count must match the PDU count."))
    ).otherwise(F.col("_sample"))
    out = with_extra(
        both,
        stream=F.struct(
            F.col("epoch_id").cast("bigint").alias("epoch_id"),
            sample.cast("bigint").alias("source_sample"),
            (sample / F.col("sample_rate_hz")).alias("source_time_sec"),
            F.lit("native_incremental_state").alias("position_basis"),
            canonical_name(F.col("protocol")).alias("protocol"),
        ),
    )
    return out.drop("_pdu", "_sample")


def stamp_wideband(df: DataFrame, tracks: DataFrame, on: list[str]) -> DataFrame:
    """Map channel samples back to the wideband timeline of the track they came from."""
    t = tracks.select(
        *on,
        F.struct("mapping_output_start", "mapping_wideband_sample", "samples_per_output").alias("_m"),
        F.struct("center_frequency_hz", "frequency_offset_hz", "coarse_bin", "coarse_center_offset_hz").alias("_rf"),
    )
    joined = df.join(t, on)
    rel = field(df, "extra.stream.source_sample", "double")
    m = "_m.mapping_output_start"
    exact = F.col("_m.mapping_wideband_sample") + (
        F.coalesce(rel, F.col(m).cast("double")) - F.col(m)
    ) * F.col("_m.samples_per_output")
    return with_extra(
        joined,
        wideband=F.struct(
            F.col("_rf.center_frequency_hz").alias("rf_center_frequency_hz"),
            F.col("_rf.frequency_offset_hz").alias("frequency_offset_hz"),
            F.col("_rf.coarse_bin").alias("coarse_bin"),
            F.col("_rf.coarse_center_offset_hz").alias("coarse_center_offset_hz"),
            F.greatest(F.lit(0).cast("bigint"), round_half_up(exact)).alias("source_sample"),
            exact.alias("source_sample_exact"),
        ),
    ).drop("_m", "_rf")


def stamp_tuned(df: DataFrame, streaming: bool = False) -> DataFrame:
    """Record how the baseband was cut from the wideband input.

    Needs input_center_hz, offset_hz, input_rate_hz, baseband_rate_hz, decimation; the
    streaming form adds the channel and its approximate wideband sample.
    """
    parts = [
        F.col("input_center_hz").alias("input_center_frequency_hz"),
        (F.col("input_center_hz") + F.col("offset_hz")).alias("target_frequency_hz"),
        F.col("offset_hz").alias("frequency_offset_hz"),
        F.col("input_rate_hz").alias("input_sample_rate_hz"),
        F.col("baseband_rate_hz").alias("baseband_sample_rate_hz"),
        F.col("decimation").alias("decimation_factor"),
    ]
    if streaming:
        sample = field(df, "extra.stream.source_sample", "double", 0.0)
        parts = [F.col("channel_id").cast("bigint").alias("channel_id"), *parts] + [
            F.greatest(F.lit(0).cast("bigint"), round_half_up(sample * F.col("decimation"))).alias(
                "wideband_source_sample_approx"
            ),
            F.lit(False).alias("mapping_includes_filter_delay"),
        ]
    return with_extra(df, tuned=F.struct(*parts))


def bit_of_time(sec: Column, symbol_rate: float = 18000.0) -> Column:
    """1-based bit index of a time, two bits per symbol; null stays null."""
    return round_half_up(sec * 2 * F.lit(symbol_rate)) + 1


def time_of_bit(bit: Column, active_start: Column, symbol_rate: float = 18000.0) -> Column:
    return active_start + F.greatest(F.lit(0.0), bit.cast("double") - 1) / (2 * F.lit(symbol_rate))


def to_absolute_bits(df: DataFrame) -> DataFrame:
    """Replace window-relative bit positions by absolute ones, keeping the relative value."""
    out = {}
    for name, source in (
        ("slot_start_bit", "start_time_s"),
        ("slot_end_bit", "end_time_s"),
        ("start_bit", "start_time_s"),
        ("end_bit", "end_time_s"),
    ):
        if has_path(df.schema, f"extra.{name}"):
            rel = F.col(f"extra.{name}")
            absolute = F.when(rel.isNotNull(), bit_of_time(field(df, f"extra.{source}", "double")))
            out |= {f"window_relative_{name}": rel, f"absolute_{name}": absolute, name: absolute}
    return with_extra(df, **out) if out else df


@dataclass(frozen=True)
class DiagnosticLimits:
    """What of a diagnostics tree stays: levels, numbers in a list, characters of a text."""

    depth: int = 4
    elements: int = 16
    text: int = 256

    def lost(self, value, depth: int) -> int:
        """Values that go with this one at this depth, 0 if it stays.  Lists of objects or texts
        always go, and count by their objects."""
        if depth > self.depth:
            return 1
        if isinstance(value, str):
            return int(len(value) > self.text)
        if isinstance(value, list):
            if any(isinstance(v, (dict, str)) for v in value):
                return len(value) if isinstance(value[0], dict) else 1
            return int(len(value) > self.elements)
        return 0


def _compact(text: str, limits: DiagnosticLimits) -> str:
    tree = json.loads(text)
    kept, omitted = {}, limits.lost(tree, 0)
    todo = [(tree, kept, 1)] if isinstance(tree, dict) else []
    while todo:
        source, target, depth = todo.pop()
        gone = {name: limits.lost(child, depth) for name, child in source.items()}
        omitted += sum(gone.values())
        for name in (n for n, lost in gone.items() if not lost):
            inner = isinstance(source[name], dict)
            target[name] = {} if inner else source[name]
            if inner:
                todo.append((source[name], target[name], depth + 1))
    return json.dumps(kept | {"streamCompacted": True, "streamOmittedValueCount": omitted})


def bounded_diagnostics(col: Column, limits: DiagnosticLimits = DiagnosticLimits()) -> Column:
    """Diagnostics JSON without what goes beyond ``limits``, plus a count of what was left out."""

    @F.pandas_udf(T.StringType())
    def compact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _compact(t, limits), na_action="ignore")

    return compact(col)


def chunk_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: which parts of the chunk contract a row breaks.

    ``sample_count`` is used where the sample arrays are not carried along.
    """
    count = (
        F.greatest(F.size("i"), F.size("q")).cast("bigint")
        if {"i", "q"} <= set(df.columns)
        else F.col("sample_count").cast("bigint")
    )
    rate = F.col("sample_rate_hz")
    start, end = F.col("start_sample"), F.col("end_sample")
    checks = {
        "sample_rate": rate.isNull() | F.isnan(rate) | (rate <= 0) | (rate == float("inf")),
        "sample_range": F.coalesce(end < start, F.lit(True)),
        "sample_count": F.coalesce((end >= start) & (end - start != count), F.lit(True)),
        "discontinuity": F.col("discontinuity").isNull(),
    }
    if {"i", "q"} <= set(df.columns):
        checks["iq_shape"] = F.size("i") != F.size("q")
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return df.withColumn("violations", found)


# Decimated rates tried in this order
DECIMATED_RATES = [125000, 120000, 128000, 100000, 96000, 80000]


def decimated_rate(df: DataFrame, rate: str = "input_rate_hz", requested: float = 120000.0,
                   stopband: float = 55000.0) -> DataFrame:
    """Output rate of the tuner: the requested one when it divides the input rate, else the
    first listed rate that does and keeps the stopband; null when none does."""
    r = F.col(rate).cast("double")

    def divides(out: Column) -> Column:
        return F.abs(r / out - F.round(r / out)) < 1e-9

    asked = F.lit(float(requested))
    adapted = F.abs(r / asked - F.round(r / asked)) > 1e-9
    fits = F.filter(
        F.array(*[F.lit(float(c)) for c in DECIMATED_RATES]), lambda c: (c > 2 * stopband) & divides(c)
    )
    out = F.when(adapted, F.get(fits, F.lit(0))).otherwise(asked)
    return df.withColumns(
        {
            "adapted": adapted,
            "output_rate_hz": out,
            "decimation": round_half_up(r / out),
        }
    )


def protocol_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("protocol_rank", rank(F.col("protocol")))
