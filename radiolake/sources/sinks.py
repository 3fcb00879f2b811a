"""Writing results: event JSON, window CSV, display lines, carrier hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.formats import fixed_text, general_text, with_line
from radiolake.operators.conform import conform_pdus

# Columns of the window report, in file order, with the source column
WINDOW_COLUMNS = {
    "index": "index", "start_s": "start_sec", "end_s": "end_sec", "duration_s": "duration_sec", "events": "pdu_count",
    "confirmed": "confirmed_bursts", "dsb": "dsb_count", "dnb": "dnb_count", "dmac_sync": "dmac_sync_count", "stch": "stch_count",
    "schf": "schf_count", "timing_error_rad": "timing_error_rad", "fo_hz": "coarse_frequency_offset_hz", "variant": "decision_variant",
}


def write_pdus(df: DataFrame, path: str, include_raw_bits: bool = False, mode: str = "errorifexists") -> None:
    """One JSON object per line; raw bits only on request."""
    out = conform_pdus(df)
    if not include_raw_bits:
        out = out.drop("raw_bits")
    out.write.mode(mode).json(path)


def window_csv(reports: DataFrame) -> DataFrame:
    """Window reports as the text cells of the CSV: six decimals for times, six significant
    digits for errors and offsets."""

    def cell(name: str, source: str) -> Column:
        c = F.col(source)
        if name in ("start_s", "end_s", "duration_s"):
            return fixed_text(c, 6)
        if name in ("timing_error_rad", "fo_hz"):
            return F.when(c.isNull(), "NaN").otherwise(general_text(c))
        return c.cast("string") if name == "variant" else c.cast("bigint").cast("string")

    return reports.select(*[cell(n, s).alias(n) for n, s in WINDOW_COLUMNS.items()])


def write_window_csv(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    window_csv(reports).write.mode(mode).csv(path, header=True)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Display lines as text."""
    with_line(df).select("line").write.mode(mode).text(path)


def carrier_hints(carriers: DataFrame) -> DataFrame:
    """Selected carriers per recording: absolute and relative frequency, bandwidth, source.

    Needs path, format, sample_rate_hz, center_frequency_hz, offset_hz, bandwidth_hz."""
    return carriers.select(
        F.lit(1).alias("format_version"), F.col("path").alias("source_path"), F.col("format").alias("source_format"), "sample_rate_hz",
        "center_frequency_hz", (F.col("center_frequency_hz") + F.col("offset_hz")).alias("rf_frequency_hz"), "offset_hz",
        F.col("bandwidth_hz").alias("refine_bandwidth_hz"),
    )


def write_carrier_hints(carriers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    carrier_hints(carriers).withColumn("created_at", F.current_timestamp()).write.mode(mode).json(path)
