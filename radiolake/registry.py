"""Protocols: names, scan modes, rates and the handlers each one brings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Protocol:
    name: str
    aliases: tuple[str, ...]
    scan_mode: str
    target_rate_hz: float
    blind_search: bool
    frequency_list: bool
    baseband: bool
    probe_initial_sec: float
    probe_max_sec: float
    # DataFrame -> DataFrame handlers; users may replace them or add a protocol
    handlers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


PROTOCOLS: dict[str, Protocol] = {
    p.name: p
    for p in (
        Protocol("DMR", ("dmr",), "narrowband_4fsk", 48000.0, True, True, True, 0.30, 1.50),
        Protocol("P25", ("p25",), "narrowband_4fsk", 48000.0, True, True, True, 0.10, 1.00),
        Protocol("dPMR", ("dpmr",), "narrowband_4fsk", 48000.0, True, True, True, 0.32, 1.50),
        Protocol("NXDN", ("nxdn", "nxdn96"), "narrowband_4fsk", 48000.0, True, True, True, 0.16, 1.00),
        Protocol("TETRA", ("tetra",), "windowed_iq", 72000.0, False, True, False, 0.50, 6.00),
    )
}


def literal_map(pairs: dict) -> Column:
    """A constant lookup map; lookups stay inside generated code, no join needed."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def canonical_name(col: Column) -> Column:
    """Protocol name for any of its spellings, null when unknown."""
    known = {a: p.name for p in PROTOCOLS.values() for a in (*p.aliases, p.name.lower())}
    return F.try_element_at(literal_map(known), F.lower(col))


def target_rate(col: Column, fallback: Column) -> Column:
    rates = {p.name: p.target_rate_hz for p in PROTOCOLS.values()}
    return F.coalesce(F.try_element_at(literal_map(rates), canonical_name(col)), fallback)


def rank(col: Column) -> Column:
    """Position of a protocol in the registry."""
    return F.try_element_at(literal_map({n: i for i, n in enumerate(PROTOCOLS)}), col)


def default_names(mode: Column) -> Column:
    """Protocols scanned by default in mode blind, frequency_list or baseband."""

    def names(flag: str) -> Column:
        return F.array(*[F.lit(p.name) for p in PROTOCOLS.values() if getattr(p, flag)])

    return (
        F.when(mode == "blind", names("blind_search"))
        .when(mode == "frequency_list", names("frequency_list"))
        .otherwise(names("baseband"))
    )


def dim_protocol(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    return spark.createDataFrame(
        [
            (p.name, list(p.aliases), p.scan_mode, p.target_rate_hz, p.blind_search, p.frequency_list, p.baseband)
            for p in PROTOCOLS.values()
        ],
        "name string, aliases array<string>, scan_mode string, target_rate_hz double, "
        "blind_search boolean, frequency_list boolean, baseband boolean",
    )


def run_handler(df: DataFrame, step: str) -> DataFrame:
    """Apply every protocol's ``step`` handler to that protocol's rows."""
    name = canonical_name(F.col("protocol"))
    out = None
    for p in PROTOCOLS.values():
        part = df.where(name == p.name)
        if step in p.handlers:
            part = part.transform(p.handlers[step])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = df.where(name.isNull())
    return out.unionByName(rest, allowMissingColumns=True)
