"""Live calls whose state is a summary: one row for each open call, no raw rows.

Each rule walks the rows of a channel in order and keeps what the call will report: its first and
latest fields and its counts.  A finished call leaves with the row that closes it and equals the
row of the batch operator.  With an event-time column and ``idle_sec`` a call that hears nothing
for that long leaves as the batch form reports calls at the end of input, and its channel leaves
the state.  Rows behind a later trigger come out with ``late`` set, ``close_seq`` their own
position, and no call in the other columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.functions.fields import nonempty
from radiolake.functions.lookups import dmr_call_type
from radiolake.operators import sessions as S
from radiolake.streaming.live import _Live, _start


def _value(x):
    """A cell as state holds it: none for what is missing, whole numbers as int."""
    if x is None or isinstance(x, (list, str)):
        return x
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return x
    if pd.isna(x):
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


class _Calls(_Live):
    """``SUMMARY`` is the state of an open call, ``EMPTY`` its values before the first row; ``step``
    takes a row and gives the summary that follows and the call that the row closes, if any;
    ``expired`` gives the call to report when nothing more comes."""

    SUMMARY = ""
    EMPTY: dict = {}

    def open(self, handle) -> None:
        self.state = handle.getValueState("call", self.SUMMARY)
        self.names = [c.split()[0] for c in self.SUMMARY.split(", ")]

    def clear(self) -> None:
        self.state.clear()

    def start(self) -> dict:
        return dict.fromkeys(self.names) | self.EMPTY

    def held(self) -> dict:
        return dict(zip(self.names, self.state.get(), strict=True)) if self.state.exists() else self.start()

    def shaped(self, calls: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([x.get(c) for x in calls], dtype=object) for c in self.out})

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        held, calls = self.held(), []
        place = self.order[0]
        for cells in rows.itertuples(index=False):
            row = {c: _value(x) for c, x in zip(rows.columns, cells, strict=True)}
            held, call = self.step(held, row)
            if call is not None:
                calls.append(call | {place: row[place]})
        if held == self.start():
            self.state.clear()
        else:
            self.state.update(tuple(held[c] for c in self.names))
        return self.shaped(calls)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        call = self.expired(self.held())
        self.mark.clear()
        self.clear()
        if call is not None:
            yield self._shaped(key, self.shaped([call]).assign(late=False))


def _live_calls(
    rows: DataFrame, scope: list[str], rule: type, extra: str, event_time: str | None, idle_sec: float | None, **options
) -> DataFrame:
    out = _start(rows, scope, ["seq"], rule, extra, event_time, idle_sec, **options)
    return out.withColumnRenamed("seq", "close_seq")


def _times(scope: list[str], event_time: str | None) -> list[str]:
    return [event_time] if event_time and event_time not in scope else []


# ------------------------------------------------------------------ DMR


class _Dmr(_Calls):
    SUMMARY = (
        "start_seq long, src long, dst long, flco string, flco_type string, fid string, call_type string, color_code long, "
        "start_sample long, end_sample long, signalling_count long, late_entry_count long, csbk_count long"
    )
    EMPTY = {"signalling_count": 0, "late_entry_count": 0, "csbk_count": 0}

    def step(self, held: dict, row: dict) -> tuple[dict, dict | None]:
        kind = row["type"]
        is_open = held["start_seq"] is not None
        link = kind in ("LC_HEADER", "LATE_ENTRY")
        addressed = kind == "CSBK" and bool(row["src"] or row["dst"])
        closes = kind == "TERMINATOR" and is_open
        now = dict(held)
        if kind != "TERMINATOR":
            now["signalling_count"] += 1
            now["late_entry_count"] += kind == "LATE_ENTRY"
            now["csbk_count"] += kind == "CSBK"
        if not is_open and (link or addressed):
            now["start_seq"] = row["seq"]
        if link or closes or (addressed and not is_open):
            for name in ("src", "dst"):  # zero is no address
                now[name] = row[name] or held[name]
            for name in ("fid", "color_code"):
                now[name] = held[name] if row[name] is None else row[name]
            if row["flco"] is not None:
                now["flco"], now["flco_type"] = row["flco"], row["flco_type"]
            now["call_type"] = row["stated_type"] or now["flco_type"] or held["call_type"]
            if row["sample"] is not None:
                now["start_sample"] = row["sample"] if held["start_sample"] is None else held["start_sample"]
                now["end_sample"] = row["sample"]
        if not closes:
            return now, None
        ends = {"_closed": True, "last_data_type_name": row["data_type_name"], "last_sync_type": row["sync_type"]}
        return self.start(), now | ends

    def expired(self, held: dict) -> dict | None:
        return held | {"_closed": False} if held["start_seq"] is not None else None


def dmr_calls_live(
    stream: DataFrame, scope: list[str] = ("channel_id",), event_time: str | None = None, idle_sec: float | None = None
) -> DataFrame:
    """Calls as ``dmr_calls`` gives them, and ``late``.  State: one summary for each channel that is
    in a call or has heard signalling since its last one."""
    scope = list(scope)
    rows = S.dmr_signalling(stream, scope, *_times(scope, event_time))
    rows = rows.withColumn("flco_type", nonempty(dmr_call_type(F.col("flco"))))
    extra = _Dmr.SUMMARY + ", _closed boolean, last_data_type_name string, last_sync_type string"
    return S.dmr_call_columns(_live_calls(rows, scope, _Dmr, extra, event_time, idle_sec), scope, "late")


# ------------------------------------------------------------------ P25


class _P25(_Calls):
    SUMMARY = (
        "start_seq long, nac long, first_sample long, last_sample long, lc_src long, lc_dst long, lc_group boolean, "
        "has_lc boolean, ldu_count long"
    )
    EMPTY = {"has_lc": False, "ldu_count": 0}

    def __init__(self, *args, emit_open: bool):
        super().__init__(*args)
        self.emit_open = emit_open

    def step(self, held: dict, row: dict) -> tuple[dict, dict | None]:
        kind = row["duid_name"]
        if kind in S.P25_TERMINATORS:
            end = row["fs_start"]
            if end is None and self.emit_open:
                end = held["last_sample"]
            call = held | {"end_sample": end} if held["start_seq"] is not None else None
            if call is not None and end is None and not self.emit_open:
                call = None
            return self.start(), call
        now = dict(held)
        if kind in S.P25_STARTERS and held["start_seq"] is None:
            now |= {"start_seq": row["seq"], "nac": row["nac"], "first_sample": row["fs_start"]}
        if now["start_seq"] is not None and row["has_lc"]:
            now |= {c: row[c] for c in ("lc_src", "lc_dst", "lc_group", "has_lc")}
        now["ldu_count"] += kind in S.P25_VOICE
        if row["fs_start"] is not None:
            now["last_sample"] = row["fs_start"] if held["last_sample"] is None else max(held["last_sample"], row["fs_start"])
        return now, None

    def expired(self, held: dict) -> dict | None:
        if not self.emit_open or held["start_seq"] is None:
            return None
        return held | {"end_sample": held["last_sample"]}


def p25_calls_live(
    stream: DataFrame, scope: list[str] = ("channel_id",), emit_open: bool = False, event_time: str | None = None,
    idle_sec: float | None = None,
) -> DataFrame:
    """Calls as ``p25_calls`` gives them, and ``late``.  State: one summary for each channel since its
    last terminator."""
    scope = list(scope)
    rows = stream.select(
        *scope, "seq", *_times(scope, event_time), "duid_name", F.col("nac").cast("bigint"), F.col("fs_start").cast("bigint"),
        F.col("lc.src").cast("bigint").alias("lc_src"), F.col("lc.dst").cast("bigint").alias("lc_dst"),
        F.col("lc.is_group").alias("lc_group"), F.col("lc").isNotNull().alias("has_lc"),
    )
    extra = _P25.SUMMARY + ", end_sample long"
    out = _live_calls(rows, scope, _P25, extra, event_time, idle_sec, emit_open=emit_open)
    lc = F.struct(F.col("lc_src").alias("src"), F.col("lc_dst").alias("dst"), F.col("lc_group").alias("is_group"))
    return S.p25_call_columns(out.withColumn("lc", F.when(F.col("has_lc"), lc)), scope, "late")


# ------------------------------------------------------------------ NXDN


class _Nxdn(_Calls):
    SUMMARY = (
        "start_seq long, src long, dst long, call_type string, ran long, start_sample long, end_sample long, "
        "message_count long, parts string, alias_total long"
    )
    EMPTY = {"message_count": 0, "parts": "{}"}

    def step(self, held: dict, row: dict) -> tuple[dict, dict | None]:
        kind = row["type"]
        voice = kind == "NXDN_VCALL"
        if held["start_seq"] is None and not voice:
            return held, None  # what happens outside a call leaves no trace
        now = dict(held)
        now["end_sample"] = row["sample"]
        if voice:
            if held["start_seq"] is None:
                now |= {"start_seq": row["seq"], "start_sample": row["sample"]}
            for name in ("src", "dst", "call_type", "ran"):
                now[name] = held[name] if row[name] is None else row[name]
            now["message_count"] += 1
        elif kind == "NXDN_PROP_ALIAS":
            part, total = row["alias_segment"], row["alias_total"]
            if part is not None and total is not None and 1 <= part <= total:
                now["parts"] = json.dumps(json.loads(held["parts"]) | {str(part): row["alias_bytes"]})
                now["alias_total"] = total
        else:
            return self.start(), now | {"alias": self.alias(now), "end_type": kind, "end_payload_hex": row["payload_hex"]}
        return now, None

    def alias(self, held: dict) -> str:
        parts = sorted((int(n), b) for n, b in json.loads(held["parts"]).items())
        used = [b for n, b in parts if n <= held["alias_total"]]
        if any(b is None for b in used):
            return ""
        return "".join(chr(int(c)) for b in used for c in b if c is not None and 32 <= c <= 126).strip(" ")

    def expired(self, held: dict) -> dict | None:
        return held | {"alias": self.alias(held)} if held["start_seq"] is not None else None


def nxdn_calls_live(
    stream: DataFrame, scope: list[str] = ("channel_id",), event_time: str | None = None, idle_sec: float | None = None
) -> DataFrame:
    """Calls as ``nxdn_calls`` gives them, and ``late``.  State: one summary for each open call, with
    the latest bytes of each part of its alias."""
    scope = list(scope)
    rows = S.nxdn_messages(stream, scope, *_times(scope, event_time))
    extra = _Nxdn.SUMMARY + ", alias string, end_type string, end_payload_hex string"
    return S.nxdn_call_columns(_live_calls(rows, scope, _Nxdn, extra, event_time, idle_sec), scope, "late")
