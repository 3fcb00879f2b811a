"""Live forms of rules with memory: decoder health, protocol rollover, superframes, late entry,
carried context and the ledger of reported rows.

Each is a stateful processor with typed state for each scope key, which the state store keeps
over restarts; the session has to use the RocksDB state store (``use_state_store``).  Rows of
a trigger are put in order before they are looked at.  A row that arrives behind one of a later
trigger comes out marked ``late`` with its results null and changes no state.  With an event-time
column and ``idle_sec`` the state of a key is dropped when the watermark is that far past its last
row; a key that comes back after that starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from radiolake.functions.fields import field
from radiolake.functions.keys import is_persistent, stream_key
from radiolake.operators.sessions import FRAME_SAMPLES, GAP_TOLERANCE, LATE_ENTRY_ORDER

_AT = "event_ms"


def use_state_store(spark: SparkSession) -> None:
    """Choose the state store that typed state needs, for queries started after this."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _int(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


class _Live(StatefulProcessor):
    """Order, lateness and idle timers; ``walk`` has the rule itself and ``clear`` drops its state."""

    def __init__(self, scope: list[str], order: list[str], out: list[str], idle_ms: int | None):
        self.scope, self.order, self.out, self.idle_ms = scope, order, out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", ", ".join(f"o{i} long" for i in range(len(self.order))) + ", timer long")
        self.open(handle)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        mark = self.mark.get() if self.mark.exists() else None
        last, timer = (tuple(mark[:-1]), mark[-1]) if mark else (None, None)
        places = list(zip(*(batch[c] for c in self.order), strict=True))
        late = pd.Series([last is not None and p <= last for p in places], index=batch.index, dtype=bool)
        fresh = batch[~late]
        if len(fresh):
            found = self.walk(fresh)
            if self.idle_ms is not None:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = int(fresh[_AT].max()) + self.idle_ms
                self.handle.registerTimer(timer)
            self.mark.update((*(int(x) for x in max(p for p, x in zip(places, late, strict=True) if not x)), timer))
            yield self._shaped(key, found.assign(late=False))
        if late.any():
            yield self._shaped(key, batch.loc[late, [c for c in batch.columns if c in self.order]].assign(late=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        self.clear()
        return iter(())

    def _shaped(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [*self.scope, *self.out, "late"]
        rows = rows.assign(**dict(zip(self.scope, key, strict=True))).reset_index(drop=True)
        plain = {}
        for c in columns:  # plain objects for texts and for what is missing
            if c not in rows.columns:
                plain[c] = pd.Series([None] * len(rows), dtype=object)
            elif rows[c].dtype == object or isinstance(rows[c].dtype, pd.StringDtype):
                plain[c] = pd.Series([None if pd.isna(x) else x for x in rows[c]], dtype=object)
            else:
                plain[c] = rows[c]
        return pd.DataFrame(plain, columns=columns)


def _start(stream: DataFrame, scope: list[str], order: list[str], rule: type, extra: str, event_time: str | None,
           idle_sec: float | None, initial: DataFrame | None = None, **options) -> DataFrame:
    kept = [f for f in stream.schema.fields if f.name in order]
    fields = kept + T.StructType.fromDDL(extra).fields
    idle_ms = None if idle_sec is None else round(idle_sec * 1000)
    if idle_ms is not None:
        if event_time is None:
            raise ValueError("idle_sec needs an event-time column with a watermark")
        stream = stream.withColumn(_AT, F.unix_millis(event_time))
    processor = rule(scope, order, [f.name for f in fields], idle_ms, **options)
    schema = T.StructType(
        [f for f in stream.schema.fields if f.name in scope] + fields + [T.StructField("late", T.BooleanType())]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return stream.groupBy(*scope).transformWithStateInPandas(
        processor, schema, "append", "None" if idle_ms is None else "EventTime", initial
    )


# ------------------------------------------------------------------ health and rollover


class _Health(_Live):
    def __init__(self, *args, suspect: int, lost: int):
        super().__init__(*args)
        self.suspect, self.lost = suspect, lost

    def open(self, handle) -> None:
        self.state = handle.getValueState("health", "misses long, pending boolean, gone boolean")

    def clear(self) -> None:
        self.state.clear()

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        misses, pending, gone = self.state.get() if self.state.exists() else (0, False, False)
        out = []
        for verdict in rows["verdict"]:
            misses = 0 if verdict == "confirmed" else misses + 1
            health = (
                "healthy" if verdict == "confirmed"
                else "error" if verdict == "error"
                else "lost" if misses >= self.lost
                else "suspect" if misses >= self.suspect
                else "no_evidence"
            )
            was, event, to_state = "LOSS_PENDING" if pending else "LOCKED", None, None
            ends = health in ("lost", "error")
            if not gone:
                if ends:
                    event, to_state = "DECODER_LOST", "RECLASSIFYING"
                elif health == "healthy" and pending:
                    event, to_state = "DECODER_RECOVERED", "LOCKED"
                elif health == "suspect" and not pending:
                    event, to_state = "DECODER_SUSPECT", "LOSS_PENDING"
            out.append((misses, health, event, was if event else None, to_state))
            pending = health == "suspect" or (pending and health != "healthy")
            gone = gone or ends
        self.state.update((misses, pending, gone))
        names = ["misses", "health", "event", "from_state", "to_state"]
        return rows.assign(**dict(zip(names, zip(*out, strict=True), strict=True)))


def decoder_health_stream(
    stream: DataFrame, scope: list[str], order: str = "seq", suspect: int = 3, lost: int = 6,
    event_time: str | None = None, idle_sec: float | None = None,
) -> DataFrame:
    """Health after each window, and the event it causes (null if none), as ``decoder_health`` and
    ``health_events`` give them.  State: one row for each key."""
    extra = "misses long, health string, event string, from_state string, to_state string"
    return _start(stream, scope, [order], _Health, extra, event_time, idle_sec, suspect=suspect, lost=lost)


class _Rollover(_Live):
    def open(self, handle) -> None:
        self.state = handle.getValueState("winner", "protocol string, boundary long, epoch long")

    def clear(self) -> None:
        self.state.clear()

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        held, boundary, epoch = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for protocol, sample, start, strong in zip(
            rows["protocol"], rows["sample"], rows["start_sample"], rows["last_strong_sample"], strict=True
        ):
            protocol, strong = None if pd.isna(protocol) else protocol, _int(strong)
            switch = held is not None and protocol is not None and protocol != held
            edge = None
            if switch:
                edge = strong if strong is not None and strong > 0 else _int(sample)
            elif held is None:
                edge = _int(start)
            if edge is not None:  # never before the epoch began
                boundary = edge if boundary is None else max(boundary, edge)
            epoch += switch or held is None
            out.append((protocol, held, switch, boundary, epoch))
            held = held if protocol is None else protocol
        self.state.update((held, boundary, epoch))
        names = ["protocol", "previous_protocol", "is_switch", "boundary", "epoch_id"]
        return rows.assign(**dict(zip(names, zip(*out, strict=True), strict=True)))


def protocol_rollover_stream(
    stream: DataFrame, scope: list[str], order: str = "seq", event_time: str | None = None, idle_sec: float | None = None
) -> DataFrame:
    """Epochs as the winning protocol changes, as ``protocol_rollover`` gives them; a change opens the
    next epoch_id.  State: one row for each key."""
    extra = "protocol string, previous_protocol string, is_switch boolean, boundary long, epoch_id long"
    return _start(stream, scope, [order], _Rollover, extra, event_time, idle_sec)


# ------------------------------------------------------------------ fragments and context


class _Superframes(_Live):
    SAME = ("ran", "direction", "rf_channel_type")

    def __init__(self, *args, ttl_samples: int):
        super().__init__(*args)
        self.ttl = ttl_samples

    def open(self, handle) -> None:
        self.parts = handle.getListState("parts", "part long, same string, sample long, bits string")

    def clear(self) -> None:
        self.parts.clear()

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        held = [tuple(p) for p in self.parts.get()] if self.parts.exists() else []
        out = []
        for r in rows.itertuples(index=False):
            place = [getattr(r, c) for c in self.order]
            sample = _int(r.fs_start)
            if held and sample is not None and sample > held[-1][2] + self.ttl:
                held = []
            if r.crc_ok and not r.superframe:
                out.append((*place, r.ran, sample, sample, r.bits, False))
                continue
            context = [getattr(r, c) for c in self.SAME]
            part = _int(r.part)
            whole = bool(r.crc_ok) and bool(r.superframe) and part is not None and not any(pd.isna(c) for c in context)
            if not whole or sample is None or part not in (1, len(held) + 1):
                held = []
                continue
            line = (part, repr(context), sample, None if pd.isna(r.bits) else r.bits)
            if part == 1:
                held = [line]
                continue
            before = held[-1]
            if before[1] != line[1] or abs(sample - before[2] - FRAME_SAMPLES) > GAP_TOLERANCE:
                held = []
                continue
            held.append(line)
            if part == len(LATE_ENTRY_ORDER):
                bits = None if any(pd.isna(p[3]) for p in held) else "".join(p[3] for p in held)
                out.append((*place, r.ran, held[0][2], sample, bits, True))
                held = []
        if held:
            self.parts.put(held)
        else:
            self.parts.clear()
        return pd.DataFrame(out, columns=[*self.order, "ran", "first_sample", "last_sample", "layer3_bits", "superframe"])


def superframes_stream(
    stream: DataFrame, scope: list[str], order: str = "seq", ttl_samples: int = 8 * FRAME_SAMPLES,
    event_time: str | None = None, idle_sec: float | None = None,
) -> DataFrame:
    """Superframes and single blocks, as ``assemble_superframes`` gives them.

    State: the parts of one open superframe, three at most.  They are given up when the sample clock
    of the key is ``ttl_samples`` past the last one, which a next part in time never is.
    """
    extra = "ran long, first_sample long, last_sample long, layer3_bits string, superframe boolean"
    return _start(stream, scope, [order], _Superframes, extra, event_time, idle_sec, ttl_samples=ttl_samples)


class _LateEntry(_Live):
    def open(self, handle) -> None:
        self.fragments = handle.getListState("fragments", "place long, mark long, bits string")

    def clear(self) -> None:
        self.fragments.clear()

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        held = [tuple(x) for x in self.fragments.get()] if self.fragments.exists() else []
        out = []
        for place, mark, bits in zip(rows[self.order[0]], rows["lcss"], rows["bits"], strict=True):
            held = [*held[-3:], (int(place), _int(mark), None if pd.isna(bits) else bits)]
            if tuple(x[1] for x in held) == LATE_ENTRY_ORDER:
                whole = None if any(pd.isna(x[2]) for x in held) else "".join(x[2] for x in held)
                out.append((place, held[0][0], whole))
        self.fragments.put(held[-3:])
        return pd.DataFrame(out, columns=[self.order[0], "first_seq", "embedded_bits"])


def late_entry_stream(
    stream: DataFrame, scope: list[str], order: str = "seq", event_time: str | None = None, idle_sec: float | None = None
) -> DataFrame:
    """Late-entry messages, as ``assemble_late_entry`` gives them.  State: the last three fragments."""
    extra = "first_seq long, embedded_bits string"
    return _start(stream, scope, [order], _LateEntry, extra, event_time, idle_sec)


class _Context(_Live):
    def open(self, handle) -> None:
        self.state = handle.getValueState("context", "context string")

    def clear(self) -> None:
        self.state.clear()

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        held, out = self.state.get()[0] if self.state.exists() else None, []
        for own in rows["own"]:
            held = held if pd.isna(own) else own
            out.append(held)
        if held is not None:
            self.state.update((held,))
        return rows.assign(carried=out)


def carry_context_stream(
    stream: DataFrame, scope: list[str], valid: Column, context: list[str], order: str = "slot_start_bit",
    event_time: str | None = None, idle_sec: float | None = None,
) -> DataFrame:
    """Latest valid sync context of every burst (own row included), as ``carry_context`` gives it.
    State: one context for each key.  Bursts arrive in ``order``, then seq."""
    held = F.struct(*context)
    kind = stream.select(held.alias("c")).schema["c"].dataType
    keep = [*scope, order, "seq", *([event_time] if event_time else [])]
    rows = stream.select(*dict.fromkeys(keep), F.when(valid, F.to_json(held)).alias("own"))
    out = _start(rows, scope, [order, "seq"], _Context, "carried string", event_time, idle_sec)
    out = out.withColumn("context", F.from_json("carried", kind)).drop("carried")
    return out.withColumn("context_valid", F.col("context").isNotNull())


# ------------------------------------------------------------------ ledger


class _Ledger(_Live):
    def open(self, handle) -> None:
        self.timed = handle.getMapState("timed", "key string", "seen long, pass long")
        self.lasting = handle.getMapState("lasting", "key string", "seen boolean")
        self.newest = handle.getValueState("newest", "retained long")

    def clear(self) -> None:
        for state in (self.timed, self.lasting, self.newest):
            state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, seen in zip(initialState["ledger_key"], initialState["seen_sample"], strict=True):
            if pd.isna(seen):
                self.lasting.updateValue((name,), (True,))
            else:
                self.timed.updateValue((name,), (int(seen), None))

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        newest = self.newest.get()[0] if self.newest.exists() else None
        known: dict[str, tuple | None] = {}
        keep = []
        for name, lasting, sample, retained in zip(
            rows["ledger_key"], rows["persistent"], rows["own_sample"], rows["retained_start"], strict=True
        ):
            retained = _int(retained)
            newest = retained if newest is None or (retained is not None and retained > newest) else newest
            if lasting:
                new = not self.lasting.containsKey((name,))
                if new:
                    self.lasting.updateValue((name,), (True,))
                keep.append(new)
                continue
            if name not in known:
                known[name] = tuple(self.timed.getValue((name,))) if self.timed.containsKey((name,)) else None
            held = known[name]
            new = held is None or (retained is not None and held[0] < retained and held[1] != retained)
            if new:
                known[name] = (int(sample), retained)
            keep.append(new)
        for name, held in known.items():
            self.timed.updateValue((name,), held)
        if newest is not None:
            self.newest.update((newest,))
            gone = [k for k, (seen, last) in self.timed.iterator() if seen < newest and (last is None or last < newest)]
            for k in gone:
                self.timed.removeKey(k)
        return rows[pd.Series(keep, index=rows.index, dtype=bool)]


def unseen_ledger_stream(
    stream: DataFrame, scope: list[str], order: str = "seq", ledger: DataFrame | None = None,
    event_time: str | None = None, idle_sec: float | None = None,
) -> DataFrame:
    """Rows not reported before, by the rule of ``dedup.unseen``: (scope, order, ledger_key, late).

    A timed key is forgotten, and leaves the state, once its sample lies before the newest
    ``retained_start`` of its scope: the stream's own sample position counts, not the clock.
    Keys of calls and sessions last as long as their scope: put the epoch into ``scope`` or
    set ``idle_sec`` to bound them.  ``ledger`` seeds the state (batch rows of scope, ledger_key, seen_sample).
    """
    keep = [*scope, order, "retained_start", *([event_time] if event_time else [])]
    rows = stream.select(
        *dict.fromkeys(keep),
        F.to_json(stream_key(stream)).alias("ledger_key"),
        is_persistent(stream).alias("persistent"),
        field(stream, "extra.stream.source_sample", "bigint", 0).alias("own_sample"),
    )
    seed = None if ledger is None else ledger.select(*scope, "ledger_key", "seen_sample").groupBy(*scope)
    return _start(rows, scope, [order], _Ledger, "ledger_key string", event_time, idle_sec, seed)
