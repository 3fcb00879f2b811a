"""State machines on streams: the step functions of the batch operators, one state per key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from radiolake.functions.blockstate import Step


def run_stateful(
    stream: DataFrame, keys: list[str], order: list[str], step: Step, initial: dict, out_schema: str
) -> DataFrame:
    """Walk each key's rows in arrival batches; ``step`` and ``initial`` as in a batch run.

    Rows of one trigger are put in order; a key's state is its JSON text.
    """
    fields = T.StructType.fromDDL(out_schema)
    key_fields = [f for f in stream.schema.fields if f.name in keys]
    columns = [f.name for f in fields.fields]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        now = json.loads(state.get[0]) if state.exists else initial
        now, out = step(now, rows)
        state.update((json.dumps(now, sort_keys=True),))
        out = out.reindex(columns=columns)
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        yield out

    return stream.groupBy(*keys).applyInPandasWithState(
        run, T.StructType(fields.fields + key_fields), T.StructType().add("state", "string"), "append", GroupStateTimeout.NoTimeout
    )


def with_continuity(step: Step) -> tuple[Step, dict]:
    """Wrap a chunk step so that ``reset`` is worked out on the fly: a flagged chunk, lost
    samples, or a start that is not where the chunk before ended."""

    def wrapped(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        last = state["end"]
        ends = rows["end_sample"].shift(1)
        if last is not None:
            ends.iloc[0] = last
        jump = ends.notna() & (rows["start_sample"] != ends)
        rows = rows.assign(reset=rows["discontinuity"] | (rows["dropped_samples"] > 0) | jump)
        inner, out = step(state["inner"], rows)
        return {"inner": inner, "end": int(rows["end_sample"].iloc[-1])}, out

    return wrapped, {"end": None}


def continuous(step: Step, initial: dict) -> tuple[Step, dict]:
    wrapped, extra = with_continuity(step)
    return wrapped, extra | {"inner": initial}


LIVE_FRESH = {"average": None, "max_hold": None}
LIVE_OUT = "seq long, average array<double>, max_hold array<double>"


def live_spectrum_step(alpha: float = 0.25) -> Step:
    """Smoothed and held spectrum after each update (``seq``, ``psd``, ``reset_hold``)."""

    def step(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        avg, top, out = state["average"], state["max_hold"], []
        for r in rows.itertuples(index=False):
            x = np.asarray(r.psd, float)
            avg = x if avg is None else (1 - alpha) * np.asarray(avg) + alpha * x
            top = x if top is None or r.reset_hold else np.maximum(np.asarray(top), x)
            out.append((r.seq, avg.tolist(), top.tolist()))
        state = {"average": list(map(float, avg)), "max_hold": list(map(float, top))}
        return state, pd.DataFrame(out, columns=["seq", "average", "max_hold"])

    return step
