"""Exact state machines over long keys, in blocks joined by a tree.

Some rules cannot be written as running values: the next decision depends on a small state
(an estimate being tracked, the identity collected so far).  Walking a whole key in one
task would not survive a key that holds a third of the data, so a key is cut into blocks.

First all blocks run at once from a guessed entry state, then once or twice more those that did
not start where the block before them ended; machines that forget (a call ends, a carrier
goes silent) are right after that.  What is still open is settled level by level, as in a
segment tree: at level n two neighbours of 2^(n-1) block numbers each are right on their own,
and where the left one does not end in the state that the right one started from, the right
one is walked again, one block after the other, until it meets a state it has been in at that place
before.  So every pass over rows settles a level: there are at most as many passes as the
highest block number has bits, whatever the guesses were, a pass reads only the halves that are
walked again, and the result equals the sequential walk.  A task holds one block at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.functions.ordered import WIDTH, block_of
from radiolake.session import persist_table

Step = Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]]

_ENTRY, _ROW, _END = 0, 1, 2  # what a line of a walk is: start in a state, a row, end of a block
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _dump(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def _walker(step: Step, order: list[str], columns: list[str], fields: list[T.StructField]):
    """Walks lines in order of block: output rows, and for each walked block a row of its own with
    the states it started from and ended in."""

    def block(state: dict, held: list[pa.RecordBatch], end: pa.RecordBatch) -> tuple[dict, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).to_pandas().sort_values(order, kind="stable")
        used = _dump(state)
        state, out = step(state, rows)
        n = len(out)
        arrays = [
            pa.concat_arrays([pa.array(out[f.name], kind, from_pandas=True), pa.nulls(1, kind)])
            for f in fields
            for kind in (_ARROW[f.dataType.simpleString()],)
        ]
        arrays += [pa.array([None] * n + [x], pa.string()) for x in (used, _dump(state))]
        same = pa.array(np.zeros(n + 1, dtype=np.int64))
        arrays += [end.column(c).take(same) for c in (*end.schema.names[: end.schema.names.index("_half")], "_blk")]
        names = [*(f.name for f in fields), "_used", "_exit", *end.schema.names[: end.schema.names.index("_half")], "_blk"]
        return state, pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, []
        for batch in batches:
            kinds = batch.column("_kind").to_numpy()
            at = 0
            for i in np.flatnonzero(kinds != _ROW).tolist():
                if i > at and state is not None:
                    held.append(batch.slice(at, i - at).select(columns))
                at = i + 1
                told = batch.column("_state")[i].as_py()
                if kinds[i] == _ENTRY:
                    state = json.loads(told)
                elif state is not None:
                    state, out = block(state, held, batch.slice(i, 1))
                    yield out
                    if _dump(state) == told:  # from here on the rows were walked from this state before
                        state = None
                if kinds[i] == _END:
                    held = []
            if at < len(kinds) and state is not None:
                held.append(batch.slice(at).select(columns))

    return run


def run_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    initial: dict,
    out_schema: str,
    width: float = WIDTH,
    flat_passes: int = 3,
    passes: list[int] | None = None,
) -> DataFrame:
    """Walk every key of ``df`` in order with ``step(state, rows) -> (state, output rows)``.

    ``step`` sees one block at a time as pandas rows; ``state`` must be plain JSON data and
    small.  Returns the output rows with the key columns.  Null keys form a key of their own.
    ``flat_passes`` is the number of passes over single blocks before the tree, 1 at least;
    ``passes`` gets the number of blocks walked by each pass.
    """
    keys, order, columns = list(keys), list(order), df.columns
    out_fields = T.StructType.fromDDL(out_schema).fields
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(
        out_fields
        + [T.StructField("_used", T.StringType()), T.StructField("_exit", T.StringType())]
        + key_fields
        + [T.StructField("_blk", T.LongType())]
    )
    first = _dump(initial)
    names = [f.name for f in key_fields]
    key = F.struct(*names)  # null fields of a struct are equal
    rows = persist_table(df.withColumn("_blk", block_of(order[0], width)), "blocks")
    walker = _walker(step, order, columns, out_fields)
    results, done = [], None

    def walk(todo: DataFrame, half: str) -> None:
        """Walk the halves of ``todo`` (keys, _half, _lo, _entry) from block _lo on."""
        nonlocal done
        todo = persist_table(todo, "entries")
        wanted = todo.select(key.alias("_k"), F.col("_half").alias("_h"), "_lo")

        def of_halves(part: DataFrame) -> DataFrame:
            part = part.withColumn("_half", F.expr(half))
            joined = part.join(wanted, (key == F.col("_k")) & (F.col("_half") == F.col("_h")))
            return joined.where("_blk >= _lo").drop("_k", "_h", "_lo")

        ends = rows.select(*names, "_blk").distinct() if done is None else done
        ends = of_halves(ends).select(
            *names, "_half", "_blk", F.lit(_END).alias("_kind"), (F.col("_exit") if done is not None else F.lit(None).cast("string")).alias("_state")
        )
        starts = todo.select(
            *names, "_half", F.col("_lo").alias("_blk"), F.lit(_ENTRY).alias("_kind"), F.col("_entry").alias("_state")
        )
        rest = [c for c in columns if c not in names]
        lines = of_halves(rows).select(
            *names, "_half", "_blk", F.lit(_ROW).alias("_kind"), F.lit(None).cast("string").alias("_state"), *rest
        )
        lines = lines.unionByName(starts.unionByName(ends), allowMissingColumns=True)
        lines = lines.repartition(*names, "_half").sortWithinPartitions(*names, "_half", "_blk", "_kind", *order)
        found = persist_table(lines.mapInArrow(walker, schema).withColumn("_pass", F.lit(len(results))), "walked")
        results.append(found)
        new = found.where("_exit IS NOT NULL").select(*names, "_blk", "_used", "_exit", "_pass")
        if done is not None:
            old = done.join(new.select(key.alias("_k"), F.col("_blk").alias("_b")), (key == F.col("_k")) & (F.col("_blk") == F.col("_b")), "left_anti")
            new = old.unionByName(new)
        done = persist_table(new, "exits")
        if passes is not None:
            passes.append(found.where("_exit IS NOT NULL").count())

    single = rows.select(*names, "_blk").distinct()
    walk(single.select(*names, F.col("_blk").alias("_half"), F.col("_blk").alias("_lo"), F.lit(first).alias("_entry")), "_blk")
    w = Window.partitionBy(*names).orderBy("_blk")
    # level of the tree at which a block and the one before it meet: bits in which their numbers differ
    meets = F.length(F.bin(F.col("_blk").bitwiseXOR(F.col("_before"))))
    while True:
        joined = done.select(
            *names, "_blk", "_used", F.lag("_blk").over(w).alias("_before"), F.coalesce(F.lag("_exit").over(w), F.lit(first)).alias("_entry")
        )
        wrong = persist_table(joined.where("_entry <> _used").withColumn("_level", meets).drop("_used"), "wrong")
        level = wrong.agg(F.min("_level")).first()[0]
        if level is None:
            break
        if len(results) < flat_passes:
            walk(wrong.select(*names, F.col("_blk").alias("_half"), F.col("_blk").alias("_lo"), "_entry"), "_blk")
        else:
            half = f"shiftright(_blk, {level - 1})"
            walk(wrong.where(F.col("_level") == level).select(*names, F.expr(half).alias("_half"), F.col("_blk").alias("_lo"), "_entry"), half)
    newest = done.select(key.alias("_k"), F.col("_blk").alias("_b"), F.col("_pass").alias("_p"))
    walked = results[0]
    for more in results[1:]:
        walked = walked.unionByName(more)
    walked = walked.where("_exit IS NULL")
    if len(results) > 1:
        walked = walked.join(newest, (key == F.col("_k")) & (F.col("_blk") == F.col("_b")) & (F.col("_pass") == F.col("_p"))).drop("_k", "_b", "_p")
    return walked.drop("_used", "_exit", "_blk", "_pass")
