"""Interaction of document filters: what each removes, in every order, from one table of 32 states.

Every row becomes a mask of the filters it fails, and rows are counted by part and mask.  A walk
in Gray-code order then visits all subsets of the filters: each step toggles one filter, changes
the number of active failures of the mask cells that fail it, and moves the cells whose number
reaches or leaves zero out of or into the running survivors.  The survivors of all subsets are
kept, and what a filter does at a place in an order is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.session import persist_table

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("rows", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Filters A to D by letter: true where a text fails.  A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n_words < 200,
        "B": F.lit(100) * n_distinct < F.lit(50) * n_words,
        "C": F.lit(100).cast("bigint") * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(2) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def label_flags(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic) by document: 1 if any of its label rows has quality 1, toxic 1."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("label_id"))
        .agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    )


def failure_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """(part, mask, rows, good, toxic): rows of each part by the filters A to E that they fail.

    Bit 0 is filter A, bit 4 filter E, which a text fails if a row of smaller doc_id has the same
    text (by SHA-256).  Rows that share the smallest id of a text all pass E.  A row without an id
    has no label, comes before nothing and passes E.  A null part is the empty string; a document
    with several label rows counts once, by ``label_flags``.  Copies meet as counts: rows are summed by
    (text, id, part), then by (text, part), and only those sums look for the smallest id.
    """
    letters = text_filters(F.col("text"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(letters.values())), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        mask.cast("int").alias("mask"),
    )
    sums = [F.sum(m).alias(m) for m in MEASURES]
    known = (
        rows.where("doc_id IS NOT NULL")
        .join(label_flags(labels), F.col("doc_id") == F.col("label_id"), "left")
        .groupBy("doc_id", "digest", "part", "mask")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
        .groupBy("digest", "part", "mask")
        .agg(*sums, F.min(F.struct("doc_id", *MEASURES)).alias("first"))
    )
    known = persist_table(known, "failures")  # read twice
    lead = known.groupBy(F.col("digest").alias("lead_digest")).agg(F.min("first.doc_id").alias("lead_id"))
    known = known.join(lead, F.col("digest") == F.col("lead_digest"))
    held = lambda m: F.when(F.col("first.doc_id") == F.col("lead_id"), F.col(f"first.{m}")).otherwise(0)
    passes = F.struct("mask", *(held(m).alias(m) for m in MEASURES))
    fails = F.struct(
        (F.col("mask") + (1 << len(letters))).alias("mask"), *((F.col(m) - held(m)).alias(m) for m in MEASURES)
    )
    cells = known.select("part", F.explode(F.array(passes, fails)).alias("cell")).select("part", "cell.*")
    no_id = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("rows"))
    no_id = no_id.select("part", "mask", "rows", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    return cells.unionByName(no_id).where("rows > 0").groupBy("part", "mask").agg(*sums)


def walk_subsets(cells: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every subset of the filters, for (parts, masks, measures) counts by mask.

    Result [p, s, m] is what remains of part p when the filters of subset s are applied.
    """
    masks = np.arange(1 << n_filters)
    active = np.zeros(len(masks), dtype=np.int64)  # active failures of each cell
    left = cells.sum(axis=1)
    states = np.zeros_like(cells)
    states[:, 0] = left
    subset = 0
    for step in range(1, len(masks)):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        failing = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            active[failing] += 1
            left = left - cells[:, failing & (active == 1)].sum(axis=1)
        else:
            active[failing] -= 1
            left = left + cells[:, failing & (active == 0)].sum(axis=1)
        states[:, subset] = left
    return states


_STEPS = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def _steps(names: Sequence[str]):
    n = len(names)
    orders = np.array(list(permutations(range(n))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)
    before = (after - bits).ravel()
    after, which = after.ravel(), orders.ravel()
    order_names = ["".join(names[i] for i in o) for o in orders for _ in range(n)]
    places = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
    full = (1 << n) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cells = np.zeros((1, 1 << n, len(MEASURES)), dtype=np.int64)
                for c in packed:
                    cells[0, c["mask"]] = [c[m] for m in MEASURES]
                states = walk_subsets(cells, n)[0]
                lost = states[before] - states[after]
                failing = states[0, 0] - states[1 << which, 0]
                alone = states[full ^ (1 << which), 0] - states[full, 0]
                shapley = np.zeros(n, dtype=np.int64)
                np.add.at(shapley, which, lost[:, 0])
                columns = [
                    [part] * len(which),
                    order_names,
                    places,
                    states[after, 0],
                    lost[:, 0],
                    failing - lost[:, 0],
                    alone,
                    lost[:, 1],
                    lost[:, 2],
                    shapley[which],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _STEPS, strict=True)], schema=_STEPS
                )

    return run


def order_steps(cells: DataFrame, names: Sequence[str] = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step, from counts by part and mask.

    kept and removed count rows after and at the step, redundant those that fail its filter but
    went earlier, unique_fails those that fail its filter only; good_lost and toxic_lost are removed
    rows with those labels; shapley is what the filter removes, summed over all orders.  Cells may be
    split over several rows.  At most 2^n rows of a part come together; work grows with 2^n and n!
    for n filters, not with the rows.
    """
    packed = (
        cells.groupBy("part", "mask")
        .agg(*(F.sum(m).alias(m) for m in MEASURES))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    )
    schema = (
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    )
    return packed.mapInArrow(_steps(list(names)), schema)


FILTER_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
      'A': len(w) < 200,
      'B': 100 * len(list_distinct(w)) < 50 * len(w),
      'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, fails.A AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM k p, k q, k r, k s, k t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
cell AS (SELECT part, n, good, toxic,
           (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
           || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failing FROM g),
step AS (SELECT filter_order, i AS step, substr(filter_order, i, 1) AS x, substr(filter_order, 1, i - 1) AS earlier
         FROM o, range(1, 6) s(i)),
r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN translate(failing, earlier || x, '') = failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failing, x) AND translate(failing, earlier, '') = failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failing, x) AND translate(failing, earlier, '') <> failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failing, x) AND translate(failing, earlier, '') = failing THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failing, x) AND translate(failing, earlier, '') = failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
