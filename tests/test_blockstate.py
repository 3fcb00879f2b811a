"""Block machines equal the sequential walk, and settle in a pass for each level of the tree."""

import pandas as pd
import pytest

from radiolake.functions.blockstate import run_blocks


def chained(state, rows):
    """Never forgets: every state depends on all rows before."""
    out, s = [], state["s"]
    for r in rows.itertuples():
        s = (s * 31 + int(r.v) + 1) % 1000003
        out.append((r.seq, s, None if r.note is None else r.note + str(s), [] if r.list is None else len(r.list)))
    return {"s": s}, pd.DataFrame([o[:3] for o in out], columns=["seq", "s", "note"])


def forgetful(state, rows):
    """Forgets at every row with v = 0."""
    out, s = [], state["s"]
    for r in rows.itertuples():
        s = 0 if r.v == 0 else s + int(r.v)
        out.append((r.seq, s, "x"))
    return {"s": s}, pd.DataFrame(out, columns=["seq", "s", "note"])


def sequential(df, step):
    out = {}
    for _, rows in df.toPandas().groupby("k", dropna=False):
        _, done = step({"s": 5}, rows.sort_values("seq"))
        out.update(zip(done.seq, zip(done.s, done.note, strict=True), strict=True))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(-20, 492).selectExpr(
        "id AS seq", "IF(id % 4 = 0, NULL, 'k') AS k", "IF(id % 9 = 0, 0, id * 7 % 11 + 1) AS v",
        "IF(id % 5 = 0, NULL, 'n') AS note", "IF(id % 3 = 0, NULL, array(named_struct('a', id))) AS list",
    )


@pytest.mark.parametrize("flat", [1, 3])
def test_every_guess_wrong(table, flat):
    passes = []
    got = run_blocks(table, ["k"], ["seq"], chained, {"s": 5}, "seq long, s long, note string", 2, flat, passes)
    got = {r.seq: (r.s, r.note) for r in got.collect()}
    assert got == sequential(table, chained)
    # 256 block numbers of either sign: a pass for each of 8 levels and one for the sign, not one for each block
    assert passes[0] == table.selectExpr("k", "floor(seq / 2)").distinct().count() > 300
    assert flat < len(passes) <= flat + 9
    assert sum(passes[flat:]) <= 9 * passes[0]


def test_machines_that_forget_need_no_tree(table):
    passes = []
    got = run_blocks(table, ["k"], ["seq"], forgetful, {"s": 5}, "seq long, s long, note string", 64, passes=passes)
    assert {r.seq: (r.s, r.note) for r in got.collect()} == sequential(table, forgetful)
    assert len(passes) <= 2


def test_rows_of_a_block_may_come_in_many_batches(spark, table):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = run_blocks(table, ["k"], ["seq"], chained, {"s": 5}, "seq long, s long, note string", 16)
        assert {r.seq: (r.s, r.note) for r in got.collect()} == sequential(table, chained)
    finally:
        spark.conf.set(key, before)


def test_no_rows(table):
    none = run_blocks(table.where("seq > 1000"), ["k"], ["seq"], chained, {"s": 5}, "seq long, s long, note string")
    assert none.columns == ["seq", "s", "note", "k"] and none.count() == 0
