"""Live calls from summaries equal the batch calls over two splits, a restart and silence."""

import pytest
from pyspark.sql import functions as F

from radiolake.operators import sessions as S
from radiolake.plans.adapters import Views
from radiolake.plans.q_sessions import _nxdn, dmr_rows
from radiolake.streaming import calls as C
from radiolake.streaming import live as L
from tests.test_live import SF, SPLITS, rows, run_live


@pytest.fixture(scope="module")
def views(spark):
    L.use_state_store(spark)
    return Views(spark, SF)


def p25_rows(views):
    lc = F.struct(F.col("lc_src").alias("src"), F.col("lc_dst").alias("dst"), F.col("lc_is_group").alias("is_group"))
    frames = views.pdus_p25.withColumn("lc", F.when(F.col("lc_src").isNotNull(), lc))
    return frames.select("channel_id", "seq", "duid_name", "nac", "fs_start", "lc")


def stored(spark, df, path):
    """The same rows without the plan behind them."""
    df.write.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


def agree(spark, df, live, batch, tmp, edges):
    df = stored(spark, df, tmp)
    got, _ = run_live(spark, df, live, tmp, edges)
    want = batch(df)
    assert got.where("late").count() == 0
    expected = rows(want, want.columns)
    assert rows(got, want.columns) == expected and len(expected) > 5


@pytest.mark.parametrize("edges", SPLITS)
def test_dmr(spark, views, tmp_path, edges):
    agree(spark, dmr_rows(views), C.dmr_calls_live, lambda d: S.dmr_calls(d).where("closed_by = 'terminator'"), str(tmp_path), edges)


@pytest.mark.parametrize("edges", SPLITS)
def test_p25(spark, views, tmp_path, edges):
    agree(spark, p25_rows(views), C.p25_calls_live, S.p25_calls, str(tmp_path), edges)


@pytest.mark.parametrize("edges", SPLITS)
def test_nxdn(spark, views, tmp_path, edges):
    agree(spark, _nxdn(views), C.nxdn_calls_live, lambda d: S.nxdn_calls(d).where("closed_by <> 'end_of_input'"), str(tmp_path), edges)


def test_silence_ends_a_call_and_late_rows_are_marked(spark, tmp_path):
    L.use_state_store(spark)
    schema = (
        "at timestamp, channel_id int, seq long, type string, src_num long, dst_num long, flco string, fid string, "
        "extra struct<color_code: long, fs_start: long>"
    )
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    data = [
        (t(0), 1, 0, "LC_HEADER", 7, 9, None, None, (1, 100)),
        (t(1), 2, 1, "CSBK", 0, 0, None, None, (1, 150)),  # no address: opens nothing
        (t(2), 1, 2, "LC_HEADER", 0, None, None, None, (None, 200)),
        (t(300), 3, 10, "LC_HEADER", 5, 6, None, None, (2, 900)),  # the clock moves on for all channels
        (t(310), 3, 11, "TERMINATOR", None, None, None, None, (2, 950)),
        (t(311), 3, 12, "LC_HEADER", 5, 6, None, None, (2, 960)),
    ]
    df = spark.createDataFrame([tuple(r) for r in data], schema.replace("at timestamp", "at string"))
    df = df.withColumn("at", F.to_timestamp("at"))
    live = lambda s: C.dmr_calls_live(s, event_time="at", idle_sec=60)
    got, q = run_live(spark, df, live, str(tmp_path), [5, 20], watermark="at")
    cols = ["channel_id", "start_seq", "src", "dst", "signalling_count", "end_sample", "closed_by", "close_seq"]
    assert rows(got, cols) == sorted(
        [(1, 0, 7, 9, 2, 200, "end_of_scan", None), (3, 10, 5, 6, 1, 950, "terminator", 11)], key=repr
    )
