"""Stream and batch agree, whatever the split into triggers."""

import pytest
from pyspark.sql import functions as F

from radiolake.functions.blockstate import run_blocks
from radiolake.operators import activity as A
from radiolake.operators import dedup as D
from radiolake.operators import sessions as S
from radiolake.plans.adapters import Views
from radiolake.plans.q_dedup import _live
from radiolake.plans.q_sessions import _nxdn, _tetra, dmr_rows
from radiolake.streaming import dedup as SD
from radiolake.streaming import incremental as I
from radiolake.streaming import stateful as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def rows(df, cols=None):
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def as_stream(spark, df, path, edges):
    """Files in order of seq, one per trigger."""
    lo = -1
    for n, hi in enumerate(edges):
        part = df.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1)
        part.write.mode("append").parquet(f"{path}/part{n:03d}")
        lo = hi
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option(
        "latestFirst", "false"
    ).parquet(path)


def run_incremental(spark, job, df, tmp, edges):
    stream = as_stream(spark, df, f"{tmp}/in", edges)
    q = job.start(stream, f"{tmp}/state", f"{tmp}/out", f"{tmp}/ckpt", availableNow=True)
    q.awaitTermination(300)
    assert q.exception() is None
    return job.results(spark, f"{tmp}/state", f"{tmp}/out", q.lastProgress["batchId"])


@pytest.mark.parametrize("edges", [[400, 1000], [150, 333, 700, 1000]])
def test_dmr_calls(spark, views, tmp_path, edges):
    df = dmr_rows(views)
    cols = ["channel_id", "start_seq", "src", "dst", "call_type", "signalling_count", "csbk_count", "start_sample", "end_sample", "closed_by"]
    got = run_incremental(spark, I.dmr_calls_stream(), df, str(tmp_path), edges)
    assert rows(got, cols) == rows(S.dmr_calls(df), cols)


def test_nxdn_and_tetra(spark, views, tmp_path):
    cols = ["channel_id", "start_seq", "src", "dst", "alias", "message_count", "closed_by"]
    df = _nxdn(views)
    got = run_incremental(spark, I.nxdn_calls_stream(), df, f"{tmp_path}/n", [300, 1000])
    assert rows(got, cols) == rows(S.nxdn_calls(df), cols)
    # time order must follow arrival here
    t = _tetra(views)
    t = t.withColumn("extra", F.col("extra").withField("start_time_s", F.col("seq").cast("double")))
    cols = ["channel_id", "start_seq", "src", "dst", "state", "control_event_count", "tch_candidate_count", "release_message"]
    got = run_incremental(spark, I.tetra_sessions_stream(width_sec=500.0), t, f"{tmp_path}/t", [300, 1000])
    assert rows(got, cols) == rows(S.tetra_sessions(t, width_sec=500.0), cols)


@pytest.mark.parametrize("edges", [[500, 1000], [210, 640, 1000]])
def test_epochs(spark, views, tmp_path, edges):
    cfg = A.ActivityConfig(min_on_sec=0.15, off_hang_sec=0.3)
    df = views.chunks
    cols = ["channel_id", "candidate_start", "end_sample", "close_reason"]
    got = run_incremental(spark, I.epochs_stream(2.0, cfg), df, str(tmp_path), edges)
    assert rows(got, cols) == rows(A.epochs(A.detect_fixed(df, 2.0, cfg)), cols)
    # ids stay apart over triggers, so that first reports can be told from repeated ones
    assert got.select("channel_id", "epoch_id").distinct().count() == got.count()


def test_adaptive_detector(spark, views, tmp_path):
    from dataclasses import asdict

    from radiolake.plans.q_activity import _adaptive_input

    cfg = A.ActivityConfig(on_margin_db=6.0, off_margin_db=3.0)
    df = _adaptive_input(views)
    step, fresh = ST.continuous(A.adaptive_step(asdict(cfg)), A.ADAPTIVE_FRESH)
    stream = as_stream(spark, df, f"{tmp_path}/in", [333, 700, 1000])
    out = ST.run_stateful(stream, ["channel_id"], ["seq"], step, fresh, A.ADAPTIVE_OUT)
    q = out.writeStream.format("memory").queryName("adaptive").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    cols = ["channel_id", "seq", "phase", "is_active", "started", "ended", "noise_source"]
    got = rows(spark.table("adaptive"), cols)
    assert got == rows(A.detect_adaptive(df, cfg, width=100), cols)


def test_unseen_ledger(spark, views, tmp_path):
    """Within the retained window the stream reports each key once, like the batch rule."""
    df = _live(views).withColumn("at", F.timestamp_micros(F.col("extra.stream.source_sample") * 20 + 86400 * 1000000))
    stream = as_stream(spark, df, f"{tmp_path}/in", [250, 600, 1000])
    out = SD.unseen_stream(stream, ["channel_id"], "at", "1 hour")
    q = out.writeStream.format("memory").queryName("unseen").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("unseen")
    from radiolake.functions import keys as K

    want = D.first_by_key(df, K.stream_key(df), ["channel_id"], ["seq"])
    assert got.count() == want.count()
    assert rows(got.select("channel_id", "ledger_key")) == rows(
        want.select("channel_id", F.to_json(K.stream_key(want)).alias("k"))
    )


def test_live_spectrum(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(n, 1, [float(x) for x in rng.random(4)], n == 3) for n in range(6)]
    df = spark.createDataFrame(data, "seq long, capture_id long, psd array<double>, reset_hold boolean")
    stream = as_stream(spark, df, f"{tmp_path}/in", [2, 5])
    out = ST.run_stateful(stream, ["capture_id"], ["seq"], ST.live_spectrum_step(0.25), ST.LIVE_FRESH, ST.LIVE_OUT)
    q = out.writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.seq: r for r in spark.table("live").collect()}
    avg = np.array(data[0][2])
    for d in data[1:]:
        avg = 0.75 * avg + 0.25 * np.array(d[2])
    assert np.allclose(got[5].average, avg)
    assert np.allclose(got[5].max_hold, np.max([d[2] for d in data[3:]], axis=0))


def test_track_stream_matches_blocks(spark, views, tmp_path):
    from dataclasses import asdict

    from radiolake.operators import tracking as T
    from radiolake.plans.q_tracking import CFG, _batches

    df = _batches(views)
    step = T.track_step(asdict(CFG))
    stream = as_stream(spark, df, f"{tmp_path}/in", [10, 40, 100])
    out = ST.run_stateful(stream, ["capture_id"], ["seq"], step, T.TRACK_FRESH, T.TRACK_OUT)
    q = out.writeStream.format("memory").queryName("tracks").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    cols = ["capture_id", "seq", "position", "event", "birth_seq", "birth_index", "state"]
    want = run_blocks(df, ["capture_id"], ["seq"], step, T.TRACK_FRESH, T.TRACK_OUT, width=7)
    assert rows(spark.table("tracks"), cols) == rows(want, cols)
