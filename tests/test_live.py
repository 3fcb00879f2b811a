"""Live rules equal their batch forms over two splits into triggers and a restart."""

import pytest
from pyspark.sql import functions as F

from radiolake.functions import keys as K
from radiolake.operators import dedup as D
from radiolake.operators import evidence as E
from radiolake.operators import sessions as S
from radiolake.plans.adapters import Views
from radiolake.plans.q_dedup import _live
from radiolake.streaming import live as L

SF = "/root/testdata/sf0.001"
SPLITS = [[400, 1000], [90, 333, 700, 1000]]


@pytest.fixture(scope="module")
def views(spark):
    L.use_state_store(spark)
    return Views(spark, SF)


def rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def run_live(spark, df, make, tmp, edges, order="seq", watermark=None):
    """Feeds the rows up to each edge, and stops and restarts the query after the first one."""

    def feed(lo, hi, n):
        part = df.where((F.col(order) > lo) & (F.col(order) <= hi)).coalesce(1)
        part.write.parquet(f"{tmp}/in/part{n:03d}")

    def go():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        stream = stream.parquet(f"{tmp}/in")
        if watermark:
            stream = stream.withWatermark(watermark, "0 seconds")
        q = make(stream).writeStream.format("parquet").option("path", f"{tmp}/out")
        q = q.option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return q

    feed(-(10**9), edges[0], 0)
    go()
    for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
        feed(lo, hi, n)
    q = go()
    return spark.read.parquet(f"{tmp}/out"), q


def verdicts(views):
    k = F.col("k")
    return views.chunks.select(
        F.floor(F.col("seq") / 256).alias("lock"), "seq",
        F.when(k % 4 == 0, "confirmed").when(k == 77, "error").otherwise("no_evidence").alias("verdict"),
    )


@pytest.mark.parametrize("edges", SPLITS)
def test_health(spark, views, tmp_path, edges):
    df = verdicts(views)
    got, _ = run_live(spark, df, lambda s: L.decoder_health_stream(s, ["lock"]), str(tmp_path), edges)
    health = E.decoder_health(df, ["lock"])
    assert rows(got, ["lock", "seq", "misses", "health"]) == rows(health, ["lock", "seq", "misses", "health"])
    cols = ["lock", "seq", "event", "from_state", "to_state"]
    want = rows(E.health_events(health, ["lock"]), cols)
    assert rows(got.where("event IS NOT NULL"), cols) == want and len(want) > 5


@pytest.mark.parametrize("edges", SPLITS)
def test_rollover(spark, views, tmp_path, edges):
    k = F.col("k")
    df = views.chunks.select(
        "channel_id", "seq", F.col("end_sample").alias("sample"), "start_sample",
        F.when(k % 13 == 0, None).when(k % 40 < 25, "DMR").otherwise("P25").alias("protocol"),
        F.when(k % 10 == 0, 0).otherwise(F.col("end_sample") - k * 200).alias("last_strong_sample"),
    )
    got, _ = run_live(spark, df, lambda s: L.protocol_rollover_stream(s, ["channel_id"]), str(tmp_path), edges)
    cols = ["channel_id", "seq", "protocol", "previous_protocol", "is_switch", "boundary", "epoch_id"]
    want = rows(E.protocol_rollover(df, ["channel_id"]), cols)
    assert rows(got, cols) == want and sum(r[4] for r in want) > 5


@pytest.mark.parametrize("edges", SPLITS)
def test_superframes_and_late_entry(spark, views, tmp_path, edges):
    df = views.frames_sf
    got, _ = run_live(spark, df, lambda s: L.superframes_stream(s, ["channel_id"]), f"{tmp_path}/s", edges)
    cols = ["channel_id", "seq", "first_sample", "last_sample", "layer3_bits", "superframe"]
    want = rows(S.assemble_superframes(df, ["channel_id"]), cols)
    assert rows(got, cols) == want and sum(r[5] for r in want) > 3
    part = F.col("part")
    marks = df.select("channel_id", "seq", F.when(part == 1, 1).when(part == 4, 2).otherwise(3).alias("lcss"), "bits")
    got, _ = run_live(spark, marks, lambda s: L.late_entry_stream(s, ["channel_id"]), f"{tmp_path}/l", edges)
    cols = ["channel_id", "seq", "first_seq", "embedded_bits"]
    want = rows(S.assemble_late_entry(marks, ["channel_id"]), cols)
    assert rows(got, cols) == want and len(want) > 3


def test_context(spark, views, tmp_path):
    df = views.pdus_tetra.select("channel_id", "seq", "k", F.col("start_bit").alias("slot_start_bit"), "mni")
    valid = F.col("k") % 9 == 0
    top = df.agg(F.max("slot_start_bit")).first()[0]
    make = lambda s: L.carry_context_stream(s, ["channel_id"], valid, ["mni", "slot_start_bit"])
    got, _ = run_live(spark, df, make, str(tmp_path), [top // 3, top // 2, top], order="slot_start_bit")
    cols = ["channel_id", "seq", "context.mni", "context.slot_start_bit", "context_valid"]
    assert rows(got, cols) == rows(S.carry_context(df, ["channel_id"], valid, ["mni", "slot_start_bit"]), cols)


@pytest.mark.parametrize("edges", SPLITS)
def test_ledger(spark, views, tmp_path, edges):
    df = _live(views).withColumn("retained_start", F.col("extra.stream.source_sample") - 400)
    seeded = df.where("k < 10")
    ledger = seeded.select(
        "channel_id", F.to_json(K.stream_key(seeded)).alias("ledger_key"),
        F.when(~K.is_persistent(seeded), F.col("extra.stream.source_sample")).alias("seen_sample"),
    ).groupBy("channel_id", "ledger_key").agg(F.min("seen_sample").alias("seen_sample"))
    rest = df.where("k >= 10")
    make = lambda s: L.unseen_ledger_stream(s, ["channel_id"], ledger=ledger)
    got, q = run_live(spark, rest, make, str(tmp_path), edges)
    want = D.unseen(rest, ledger, ["channel_id"])
    assert rows(got, ["channel_id", "seq", "ledger_key"]) == rows(want, ["channel_id", "seq", "ledger_key"])
    assert 0 < want.count() < rest.count()
    # timed keys leave the state with the samples: fewer are held than were reported
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held < want.count() + ledger.count()


def test_ledger_forgets_by_sample(spark, views, tmp_path):
    line = lambda seq, typ, sample, start: ("c", seq, "DMR", 1, 2, 0.0, typ, 48000.0, ((sample,),), start)
    data = [
        line(1, "V", 1000, 0), line(2, "V", 1000, 900), line(3, "V", 1000, 1001), line(4, "C_CALL", 1, 0),
        line(101, "V", 1000, 1001), line(102, "V", 1000, 1500), line(103, "C_CALL", 9, 99999), line(104, "V", 1000, 1500),
    ]
    schema = (
        "channel_id string, seq long, protocol string, src_num long, dst_num long, fo_hz double, type string, "
        "sample_rate_hz double, extra struct<stream: struct<source_sample: long>>, retained_start long"
    )
    df = spark.createDataFrame(data, schema)
    got, _ = run_live(spark, df, lambda s: L.unseen_ledger_stream(s, ["channel_id"]), str(tmp_path), [50, 150])
    empty = spark.createDataFrame([], "channel_id string, ledger_key string, seen_sample long")
    want = sorted(r.seq for r in D.unseen(df, empty, ["channel_id"]).collect())
    assert sorted(r.seq for r in got.collect()) == want == [1, 3, 4, 102]


def test_late_rows_and_idle_keys(spark, views, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    # arrival, key, seq, verdict, time: seq 2 of "a" comes late, "b" is silent for longer than five seconds
    data = [(1, "a", 1, "no_evidence", at(1)), (1, "a", 3, "no_evidence", at(2)), (1, "b", 1, "no_evidence", at(1)),
            (2, "a", 2, "confirmed", at(20)), (2, "a", 4, "no_evidence", at(21)),
            (3, "a", 5, "no_evidence", at(22)), (4, "b", 2, "no_evidence", at(40))]
    df = spark.createDataFrame(data, "n long, lock string, seq long, verdict string, t string")
    df = df.withColumn("t", F.to_timestamp("t"))
    make = lambda s: L.decoder_health_stream(s, ["lock"], event_time="t", idle_sec=5.0)
    got, _ = run_live(spark, df, make, str(tmp_path), [1, 2, 3, 4], order="n", watermark="t")
    out = {(r.lock, r.seq): (r.misses, r.health, r.late) for r in got.collect()}
    assert out["a", 3] == (2, "no_evidence", False) and out["a", 2] == (None, None, True)
    assert out["a", 4] == (1, "no_evidence", False) or out["a", 4] == (3, "suspect", False)
    assert out["b", 2] == (1, "no_evidence", False)
    with pytest.raises(ValueError):
        L.decoder_health_stream(df, ["lock"], idle_sec=1.0)
