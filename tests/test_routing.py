"""Two streams joined on ranges equal the batch range join over splits and a restart."""

import pytest
from pyspark.sql import functions as F

from radiolake.operators import activity as A
from radiolake.operators import tracking as T
from radiolake.streaming.routing import assign_live, route_live

PDUS = [(c, s) for c in (1, 2) for s in range(c, 1000, 7)]
# (channel, epoch, decode_start, end_sample): ranges that touch, overlap, hold nothing
EPOCHS = [(1, 0, 10, 90), (1, 1, 90, 200), (1, 2, 150, 210), (1, 3, 400, 401), (2, 0, 0, 333), (2, 1, 340, 900), (1, 4, 700, 690)]
CUTS = [[300, 1001], [100, 350, 600, 1001]]


def run(spark, points, spans, make, tmp, cuts, tail=()):
    """Points arrive by position and ranges by their end, up to each cut; a stop after the first."""

    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp}/{name}")

    def put(n, p, s):
        spark.createDataFrame(p, points[0]).coalesce(1).write.parquet(f"{tmp}/points/{n:03d}")
        spark.createDataFrame(s, spans[0]).coalesce(1).write.parquet(f"{tmp}/spans/{n:03d}")

    def go():
        out = make(stream("points", points[0]), stream("spans", spans[0]))
        q = out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck")
        q = q.trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return q

    lo = -1
    for n, hi in enumerate(cuts):
        put(n, [r for r in points[1] if lo < r[1] <= hi], [r for r in spans[1] if lo < r[3] <= hi])
        lo = hi
        if n == 0:
            go()
    for n, (p, s) in enumerate(tail, len(cuts)):
        put(n, p, s)
    q = go()
    return sorted((tuple(r) for r in spark.read.parquet(f"{tmp}/out").collect()), key=repr), q


POINTS = "channel_id int, pos bigint"
SPANS = "channel_id int, epoch_id int, decode_start bigint, end_sample bigint"


@pytest.mark.parametrize("cuts", CUTS)
def test_epochs(spark, tmp_path, cuts):
    def make(p, s):
        return assign_live(p, s, ["channel_id"], "pos", 100.0, 6.0, 64)

    got, _ = run(spark, (POINTS, PDUS), (SPANS, EPOCHS), make, str(tmp_path), cuts)
    df, eps = spark.createDataFrame(PDUS, POINTS), spark.createDataFrame(EPOCHS, SPANS)
    want = A.assign_to_epochs(df, eps, ["channel_id"], "pos", 64).collect()
    assert got == sorted(map(tuple, want), key=repr) and len(got) > 100


def test_unassigned_and_late_rows(spark, tmp_path):
    def make(p, s):
        return assign_live(p, s, ["channel_id"], "pos", 100.0, 6.0, 64, keep_unassigned=True)

    # both streams move on past every wait, then an event comes that is long over
    far = ([(1, 9000)], [(1, 90, 8990, 9000)])
    late = ([(1, 35), (1, 9500)], [(1, 91, 9490, 9500)])
    got, q = run(spark, (POINTS, PDUS), (SPANS, EPOCHS), make, str(tmp_path), CUTS[0], [far, late])
    inside = {(c, p, e) for c, p in PDUS for d, e, lo, hi in EPOCHS if c == d and lo <= p < hi}
    alone = {(c, p, None) for c, p in PDUS} - {(c, p, None) for c, p, _ in inside}
    assert {r for r in got if r[1] < 9000} == inside | alone and (1, 35, 0) not in got
    dropped = sum(o.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for o in p["stateOperators"])
    assert dropped >= 1
    # what can no longer meet anything has left the state
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 20


@pytest.mark.parametrize("cuts", CUTS)
def test_tracks(spark, tmp_path, cuts):
    spans = [(c, e, lo, hi) for c, e, lo, hi in EPOCHS if lo <= hi]

    def make(p, s):
        closed = s.select("channel_id", F.col("epoch_id").alias("track_id"), F.col("decode_start").alias("first_seq"), F.col("end_sample").alias("closed_seq"))
        return route_live(p.withColumnRenamed("pos", "seq"), closed, ["channel_id"], 100.0, 6.0, 32)

    got, _ = run(spark, (POINTS, PDUS), (SPANS, spans), make, str(tmp_path), cuts)
    tracked = spark.createDataFrame(spans, "channel_id int, track_id int, first_seq bigint, closed_seq bigint")
    want = T.route(spark.createDataFrame(PDUS, "channel_id int, seq bigint"), tracked, ["channel_id"], 32).collect()
    assert got == sorted(map(tuple, want), key=repr) and len(got) > 100


def test_too_long_range_fails(spark, tmp_path):
    def make(p, s):
        return assign_live(p, s, ["channel_id"], "pos", 100.0, 2.0, 64)

    with pytest.raises(Exception, match="longer than max_span_sec"):
        run(spark, (POINTS, PDUS), (SPANS, EPOCHS), make, str(tmp_path), CUTS[0])


def test_clashing_columns(spark):
    df = spark.createDataFrame(PDUS, POINTS)
    spans = spark.createDataFrame(EPOCHS, SPANS).withColumnRenamed("end_sample", "pos")
    with pytest.raises(ValueError, match="pos"):
        from radiolake.streaming.routing import interval_join_live

        interval_join_live(df, spans, ["channel_id"], "pos", "decode_start", "pos", 1.0, 1.0, 1.0)


def test_route_counts_equal_the_pairs(spark):
    import random

    rng = random.Random(3)
    tracks = []
    for i in range(300):
        a = rng.randrange(3000)
        tracks.append((i % 2, 1000 - i, a, rng.choice([None, a, a + rng.randrange(20), a + rng.randrange(2500), a - 5])))
    tracked = spark.createDataFrame(tracks, "channel_id long, track_id long, first_seq long, closed_seq long")
    batches = spark.range(0, 3600).selectExpr("id % 3 AS channel_id", "id AS seq")
    pairs = T.route(batches, tracked, ["channel_id"]).groupBy("channel_id", "seq")
    want = pairs.agg(F.count(F.lit(1)).alias("tracks"), F.min("track_id").alias("oldest"))
    for width in (8, 100):
        got = T.route_counts(batches, tracked, ["channel_id"], width)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
