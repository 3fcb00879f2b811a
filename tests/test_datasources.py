"""Recordings as a source, and streaming sinks with commits."""

import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from radiolake.sources import committed as C
from radiolake.sources import files as S
from radiolake.sources import recordings as R

COLS = ["name", "sequence_number", "start_sample", "end_sample", "timestamp_ns", "sample_rate_hz", "total_samples", "i", "q"]


def rows(df, cols=COLS):
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect())


def raw(n, seed=0):
    return np.random.default_rng(seed).integers(-30000, 30000, 2 * n).astype("<i2").tobytes()


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "rec"
    d.mkdir()
    (d / "a_8000.rawiq").write_bytes(raw(1003))
    (d / "b_8000.rawiq").write_bytes(raw(10, 1))
    x = raw(57, 2)
    wav = b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    (d / "c.wav").write_bytes(wav + b"data" + struct.pack("<I", len(x)) + x)
    (d / "d_8000.rawiq").write_bytes(raw(5) + b"x")  # not whole samples
    (d / "e_8000.rawiq").write_bytes(b"")
    return d


def test_named_rate_agrees_with_the_column(spark):
    names = ["/x/a_48000.rawiq", "2.4 MHz.rawiq", "y_2.5MHz.rawiq", "a_12.rawiq", "b.bin", "c\\d_8000.rawiq", ""]
    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", S.rate_from_name(F.col("p")).alias("r"))
    assert {r.p: r.r for r in df.collect()} == {n: S.named_rate(n) for n in names}


@pytest.mark.parametrize("task_bytes", [128 << 20, 400])
def test_batch_equals_the_table_function(spark, folder, task_bytes):
    R.register(spark)
    want = rows(S.iq_chunks(S.capture_catalog(spark, str(folder)), chunk_samples=100))
    source = spark.read.format("radio_iq").option("chunk_samples", 100).option("task_bytes", task_bytes)
    got = source.load(str(folder))
    assert rows(got) == want and len(want) == 13
    some = (F.col("start_sample") >= 300) & (F.col("end_sample") < 700) & F.col("path").endswith("a_8000.rawiq")
    assert rows(got.where(some)) == [r for r in want if r[0] == "a_8000.rawiq" and r[2] >= 300 and r[3] < 700]
    assert rows(got.where("sequence_number IN (0, 10)")) == [r for r in want if r[1] in (0, 10)]
    assert rows(source.load(f"{folder}/?_*.rawiq")) == [r for r in want if r[0] != "c.wav"]


def test_filters_leave_ranges_unread(folder):
    reader = R.RecordingReader(R._Options({"path": str(folder), "chunk_samples": "100", "task_bytes": "800"}))
    path = str(folder / "a_8000.rawiq")
    rest = list(
        reader.pushFilters([
            D.EqualTo(("path",), path), D.GreaterThanOrEqual(("start_sample",), 250), D.LessThan(("sequence_number",), 5),
            D.StringContains(("path",), "a"),
        ])
    )
    assert rest == [D.StringContains(("path",), "a")]
    shares = reader.partitions()
    assert {s.path for s in shares} == {path} and len(shares) == 6
    sizes = [b.column("sequence_number").to_pylist() for s in shares for b in reader.read(s)]
    assert sum(sizes, []) == [3, 4]


def test_nothing_and_wrong_options(spark, tmp_path):
    R.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("radio_iq").load(str(tmp_path / "none")).count() == 0
    for bad in ({"scale": "0"}, {"chunk_samples": "-1"}, {"replay": "backwards"}, {"replay": "once", "loops": "2"}):
        with pytest.raises(ValueError):
            R._Options({"path": "x"} | bad)


def drain(spark, source, tmp):
    q = source.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp}/out")


def test_rolling_recordings_go_on_where_they_stopped(spark, tmp_path):
    R.register(spark)
    d, data = tmp_path / "live", raw(530)
    d.mkdir()

    def go(**options):
        source = spark.readStream.format("radio_iq").option("chunk_samples", 100).option("task_bytes", 800)
        return drain(spark, source.options(**options).load(str(d)), tmp_path)

    (d / "r1_8000.rawiq").write_bytes(data[: 4 * 250 + 3])  # still being written, in the middle of a sample
    assert [r[1] for r in rows(go())] == [0, 1]
    (d / "r1_8000.rawiq").write_bytes(data)
    assert [r[1] for r in rows(go())] == [0, 1, 2, 3, 4]  # the short last chunk may still grow
    (d / "r2_8000.rawiq").write_bytes(raw(130, 5))
    go()
    got = rows(go(complete="true"))
    want = rows(S.iq_chunks(S.capture_catalog(spark, str(d)), chunk_samples=100))
    keep = [c for c in COLS if c != "total_samples"]
    out = rows(spark.read.parquet(f"{tmp_path}/out"), keep)
    assert out == [tuple(x for c, x in zip(COLS, r, strict=True) if c != "total_samples") for r in want] and len(got) == 8
    reader = R.RollingReader(R._Options({"path": str(d), "chunk_samples": "100"}))
    start = reader.latestOffset()
    (d / "r0_8000.rawiq").write_bytes(raw(100))
    with pytest.raises(ValueError, match="has passed"):
        reader.partitions(start, reader.latestOffset())


@pytest.mark.parametrize("mode,loops,silence", [("once", 1, 0), ("continuous-test", 3, 0), ("epoch-repeat", 3, 130)])
def test_replay_equals_the_timeline(spark, tmp_path, mode, loops, silence):
    R.register(spark)
    d = tmp_path / "rec"
    d.mkdir()
    (d / "a_8000.rawiq").write_bytes(raw(450))
    (d / "b_8000.rawiq").write_bytes(raw(120, 3))
    chunks = S.iq_chunks(S.capture_catalog(spark, str(d)), chunk_samples=100)
    cols = ["name", "sequence_number", "start_sample", "end_sample", "discontinuity", "loop_index", "is_silence", "i", "q"]
    want = rows(S.replay_timeline(chunks, ["path"], loops, mode, silence, 100), cols)
    options = {"chunk_samples": 100, "replay": mode, "loops": loops, "silence_samples": silence, "task_bytes": 1200}
    got = drain(spark, spark.readStream.format("radio_iq").options(**options).load(str(d)), tmp_path)
    assert rows(got, cols) == want
    # any cut of the timeline gives the same rows, and the clock sets the pace
    reader = R.ReplayReader(R._Options({k: str(v) for k, v in options.items()} | {"path": str(d)}))
    total = reader.latestOffset()["chunks"]
    seen = []
    for lo, hi in [(0, 2), (2, 3), (3, 9), (9, total)]:
        for share in reader.partitions({"chunks": min(lo, total)}, {"chunks": min(hi, total)}):
            seen += [(r["path"].rsplit("/", 1)[1], r["sequence_number"]) for b in reader.read(share) for r in b.to_pylist()]
    assert sorted(seen) == [r[:2] for r in want]
    reader.options.start_time = time.time() - 0.03  # 80 chunks a second
    assert 2 <= reader.latestOffset()["chunks"] <= total


def test_pdus_once_after_a_repeated_trigger(spark, tmp_path):
    schema = "protocol string, type string, src string, dst string, ts long, raw_bits string"
    data = [("DMR", "CALL", str(k), "9", k, "0101") for k in range(40)]
    df = spark.createDataFrame(data, schema)
    for n in range(2):
        df.where(F.col("ts") % 2 == n).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in/p{n}")
    out, ck = f"{tmp_path}/out", tmp_path / "ck"

    def go():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        q = C.stream_pdus(stream.parquet(f"{tmp_path}/in"), out, "pdus", str(ck), availableNow=True)
        q.awaitTermination(200)
        assert q.exception() is None
        return q

    def seen():
        return sorted(int(json.loads(r.value)["src"]) for r in C.read_committed(spark, out).collect())

    go()
    assert seen() == list(range(40))
    files = sorted(p.name for p in (tmp_path / "out" / "data").glob("*.txt"))
    last = max(int(p.name) for p in (ck / "commits").iterdir() if p.name.isdigit())
    for p in (ck / "commits").iterdir():  # the query was killed after the sink's commit and before its own
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    go()
    assert seen() == list(range(40))
    assert sorted(p.name for p in (tmp_path / "out" / "data").glob("*.txt")) == files  # written twice, kept once
    one = json.loads(C.read_committed(spark, out).first().value)
    assert "raw_bits" not in one and one["protocol"] == "DMR"
    (tmp_path / "out" / "data" / "pdus-killed.txt").write_text('{"src": "99"}\n')  # of an attempt that died
    assert seen() == list(range(40))


def test_lines_and_a_second_query(spark, tmp_path):
    schema = "protocol string, type string, src string, dst string, ts long"
    df = spark.createDataFrame([("DMR", "CALL", "1", "2", 5)], schema)
    df.write.parquet(f"{tmp_path}/in")
    for writer in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = C.stream_lines(stream, f"{tmp_path}/out", writer, f"{tmp_path}/ck-{writer}", availableNow=True)
        q.awaitTermination(200)
        assert q.exception() is None
    got = C.read_committed(spark, f"{tmp_path}/out").collect()
    assert len(got) == 2 and got[0].value == got[1].value
    with pytest.raises(ValueError, match="writer_id"):
        C.stream_lines(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/o", "a/b", f"{tmp_path}/c", availableNow=True)
