"""Operators against hand-derived numbers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.functions.formats import fixed_text, general_text
from radiolake.operators import activity as A
from radiolake.operators import conform as C
from radiolake.operators import evidence as E
from radiolake.operators import spectrum as P
from radiolake.operators import tracking as T
from radiolake.sources import files as S


def chunk_rows(spark, powers, size=100, rate=1000.0, gaps=()):
    rows, at = [], 0
    for n, p in enumerate(powers):
        at += gaps[n] if n < len(gaps) else 0
        rows.append((1, n, at, at + size, rate, False, 0, float(p)))
        at += size
    return spark.createDataFrame(
        rows, "channel_id long, seq long, start_sample long, end_sample long, sample_rate_hz double, discontinuity boolean, dropped_samples long, power_db double"
    )


CFG = A.ActivityConfig(min_on_sec=0.1, off_hang_sec=0.3)


@pytest.mark.parametrize("width", [2, 1 << 16])
def test_short_and_long_silence(spark, width):
    def eps(powers):
        got = A.decode_ranges(A.epochs(A.detect_fixed(chunk_rows(spark, powers), -60.0, CFG, width=width), width=width), 100).collect()
        return sorted((r.candidate_start, r.end_sample, r.close_reason, r.decode_start) for r in got)

    # 500 on, 200 off, 500 on: one epoch to the end
    assert eps([0] * 5 + [-160] * 2 + [0] * 5) == [(0, 1200, "end_of_input", 0)]
    # 500 on, 1000 off, 500 on: two epochs
    assert eps([0] * 5 + [-160] * 10 + [0] * 5) == [(0, 800, "rf_activity_ended", 0), (1500, 2000, "end_of_input", 1400)]


def test_fsm_states(spark):
    """noise, signal, signal, noise, noise of three samples each at rate 100."""
    cfg = A.ActivityConfig(min_on_sec=0.05, off_hang_sec=0.05)
    act = A.detect_fixed(chunk_rows(spark, [-60, 0, 0, -60, -60], size=3, rate=100.0), -60.0, cfg)
    rows = sorted(A.with_states(act).collect(), key=lambda r: r.seq)
    assert [r.state for r in rows] == ["NO_SIGNAL", "ACTIVITY_PENDING", "CLASSIFYING", "CLASSIFYING", "NO_SIGNAL"]
    assert A.epochs(act).collect()[0].candidate_start == 3


def test_gap(spark):
    rows = sorted(A.with_generations(chunk_rows(spark, [0, 0, 0], size=12, gaps=(0, 8, 0))).collect(), key=lambda r: r.seq)
    assert [(r.reset, r.gap_samples, r.generation) for r in rows] == [(False, 0, 0), (True, 8, 1), (False, 0, 1)]


def test_adaptive_equals_fixed_with_known_floor(spark):
    rng = np.random.default_rng(1)
    df = chunk_rows(spark, rng.choice([-70.0, -50.0, -20.0], 120), gaps=[0] * 40 + [50]).withColumn("spectral_floor_db", F.lit(None).cast("double"))
    cfg = A.ActivityConfig(min_on_sec=0.2, off_hang_sec=0.3, noise_floor_db=-60.0)
    cols = ["seq", "phase", "is_active", "started", "ended"]
    key = lambda d: sorted(tuple(r) for r in d.select(*cols).collect())
    assert key(A.detect_adaptive(df, cfg, width=13)) == key(A.detect_fixed(df, -60.0, cfg))


def test_track_lifecycle(spark):
    """hit, hit, three misses, hit, six misses of 10 ms."""
    cfg = T.TrackConfig(min_on_sec=0.02, off_hang_sec=0.05)
    hits = [1, 1, 0, 0, 0, 1] + [0] * 6
    rows = [(1, n, 0.01, False, 0, n * 100, [(1000.0 + n, 20.0)] if h else []) for n, h in enumerate(hits)]
    df = spark.createDataFrame(
        rows, "capture_id long, seq long, duration_sec double, discontinuity boolean, generation long, end_sample long, detections array<struct<frequency_offset_hz:double,snr_db:double>>"
    )
    for width in (3, 1 << 16):
        ev = sorted(T.track_events(df, ["capture_id"], cfg, width).collect(), key=lambda r: (r.seq, r.position))
        assert [(r.seq, r.event) for r in ev] == [
            (0, "TRACK_STARTED"), (1, "TRACK_ACTIVATED"), (2, "TRACK_OFF_PENDING"), (5, "TRACK_REACQUIRED"), (6, "TRACK_OFF_PENDING"), (10, "TRACK_CLOSED"),
        ]
        assert {r.track_id for r in ev} == {1}


def iq_table(spark, x, rate, cuts):
    rows = []
    for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True):
        rows.append((1, a, b, len(x), rate, [float(v) for v in x[a:b].real], [float(v) for v in x[a:b].imag]))
    return spark.createDataFrame(rows, "capture_id long, start_sample long, end_sample long, total_samples long, sample_rate_hz double, i array<double>, q array<double>")


def test_welch_matches_direct(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1500) + 1j * rng.normal(size=1500)
    n, w = 256, 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(256) / 255)
    starts = range(0, 1500 - n + 1, n // 2)
    want = np.fft.fftshift(np.mean([np.abs(np.fft.fft(x[s : s + n] * w)) ** 2 for s in starts], axis=0) / (8000.0 * np.sum(w**2)))
    for cuts in ([], [100, 190, 777, 1201]):
        got = P.welch_psd(iq_table(spark, x, 8000.0, cuts), ["capture_id"], n).orderBy("bin").collect()
        assert np.allclose([r.power for r in got], want) and got[0].freq_hz == -4000.0


def test_two_carriers(spark):
    """Carriers 3125 Hz either side of zero at 192 kHz are both found within 1 kHz."""
    rng, n, rate = np.random.default_rng(7), 16384, 192000.0
    t = np.arange(n) / rate
    x = np.exp(2j * np.pi * 3125 * t) + np.exp(-2j * np.pi * 3125 * t) + 0.01 * (rng.normal(size=n) + 1j * rng.normal(size=n))
    psd = P.welch_psd(iq_table(spark, x, rate, [5000, 5001, 12000]), ["capture_id"], 4096)
    got = sorted(r.freq_hz for r in P.blind_search(psd, ["capture_id"], rate / 4096, 15.0, 2400.0, 5000.0).collect())
    assert len(got) == 2 and abs(got[0] + 3125) < 1000 and abs(got[1] - 3125) < 1000


def test_tune_matches_convolution(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=700) + 1j * rng.normal(size=700)
    h = P.lowpass_taps(500.0, 8000.0, 33)
    want = np.convolve(x * np.exp(-2j * np.pi * 900.0 * np.arange(700) / 8000.0), h)[:700:8]
    for cuts in ([], [5, 20, 200, 333, 340, 650]):
        rows = P.tune(iq_table(spark, x, 8000.0, cuts), ["capture_id"], [900.0], 8, 500.0, 33).collect()
        got = np.zeros(len(want), complex)
        for r in rows:
            got[r.start_sample : r.end_sample] += np.array(r.re) + 1j * np.array(r.im)
        assert sum(r.end_sample - r.start_sample for r in rows) == len(want) and np.allclose(got, want)


def test_spectral_noise(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=8192) + 1j * rng.normal(size=8192)) / np.sqrt(2)
    df = A.spectral_noise(iq_table(spark, x, 1000.0, [8192 - 32]))
    got = sorted((r.start_sample, r.spectral_floor_db) for r in df.collect())
    assert abs(got[0][1]) < 0.5 and got[1][1] is None


def test_smoothing_leans(spark):
    """Six bins, four wide: the carrier search reaches up, the refinement reaches down."""
    df = spark.createDataFrame([(1, b, b * 1.0, float(2**b)) for b in range(6)], "capture_id long, bin long, freq_hz double, power double")
    got = [r.channel_power for r in P.smooth_bins(df, ["capture_id"], 4).orderBy("bin").collect()]
    assert got == [7 / 3, 15 / 4, 30 / 4, 60 / 4, 56 / 3, 48 / 2]


def test_sweep_percentiles(spark):
    cond = spark.createDataFrame([(6.0, 0.0, True, w) for w in (0.2, 0.3, 0.4)], "snr_db double, shift_hz double, confirmed boolean, minimum_sec double")
    r = E.sweep_summary(cond).collect()[0]
    assert (round(r.p50_sec, 6), round(r.p95_sec, 6), round(r.p99_sec, 6)) == (0.3, 0.39, 0.398)


def test_decimated_rates(spark):
    df = spark.createDataFrame([(61.44e6,), (2.5e6,), (7.0,)], "input_rate_hz double")
    got = [(r.adapted, r.output_rate_hz, r.decimation) for r in C.decimated_rate(df).collect()]
    assert got == [(False, 120000.0, 512), (True, 125000.0, 20), (True, None, None)]


def test_fixed_text(spark):
    df = spark.createDataFrame([(0.0625,), (-1.25,), (9.9999,), (1704103775.1185,)], "x double")
    got = [tuple(r) for r in df.select(fixed_text(F.col("x"), 3), fixed_text(F.col("x"), 1, sign=True)).collect()]
    assert [g[0] for g in got] == [f"{v:.3f}" for v in (0.0625, -1.25, 9.9999, 1704103775.1185)]
    assert [g[1] for g in got] == [f"{v:+.1f}" for v in (0.0625, -1.25, 9.9999, 1704103775.1185)]


def test_replay(spark):
    rows = [(1, 0, 0, 2, False), (1, 1, 2, 4, False), (1, 2, 4, 5, False)]
    df = spark.createDataFrame(rows, "capture_id long, sequence_number long, start_sample long, end_sample long, discontinuity boolean")
    out = S.replay_timeline(df, ["capture_id"], 3, "continuous-test").orderBy("sequence_number").collect()
    assert [r.start_sample for r in out] == [0, 2, 4, 5, 7, 9, 10, 12, 14] and not any(r.discontinuity for r in out)
    out = S.replay_timeline(df, ["capture_id"], 2, "epoch-repeat", 3, 2).orderBy("sequence_number").collect()
    assert [r.is_silence for r in out] == [False] * 3 + [True] * 2 + [False] * 3
    assert (out[3].end_sample - out[3].start_sample, out[4].end_sample - out[4].start_sample) == (2, 1)
    assert (out[5].start_sample, out[5].discontinuity, out[7].end_sample) == (8, True, 13)


def test_captures(spark, tmp_path):
    x = (np.arange(20) * 100).astype("<i2")
    (tmp_path / "a_48000.rawiq").write_bytes(x.tobytes())
    (tmp_path / "odd_48000.rawiq").write_bytes(x.tobytes()[:-2])
    (tmp_path / "b_2.5MHz.rawiq").write_bytes(x.tobytes())
    head = bytearray(112)
    head[8:16] = struct.pack("<Q", 112 + 40)
    head[32:36] = b"usrp"
    head[48:60] = struct.pack("<III", 61440000, 40000000, 430000)
    (tmp_path / "c.bvsp").write_bytes(bytes(head) + x.tobytes())
    wav = b"RIFF" + struct.pack("<I", 76) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 40)
    (tmp_path / "d.wav").write_bytes(wav + x.tobytes())
    cat = S.capture_catalog(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in cat.collect()}
    assert (got["a_48000.rawiq"].total_samples, got["a_48000.rawiq"].sample_rate_hz) == (10, 48000.0)
    assert not got["odd_48000.rawiq"].is_valid and got["b_2.5MHz.rawiq"].sample_rate_hz == 2.5e6
    b = got["c.bvsp"]
    assert (b.is_valid, b.device, b.sample_rate_hz, b.center_frequency_hz, b.header_bytes) == (True, "usrp", 61440000.0, 4.3e8, 112)
    assert (got["d.wav"].is_valid, got["d.wav"].sample_rate_hz, got["d.wav"].total_samples) == (True, 8000.0, 10)
    chunks = S.iq_chunks(cat, chunk_samples=4).where(F.col("path").endswith("d.wav") | F.col("path").endswith("c.bvsp"))
    rows = sorted(chunks.collect(), key=lambda r: (r.path, r.start_sample))
    assert [(r.start_sample, r.end_sample) for r in rows] == [(0, 4), (4, 8), (8, 10)] * 2
    assert rows[1].i[0] == pytest.approx(800 / 32768) and rows[4].q[1] == pytest.approx(1100 / 32768)


def test_modulation_gate(spark):
    rng, rate, n = np.random.default_rng(3), 125000.0, 31250
    fsk = np.exp(1j * np.cumsum(rng.choice([-0.03, -0.01, 0.01, 0.03], n)))
    steps = np.repeat(rng.choice([np.pi / 4, -np.pi / 4, 3 * np.pi / 4, -3 * np.pi / 4], n // 4 + 1), 4)[:n] * np.tile([1, 0, 0, 0], n // 4 + 1)[:n]
    psk = np.exp(1j * np.cumsum(steps))
    rows = [(k, rate, [float(v) for v in x.real], [float(v) for v in x.imag]) for k, x in (("fsk", fsk), ("psk", psk), ("short", fsk[:100]))]
    df = spark.createDataFrame(rows, "name string, sample_rate_hz double, i array<double>, q array<double>")
    got = {r.name: r for r in P.modulation_gate(df, ["name"]).collect()}
    assert got["fsk"].family == "fsk4" and got["fsk"].confidence >= 0.9
    assert got["short"].reason == "awaiting_modulation_analysis_window" and got["psk"].family in ("pi4dqpsk", "uncertain")


def test_waterfall_matches_direct(spark):
    rng = np.random.default_rng(6)
    x, n = rng.normal(size=1000) + 1j * rng.normal(size=1000), 64
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    got = P.waterfall(iq_table(spark, x, 8000.0, [90, 333, 640]), ["capture_id"], n, 300).collect()
    rows = {}
    for r in sorted(got, key=lambda r: (r.row, r.bin)):
        rows.setdefault(r.row, []).append(r.power)
    assert sorted(rows) == [0, 1, 2, 3]
    for row, power in rows.items():
        part = x[row * 300 : min(1000, row * 300 + 300)]
        frames = part[: len(part) // n * n].reshape(-1, n)
        want = np.fft.fftshift(np.mean(np.abs(np.fft.fft(frames * w, axis=1)) ** 2, axis=0) / (8000.0 * np.sum(w**2)))
        assert np.allclose(power, want)


def test_fine_candidates(spark):
    """A bin with a peak yields it; a flat one yields its strongest frequency."""
    flat = [1.0 + 0.001 * b for b in range(16)]
    peak = [1.0] * 16
    peak[6] = 500.0
    fine = [(1, c, b, b * 100.0, p) for c, ps in ((0, peak), (1, flat), (2, flat)) for b, p in enumerate(ps)]
    fine = spark.createDataFrame(fine, "batch long, coarse_bin long, bin long, freq_hz double, power double")
    active = spark.createDataFrame(
        [(1, 0, -10.0, -30.0, 4e8, 0.0), (1, 1, -12.0, -30.0, 4e8, 1600.0)],
        "batch long, coarse_bin long, power_db double, noise_floor_db double, center_hz double, coarse_center_offset_hz double",
    )
    rows = P.fine_candidates(active, fine, ["batch"], 100.0, 8.0, 100.0, 500.0).collect()
    got = sorted((r.coarse_bin, r.frequency_offset_hz, r.snr_db) for r in rows)
    # three bins are averaged, so the earliest of the plateau around bin 6 is its peak
    assert got == [(0, 500.0, 20.0), (1, 3100.0, 18.0)]


def test_floor_sources(spark):
    """Spectral estimates are due every half second; between them the smoothed past counts,
    and a jump asks for a fresh estimate."""
    df = chunk_rows(spark, [-60.0] * 7 + [-20.0] + [-60.0] * 2)
    floors = F.when(F.col("seq").isin(1, 2), None).otherwise(F.when(F.col("seq") == 7, -25.0).otherwise(-62.0))
    rows = A.detect_adaptive(df.withColumn("spectral_floor_db", floors), CFG, width=3).orderBy("seq").collect()
    assert [r.noise_source for r in rows] == ["spectral"] + ["temporal"] * 4 + ["spectral", "temporal", "spectral_triggered"] + ["temporal"] * 2
    assert not any(r.is_active for r in rows) and rows[7].noise_floor_db == -25.0


def test_live_average_remembers_everything(spark):
    from radiolake.operators import spectrum as S

    power = [float(i * 37 % 101) for i in range(1500)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(power)], "bin int, k bigint, power double")
    for alpha in (0.0001, 0.002, 0.25, 0.9, 1.0):
        live = S.live_average(df, ["bin"], "k", alpha)
        got = {r.k: r.average for r in live.collect()}
        value = power[0]
        for i, x in enumerate(power):
            value = x if i == 0 else (1 - alpha) * value + alpha * x
            assert abs(got[i] - value) < 1e-9


def test_live_average_gathers_no_key(spark):
    """No list over a key at any level, and a long series still equals the sequential rule."""
    from radiolake.operators import spectrum as S

    df = spark.range(200_000).select(F.lit(0).alias("bin"), F.col("id").alias("k"), (F.col("id") * 37 % 101).cast("double").alias("power"))
    for alpha in (0.00001, 0.9):
        tree = S._decayed_sum(df, ["bin"], "k", "power", 1.0 - alpha, "y")
        assert "collect_list" not in tree._jdf.queryExecution().toString()
        last = tree.where("k IN (511, 512, 1024, 199999)").select("k", "y").collect()
        want, y = {}, 0.0
        for k in range(200_000):
            y = (1.0 - alpha) * y + float(k * 37 % 101)
            want[k] = y
        assert len(last) == 4 and all(abs(r.y - want[r.k]) <= 1e-9 * want[r.k] for r in last)


def test_window_with_a_gap_is_decoded_in_stretches(spark):
    import pandas as pd

    from radiolake.operators.decode import decode_windows

    chunks = spark.createDataFrame(
        [(1, 0, 4, 1.0, [0.0, 1.0, 2.0, 3.0], [0.0] * 4), (1, 8, 12, 1.0, [8.0, 9.0, 10.0, 11.0], [0.0] * 4)],
        "cap int, start_sample bigint, end_sample bigint, sample_rate_hz double, i array<double>, q array<double>",
    )
    windows = spark.createDataFrame([(1, 0, 2, 10)], "cap int, window_id int, start_sample bigint, end_sample bigint")

    def decoder(iq, rate, window):
        return pd.DataFrame({"first": [int(iq[0].real)], "n": [len(iq)], "at": [window["start_sample"]]})

    def run(gaps):
        out = decode_windows(chunks, windows, ["cap"], decoder, "first long, n long, at long", 4.0, gaps).collect()
        return sorted((r["first"], r["n"], r["at"]) for r in out)

    assert run("split") == [(2, 2, 2), (8, 2, 8)]
    assert run("zero") == [(2, 8, 2)]


def test_running_value_of_a_null_key(spark):
    from pyspark.sql import functions as F

    from radiolake.functions.ordered import scan, upto

    df = spark.createDataFrame([(None, i, 1) for i in range(10)], "key int, seq bigint, x int")
    out = scan(df, ["key"], "seq", [upto("n", "sum", F.col("x"))], width=3)
    assert sorted(r.n for r in out.collect()) == list(range(1, 11))


def test_wav_sample_types(spark, tmp_path):
    import struct

    from radiolake.sources import files as S

    def wav(name, code, bits, payload, before=b"", extensible=False):
        align = 2 * bits // 8
        fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else code, 2, 8000, 8000 * align, align, bits)
        if extensible:
            fmt += struct.pack("<HHIH", 22, bits, 3, code) + bytes(14)
        body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + before + b"data" + struct.pack("<I", len(payload)) + payload
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)

    wav("u8.wav", 1, 8, bytes([128, 128, 255, 0]))
    wav("i16.wave", 1, 16, struct.pack("<4h", 16384, -16384, 0, 1))
    wav("i24.wav", 1, 24, b"\x00\x00\x40\x00\x00\xc0" + bytes(6))
    wav("f32.dat", 3, 32, struct.pack("<4f", 0.5, -0.5, 0, 1), extensible=True)
    wav("late.wav", 3, 64, struct.pack("<4d", 0.25, -1, 0, 1), before=b"LIST" + struct.pack("<I", 100_000) + bytes(100_000))
    wav("alaw.wav", 6, 8, bytes(4))
    cat = S.capture_catalog(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in cat.collect()}
    assert {n: r.dtype for n, r in got.items() if r.is_valid} == {
        "u8.wav": "uint8", "i16.wave": "int16", "i24.wav": "int24", "f32.dat": "float32", "late.wav": "float64",
    }
    assert not got["alaw.wav"].is_valid
    chunks = {r.path.rsplit("/", 1)[1]: r for r in S.iq_chunks(cat, chunk_samples=1).where("sequence_number = 0").collect()}
    first = {n: (r.i[0], r.q[0]) for n, r in chunks.items()}
    assert first == {
        "u8.wav": (0, 0), "i16.wave": (0.5, -0.5), "i24.wav": (0.5, -0.5), "f32.dat": (0.5, -0.5), "late.wav": (0.25, -1),
    }
    one = S.iq_chunks(cat.where("path LIKE '%i16%'"), chunk_samples=1, task_bytes=1)
    assert one.rdd.getNumPartitions() >= 8


def test_parity_report_shows_both_sides(spark):
    from radiolake.operators import compare as C

    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k long, v string")
    got = {tuple(r) for r in C.parity_report(a, b, ["k", "v"]).collect()}
    assert got == {(1, "x", 2, 1, False), (None, "y", 1, 1, True), (2, "z", 1, 0, False), (3, "z", 0, 1, False)}


def test_silent_and_missing_buckets_end_a_run(spark):
    from types import SimpleNamespace

    from radiolake.plans.q_activity import _env

    rows = [(0, i, v) for i, v in enumerate([1.0, 50.0, 0.0, 50.0, 50.0])] + [(0, 7, 50.0)]
    env = _env(SimpleNamespace(chunks=spark.createDataFrame(rows, "channel_id long, seq long, value double")))
    assert env.where("bucket = 3").first()["power_db"] == pytest.approx(-120.0)
    thr = spark.createDataFrame([(0, 10.0)], "channel_id long, threshold_db double")
    runs = A.active_runs(env, thr, ["channel_id"]).collect()
    assert sorted((r["run_start"], r["run_end"], r["length"]) for r in runs) == [(2, 2, 1), (4, 5, 2), (8, 8, 1)]


def test_best_window_takes_the_first_of_equal_runs(spark):
    # the same levels in two orders; their sums differ in the last digit
    levels = [0.0] * 9 + [20.6, 20.2, 20.0] + [0.0] * 9 + [20.0, 20.2, 20.6] + [0.0] * 16
    env = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(levels)], "channel_id long, bucket long, power_db double").coalesce(1)
    captures = spark.createDataFrame([(1, len(levels) * 48)], "channel_id long, sample_count long")
    assert (20.0 + 20.2) + 20.6 > (20.6 + 20.2) + 20.0
    best = A.best_window(env, captures, ["channel_id"], 48000.0, A.WindowConfig(active_pad_sec=0.0)).first()
    assert (best["start_sample"], best["end_sample"]) == (9 * 48 + 1, 12 * 48)


def test_general_text_is_exact(spark):
    rng = np.random.default_rng(5)
    ties = [1346.625, 1248.625, 1248.375, 1346.6255, 112500.5, 112501.5, 999999.5, 0.5, -1346.625, 1.0000005, 99999.95, 0.000123456789, 2.5e-5, 1.5e-7, 1234567.5]
    values = ties + [float(x) for x in rng.integers(1, 8 * 10**6, 2000) / 8] + [float(f"{x:.7g}") for x in 10 ** rng.uniform(-6, 6, 2000)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.select("x", general_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != ("%.0f" if r.x == int(r.x) else "%g") % r.x] == []
