"""Scans, percentiles, block state machines and keys against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiolake.functions import bits as B
from radiolake.functions import keys as K
from radiolake.functions import lookups as L
from radiolake.functions import ordered as O
from radiolake.functions import payload
from radiolake.functions.joins import interval_join
from radiolake.functions.stats import grouped_quantiles, linear_of, midpoint_of, nearest_of
from radiolake.operators import sessions as S


@pytest.fixture(scope="module")
def numbers(spark):
    """One key holds most rows; order values have gaps."""
    rng = random.Random(3)
    rows, seq = [], 0
    for _ in range(600):
        seq += rng.randint(1, 9)
        rows.append((0 if rng.random() < 0.7 else rng.randint(1, 3), seq, rng.randint(-5, 5), rng.random() < 0.2))
    return spark.createDataFrame(rows, "k long, seq long, v long, f boolean"), rows


@pytest.mark.parametrize("width", [16, 100, 1 << 20])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan(numbers, width, reverse):
    df, rows = numbers
    flagged = F.when(F.col("f"), F.col("seq"))
    out = O.scan(
        df, ["k"], "seq",
        [
            O.before("s", "sum", F.col("v")), O.upto("si", "sum", F.col("v")), O.before("m", "max", flagged),
            O.before("l", "last", F.when(F.col("f"), F.struct("seq", "v"))), O.upto("mn", "min", F.col("v")),
        ],
        width, reverse,
    )
    got = {r.seq: r for r in out.collect()}
    assert len(got) == len(rows)
    for key in range(4):
        s, last, low, mx = 0, None, None, None
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=reverse)
        for _, seq, v, f in mine:
            r = got[seq]
            assert (r.s, r.si, r.m) == (s, s + v, mx)
            assert (r.l and tuple(r.l)) == last
            low = v if low is None else min(low, v)
            assert r.mn == low
            s += v
            if f:
                last, mx = (seq, v), seq if mx is None else max(mx, seq)


@pytest.mark.parametrize("width", [4, 64, 1 << 20])
def test_lags(numbers, width):
    df, rows = numbers
    got = {r.seq: r for r in O.with_lags(df, ["k"], "seq", ["v"], 3, width).collect()}
    for key in range(4):
        mine = sorted(r for r in rows if r[0] == key)
        for i, (_, seq, _, _) in enumerate(mine):
            want = [mine[i - n][2] if i >= n else None for n in (1, 2, 3)]
            assert [r and r.v for r in (got[seq].lag1, got[seq].lag2, got[seq].lag3)] == want


def _rule(rule, x, p):
    x, n = np.sort(x), len(x)
    if rule == "nearest":
        return x[max(1, min(n, int(np.ceil(p * n)))) - 1]
    if rule == "linear":
        return np.percentile(x, p * 100)
    return float(np.interp(p, (np.arange(1, n + 1) - 0.5) / n, x))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_percentile_rules(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 20, n), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x}))
    wanted = {"a": ("midpoint", 0.2), "b": ("linear", 0.95), "c": ("nearest", 0.75), "d": ("midpoint", 0.95), "e": ("linear", 0.5)}
    got = grouped_quantiles(df, ["k"], "x", wanted, 0.7).collect()[0]
    arr = df.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("s"))
    own = arr.select(
        midpoint_of(F.col("s"), 0.2).alias("a"), linear_of(F.col("s"), 0.95).alias("b"), nearest_of(F.col("s"), 0.75).alias("c"),
        midpoint_of(F.col("s"), 0.95).alias("d"), linear_of(F.col("s"), 0.5).alias("e"),
    ).collect()[0]
    for name, (rule, p) in wanted.items():
        want = _rule(rule, x, p)
        assert got[name] == pytest.approx(want, abs=1e-9), (rule, p)
        assert own[name] == pytest.approx(want, abs=1e-9), (rule, p)


def test_interval_join(spark):
    pts = spark.createDataFrame([(1, i) for i in range(50)], "k long, t long")
    spans = spark.createDataFrame([(1, 7, 3, 12), (1, 8, 10, 10), (1, 9, 40, 90)], "k long, id long, a long, b long")
    got = sorted((r.t, r.id) for r in interval_join(pts, spans, ["k"], "t", "a", "b", 4).collect())
    assert got == sorted([(t, 7) for t in range(3, 12)] + [(t, 9) for t in range(40, 50)])


def test_bits(spark):
    df = spark.createDataFrame([("DEADBEEF01",), ("0",)], "h string")
    bits = df.select(B.hex_to_bits(F.col("h")).alias("b")).collect()
    assert bits[0].b == f"{0xDEADBEEF01:040b}" and bits[1].b == "0000"
    row = spark.range(1).select(
        B.bits_to_hex(F.lit("1111000")).alias("hex"), B.dibits_to_bits(F.lit("0123")).alias("d"), B.bits_to_dibits(F.lit("00011")).alias("p")
    ).collect()[0]
    assert (row.hex, row.d, row.p) == ("F0", "00011011", "01")


def test_nxdn_voice_call(spark):
    """Known message: source 1203, destination 0, conference group, mode 2."""
    fields = [("00", 2), (f"{1:06b}", 6), ("00000000", 8), ("001", 3), (f"{2:05b}", 5), (f"{1203:016b}", 16), ("0" * 16, 16), ("0" * 8, 8)]
    bits = "".join(f for f, _ in fields)
    r = spark.range(1).select(payload.nxdn_layer3(F.lit(bits)).alias("m")).collect()[0].m
    assert (r.type, r.src, r.dst, r.call_type, r.transmission_mode) == ("NXDN_VCALL", 1203, 0, "conference_group", 2)


def test_air_id_and_color(spark):
    r = spark.range(1).select(
        L.dpmr_air_id(F.lit(10 * 11**5 + 3 * 11**4 + 9)).alias("a"), L.dpmr_color_code(F.lit(0x575F77)).alias("c"),
        L.dpmr_color_code(F.lit(0)).alias("n"),
    ).collect()[0]
    assert (r.a, r.c, r.n) == ("0*30009", 0, -1)


def test_persistent_and_timed_keys(spark):
    """A call keeps one key wherever it is seen; without semantic dedup it does not."""
    df = spark.createDataFrame(
        [("P25_CALL", 100), ("P25_CALL", 2000)], "type string, s long"
    ).select(F.lit("P25").alias("protocol"), "type", F.lit(48000.0).alias("sample_rate_hz"), F.struct(F.struct(F.col("s").alias("source_sample")).alias("stream")).alias("extra"))
    same = df.select(F.to_json(K.stream_key(df)).alias("k")).distinct().count()
    timed = df.select(F.to_json(K.stream_key(df, semantic=False)).alias("k")).distinct().count()
    assert (same, timed) == (1, 2)


# ---- dPMR calls against a sequential walk


def _walk_dpmr(frames):
    calls, s = [], None
    for f in frames:
        if s is not None:
            split = f["cc"] is not None and s["cc"] is not None and f["cc"] != s["cc"]
            if not split and f["src"] and f["dst"] and s["src"] and s["dst"]:
                split = f["src"] != s["src"] or f["dst"] != s["dst"]
            if split:
                calls.append(s)
                s = None
        if s is None:
            s = {"start": f["seq"], "src": "", "dst": "", "cc": None, "rec": {}, "voice": 0, "cch": 0, "modes": []}
        s["voice"] += f["type"] == "DPMR_VOICE"
        s["src"], s["dst"] = f["src"] or s["src"], f["dst"] or s["dst"]
        if f["cc"] is not None and f["cc"] >= 0:
            s["cc"] = f["cc"]
        for n, half, crc, ham, mode in f["cch"]:
            if not (crc or ham):
                continue
            s["cch"] += 1
            if n not in s["rec"] or (crc and not s["rec"][n][1]):
                s["rec"][n] = (half, crc)
            if mode not in s["modes"]:
                s["modes"].append(mode)
        for name, a, b in (("dst", 0, 1), ("src", 2, 3)):
            if s["rec"].get(a, (0, False))[1] and s["rec"].get(b, (0, False))[1]:
                s[name] = S._air_id_text((s["rec"][a][0] << 12 | s["rec"][b][0]) & 0xFFFFFF)
    return calls + ([s] if s else [])


@pytest.mark.parametrize("width", [5, 40, 1 << 16])
def test_dpmr_calls(spark, width):
    rng = random.Random(11)
    rows = []
    for seq in range(160):
        cc = rng.choice([5, 5, 5, 5, 5, 6, -1, None])
        ids = rng.random() < 0.15
        cch = [(rng.randint(0, 3), rng.randint(0, 40), rng.random() < 0.3, rng.random() < 0.6, rng.randint(0, 2)) for _ in range(rng.randint(0, 2))]
        rows.append({"seq": seq, "ch": seq % 2, "type": rng.choice(["DPMR_HEADER", "DPMR_VOICE"]), "cc": cc,
                     "src": rng.choice(["11", "12"]) if ids else "", "dst": "20" if ids else "", "cch": cch})
    cch_type = "array<struct<frame_number:long,id_half:long,crc_ok:boolean,hamming_ok:boolean,communication_mode:long,version:long,comms_format:long,emergency_priority:long>>"
    data = [
        (r["ch"], r["seq"], r["type"], r["src"], r["dst"], (r["cc"], r["seq"] * 100, "FS2", [(*c[:4], c[4], 0, 0, 0) for c in r["cch"]]))
        for r in rows
    ]
    schema = f"channel_id long, seq long, type string, src string, dst string, extra struct<color_code:long,fs_start:long,sync_type:string,cch:{cch_type}>"
    got = S.dpmr_calls(spark.createDataFrame(data, schema), width=width).collect()
    got = sorted((r.channel_id, r.start_seq, r.src, r.dst, r.color_code, r.voice_count, r.cch_count, tuple(r.communication_modes)) for r in got)
    want = []
    for ch in (0, 1):
        for s in _walk_dpmr([r for r in rows if r["ch"] == ch]):
            want.append((ch, s["start"], s["src"], s["dst"], s["cc"], s["voice"], s["cch"], tuple(s["modes"])))
    assert got == sorted(want, key=lambda t: t[:2])


def test_dmr_call_numbers(spark):
    """Start 332292, end 470532 at 48 kHz is 2.88 s; an unfinished call closes at end of scan."""
    rows = [(1, 0, "LC_HEADER", 332292)] + [(1, n, "LATE_ENTRY", 332292 + n * 17280) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "channel_id long, seq long, type string, s long").select(
        "channel_id", "seq", "type", F.lit(7).alias("src_num"), F.lit(9).alias("dst_num"), F.lit("GroupVoiceChannelUser").alias("flco"),
        F.struct(F.col("s").alias("fs_start")).alias("extra"),
    )
    r = S.dmr_calls(df).collect()[0]
    assert (r.duration_s, r.signalling_count, r.late_entry_count, r.call_type, r.closed_by) == (2.88, 9, 8, "group", "end_of_scan")


def test_chain_merge(spark):
    from radiolake.operators.dedup import chain_merge

    rng = random.Random(2)
    rows = [(1, n, rng.randint(0, 4000), rng.randint(0, 3), rng.randint(0, 9) / 10, rng.random()) for n in range(200)]
    kept = []
    for c in sorted(rows, key=lambda r: (r[2], r[3], r[4], -r[5])):
        if kept and c[2] - kept[-1][2] < 60:
            if (c[3], c[4], -c[5]) < (kept[-1][3], kept[-1][4], -kept[-1][5]):
                kept[-1] = c
        else:
            kept.append(c)
    df = spark.createDataFrame(rows, "channel_id long, seq long, fs_start long, errors long, resid double, ncc double")
    assert sorted(r.seq for r in chain_merge(df, ["channel_id"], 60).collect()) == sorted(k[1] for k in kept)


@pytest.mark.parametrize("shape", ["random", "ramp", "ties", "fractions"])
def test_long_chains_are_settled_in_rounds(spark, shape):
    """Chains cut to small blocks give the choice of the plain greedy walk."""
    from radiolake.operators.spectrum import suppress_neighbours

    rng = random.Random(5)
    score = {"random": lambda p: rng.random(), "ramp": lambda p: p / 10, "ties": lambda p: float(p % 2), "fractions": lambda p: rng.random()}[shape]
    step = 0.7 if shape == "fractions" else 1
    places = [-300, *sorted(rng.sample(range(-250, 900), 500)), 2000]
    rows = [(ch, p * step, score(p)) for ch in (1, 2) for p in places]
    want = []
    for ch in (1, 2):
        kept = []
        for _, p, _ in sorted((r for r in rows if r[0] == ch), key=lambda r: (-r[2], r[1])):
            if all(abs(p - q) >= 7 for q in kept):
                kept.append(p)
        want += [(ch, p) for p in kept]
    df = spark.createDataFrame(rows, f"channel_id long, pos {'double' if step < 1 else 'long'}, level double")
    for long_chain in (20, 4096):
        got = suppress_neighbours(df, ["channel_id"], "pos", "level", 7, long_chain=long_chain)
        assert sorted((r.channel_id, r.pos) for r in got.collect()) == sorted(want)


def test_unseen_ledger(spark):
    """Three new, none on repeat, then one; a forgotten bucket is new again."""
    from radiolake.operators.dedup import unseen

    feeds = [(0, s, 0) for s in (0, 1000, 2000)] + [(1, s, 0) for s in (0, 1000, 2000)] + [(2, s, 500) for s in (1000, 2000, 3000)]
    data = [(1, n, "P25_NID", s, r) for n, (_, s, r) in enumerate(feeds)] + [(1, 9, "P25_NID", 100, 5000), (1, 10, "P25_CALL", 0, 6000), (1, 11, "P25_CALL", 9999, 7000)]
    df = spark.createDataFrame(data, "channel_id long, seq long, type string, s long, retained_start long").select(
        "channel_id", "seq", "type", F.lit("P25").alias("protocol"), "retained_start", F.lit(48000.0).alias("sample_rate_hz"),
        F.struct(F.struct(F.col("s").alias("source_sample")).alias("stream")).alias("extra"),
    )
    empty = spark.createDataFrame([], "channel_id long, ledger_key string, seen_sample long")
    got = sorted(r.seq for r in unseen(df, empty, ["channel_id"]).collect())
    # seq 9 falls in the first bucket, which lies before the retained start by then
    assert got == [0, 1, 2, 8, 9, 10]
