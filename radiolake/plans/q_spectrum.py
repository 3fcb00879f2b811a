"""Spectra, carrier search and signal-level analytics."""

from pyspark.sql import functions as F

from radiolake.functions import bits as B
from radiolake.operators import spectrum as S
from radiolake.plans.catalog import query
from radiolake.plans.q_conform import _bits

R6 = lambda c: F.round(c, 6)
DB = "10 * log10(power + 1e-12)"


def iq(v):
    """Captures of 50 embeddings, each vector a chunk of 32 complex samples."""
    e = v.table("embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("capture_id"), (F.col("vec_id") % 50 * 32).alias("start_sample"),
        F.slice("embedding", 1, 32).alias("i"), F.slice("embedding", 33, 32).alias("q"),
    )
    # every capture is full: 50 chunks of 32 samples
    return e.withColumns(
        {
            "end_sample": F.col("start_sample") + 32,
            "total_samples": F.lit(1600),
            "sample_rate_hz": F.lit(48000.0),
        }
    )


@query("spc1_welch_psd")
def _(v):
    return S.welch_psd(iq(v), ["capture_id"], 256).select("capture_id", "bin", "freq_hz", R6("power").alias("power"), "frame_count")


@query("spc2_waterfall")
def _(v):
    return S.waterfall(iq(v), ["capture_id"], 64, 400).select(
        "capture_id", "row", "bin", "freq_hz", R6("power").alias("power"), "frame_count"
    )


@query(
    "spc3_average_and_hold",
    "SELECT label, bin, round(avg(power), 6) AS average, round(max(power), 6) AS max_hold FROM v_psd GROUP BY label, bin",
)
def _(v):
    return S.average_and_hold(v.psd, ["label", "bin"]).select(
        "label", "bin", R6("average").alias("average"), R6("max_hold").alias("max_hold")
    )


@query(
    "spc4_live_average",
    """SELECT bin, round(list_reduce(list(power ORDER BY capture_id), lambda a, x: 0.75e0 * a + 0.25e0 * x), 6) AS average,
         round(max(power), 6) AS max_hold FROM v_psd GROUP BY bin""",
)
def _(v):
    """Smoothed spectrum after the newest vector, vectors taken as updates."""
    live = S.live_average(v.psd.drop("label"), ["bin"], "capture_id")
    last = live.groupBy("bin").agg(
        F.max_by("average", "capture_id").alias("average"), F.max_by("max_hold", "capture_id").alias("max_hold")
    )
    return last.select("bin", R6("average").alias("average"), R6("max_hold").alias("max_hold"))


@query(
    "spc4_live_average_slow",
    """SELECT bin, round(list_reduce(list(power ORDER BY capture_id), lambda a, x: 0.99e0 * a + 0.01e0 * x), 6) AS average,
         round(max(power), 6) AS max_hold FROM v_psd GROUP BY bin""",
)
def _(v):
    """The same with a long memory."""
    live = S.live_average(v.psd.drop("label"), ["bin"], "capture_id", alpha=0.01)
    last = live.groupBy("bin").agg(
        F.max_by("average", "capture_id").alias("average"), F.max_by("max_hold", "capture_id").alias("max_hold")
    )
    return last.select("bin", R6("average").alias("average"), R6("max_hold").alias("max_hold"))


@query(
    "spc5_display_bins",
    """SELECT capture_id, CAST(floor(bin / 8) AS BIGINT) AS display_bin, round(avg(power), 6) AS power,
         round(avg(freq_hz), 6) AS freq_hz FROM v_psd GROUP BY ALL""",
)
def _(v):
    return S.decimate_display(v.psd, ["capture_id"], 64, 10).select(
        "capture_id", "display_bin", R6("power").alias("power"), R6("freq_hz").alias("freq_hz")
    )


@query(
    "spc6_channel_smoothing",
    """SELECT capture_id, bin, round(avg(power) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 6)
       AS channel_power FROM v_psd""",
)
def _(v):
    return S.smooth_bins(v.psd, ["capture_id"], 4).select("capture_id", "bin", R6("channel_power").alias("channel_power"))


_THR = f"""t AS (SELECT capture_id, bin, freq_hz, {DB} AS p, median({DB}) OVER (PARTITION BY capture_id) AS nf FROM v_psd)"""


@query(
    "spc7_noise_threshold",
    _THR + " SELECT capture_id, bin, round(p, 6) AS power_db, round(nf, 6) AS noise_floor_db, round(nf + 15, 6) AS threshold_db FROM t",
)
def _(v):
    df = v.psd.withColumn("channel_power", F.col("power"))
    return S.with_threshold(df, ["capture_id"]).select(
        "capture_id", "bin", R6("power_db").alias("power_db"), R6("noise_floor_db").alias("noise_floor_db"),
        R6("threshold_db").alias("threshold_db"),
    )


_PEAKS = (
    _THR
    + """, n AS (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r FROM t WINDOW w AS (PARTITION BY capture_id ORDER BY bin)),
    pk AS (SELECT capture_id, bin, p FROM n WHERE p > l AND p >= r AND p >= nf + 3)"""
)


def _peaks(v):
    df = v.psd.withColumn("channel_power", F.col("power"))
    return S.local_peaks(S.with_threshold(df, ["capture_id"], 3.0), ["capture_id"])


@query("spc8_local_peaks", _PEAKS + " SELECT capture_id, bin FROM pk")
def _(v):
    return _peaks(v).select("capture_id", "bin")


def _nms(source: str, score: str, dist: int, cap: str = "") -> str:
    return f"""z AS (SELECT capture_id, list_reduce(list_transform(list(bin ORDER BY {score} DESC, bin), lambda b: [b]),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a - x[1]) < {dist})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
        FROM {source} GROUP BY 1) SELECT capture_id, unnest(kept{cap}) AS bin FROM z"""


@query("spc9_suppress_neighbours", _PEAKS + ", " + _nms("pk", "p", 7, "[1:3]"))
def _(v):
    return S.suppress_neighbours(_peaks(v), ["capture_id"], "bin", "power_db", 7, 3).select("capture_id", "bin")


@query(
    "spc10_blind_search",
    """s AS (SELECT capture_id, bin, 10 * log10(avg(power) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 1e-12) AS p FROM v_psd),
       t AS (SELECT *, median(p) OVER (PARTITION BY capture_id) AS nf, lag(p) OVER w AS l, lead(p) OVER w AS r FROM s WINDOW w AS (PARTITION BY capture_id ORDER BY bin)),
       pk AS (SELECT * FROM t WHERE p > l AND p >= r AND p >= nf + 3), """
    + _nms("pk", "p", 5),
)
def _(v):
    return S.blind_search(v.psd, ["capture_id"], 100.0, 3.0, 300.0, 500.0).select("capture_id", "bin")


@query(
    "spc11_refine_carriers",
    """h AS (SELECT vec_id AS capture_id, (vec_id % 40 - 20) * 100e0 AS hint_hz FROM embeddings),
       s AS (SELECT *, avg(power) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS sm FROM v_psd),
       n AS (SELECT s.*, hint_hz FROM s JOIN h USING (capture_id) WHERE abs(freq_hz - hint_hz) <= 800),
       b AS (SELECT capture_id, hint_hz, arg_max(bin, struct_pack(a := sm, b := -bin)) AS pb, median(power) AS noise FROM n GROUP BY ALL),
       w AS (SELECT b.capture_id, b.hint_hz, pb, noise, freq_hz, power, bin, greatest(0, power - noise) AS w FROM b JOIN v_psd USING (capture_id)
         WHERE bin BETWEEN pb - 2 AND pb + 2)
       SELECT capture_id, hint_hz, round(CASE WHEN sum(w) > 0 THEN sum(freq_hz * w) / sum(w) ELSE max(freq_hz) FILTER (bin = pb) END, 4) AS refined_hz,
         max(freq_hz) FILTER (bin = pb) AS peak_bin_hz, round(any_value(noise), 6) AS noise_power FROM w GROUP BY ALL""",
)
def _(v):
    hints = v.table("embeddings").select(
        F.col("vec_id").alias("capture_id"), F.col("vec_id").alias("hint_id"), ((F.col("vec_id") % 40 - 20) * 100.0).alias("hint_hz")
    )
    out = S.refine_carriers(v.psd.drop("label"), hints, ["capture_id"], 100.0, 400.0, 800.0)
    return out.select(
        "capture_id", "hint_hz", F.round("refined_hz", 4).alias("refined_hz"), "peak_bin_hz", R6("noise_power").alias("noise_power")
    )


@query(
    "spc12_active_bins",
    _THR
    + """ SELECT capture_id, bin, round(p, 6) AS power_db FROM t
      WHERE p >= greatest(-160, nf + 6) OR (bin = capture_id % 64 AND p >= greatest(-160, nf + 2))""",
)
def _(v):
    held = v.table("embeddings").select(F.col("vec_id").alias("capture_id"), (F.col("vec_id") % 64).alias("bin"))
    out = S.active_bins(v.psd, ["capture_id"], held, 6.0, 2.0)
    return out.select("capture_id", "bin", R6("power_db").alias("power_db"))


@query("spc13_fine_candidates")
def _(v):
    """Carriers inside the louder quarters of each spectrum."""
    fine = v.psd.drop("label").withColumn("coarse_bin", F.floor(F.col("bin") / 16))
    coarse = fine.groupBy("capture_id", "coarse_bin").agg(F.avg("power").alias("power")).withColumn("bin", F.col("coarse_bin"))
    active = S.active_bins(coarse, ["capture_id"], None, 0.5, 0.2).select(
        "capture_id", "coarse_bin", "power_db", "noise_floor_db", F.lit(4e8).alias("center_hz"),
        (F.col("coarse_bin") * 1600.0).alias("coarse_center_offset_hz"),
    )
    out = S.fine_candidates(active, fine, ["capture_id"], 100.0, 3.0, 300.0, 500.0)
    return out.select(
        "capture_id", "coarse_bin", "residual_offset_hz", "frequency_offset_hz", "center_frequency_hz", R6("snr_db").alias("snr_db")
    )


@query(
    "spc14_strongest_per_batch",
    """n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY snr_db DESC, frequency_offset_hz, seq) AS rn FROM v_detections)
       SELECT batch, seq, row_number() OVER (PARTITION BY batch ORDER BY frequency_offset_hz, seq) AS position FROM n WHERE rn <= 5""",
)
def _(v):
    return S.strongest(v.detections, ["batch"], 5).select("batch", "seq", F.col("position").cast("bigint").alias("position"))


@query("spc15_modulation_gate")
def _(v):
    """Quarter-second snapshots at 1000 samples a second; the last of a capture is short."""
    snap = iq(v).groupBy(
        "capture_id", F.floor(F.col("start_sample") / 256).alias("snapshot")
    ).agg(F.sort_array(F.collect_list(F.struct("start_sample", "i", "q"))).alias("p"))
    snap = snap.select(
        "capture_id", "snapshot", F.lit(1000.0).alias("sample_rate_hz"),
        F.flatten(F.transform("p", lambda x: x["i"])).alias("i"), F.flatten(F.transform("p", lambda x: x["q"])).alias("q"),
    )
    out = S.modulation_gate(snap, ["capture_id", "snapshot"])
    return out.select("capture_id", "snapshot", "family", R6("confidence").alias("confidence"), "reason", R6("q75").alias("q75"), "pair_count")


@query(
    "spc16_stable_family",
    """d AS (SELECT seq, CAST(floor(seq / 40) AS BIGINT) AS probe, CASE k % 3 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'fsk4' ELSE 'pi4dqpsk' END AS family FROM v_pdus),
       l AS (SELECT *, lag(family) OVER w AS f1, lag(family, 2) OVER w AS f2 FROM d WINDOW w AS (PARTITION BY probe ORDER BY seq))
       SELECT probe, min(seq) AS accepted_seq, arg_min(family, seq) AS family FROM l WHERE family <> 'uncertain' AND f1 = family AND f2 = family GROUP BY probe""",
)
def _(v):
    k = F.col("k") % 3
    df = v.pdus.select(
        "seq", F.floor(F.col("seq") / 40).alias("probe"), F.when(k == 0, "uncertain").when(k == 1, "fsk4").otherwise("pi4dqpsk").alias("family")
    )
    return S.stable_family(df, ["probe"], 3)


@query("spc17_tune_narrowband")
def _(v):
    """Three carriers cut from each capture at an eighth of the rate."""
    out = S.tune(iq(v), ["capture_id"], [-9000.0, 0.0, 6000.0], 8, 2500.0, 33)
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    return out.groupBy("capture_id", "offset_hz").agg(
        F.sum(F.size("re")).alias("samples"), F.round(F.sum(power), 6).alias("energy"), F.max("end_sample").alias("end_sample")
    )


def _bit_rows(v):
    return v.payload.select("seq", B.hex_to_bits(F.concat("hex", "hex2")).alias("bits"))


_TRAIN = (
    f"b AS MATERIALIZED (SELECT seq, {_bits('(hex || hex2)')} AS b FROM v_payload), tr(name, s) AS (VALUES "
    + ", ".join(f"('{n}', '{s}')" for n, s in S.TRAINING.items())
    + """), er AS (SELECT seq, name, length(s) AS len, list_transform(range(1, 256 - length(s) + 2),
      lambda o: bit_count(xor(CAST(('0b' || substr(b, o, length(s))) AS BIGINT), CAST(('0b' || s) AS BIGINT)))) AS e FROM b, tr),
    x AS (SELECT seq, name, len, e, unnest(range(1, len(e) + 1)) AS o FROM er),
    c AS (SELECT seq, name, len, o, CAST(e[o] AS BIGINT) AS errors FROM x WHERE e[o] <= floor(0.25e0 * len + 1e-9)
      AND (o = 1 OR e[o] <= e[o - 1]) AND (o = len(e) OR e[o] <= e[o + 1]))"""
)


@query("spc18_training_candidates", _TRAIN + " SELECT seq, name, o AS bit_offset, errors FROM c")
def _(v):
    rows = S.training_candidates(_bit_rows(v), ["seq"])
    return rows.select("seq", "name", F.explode("candidates").alias("c")).select(
        "seq", "name", F.col("c.p").cast("bigint").alias("bit_offset"), F.col("c.s").cast("bigint").alias("errors")
    )


@query(
    "spc18_training_hits",
    _TRAIN
    + """, z AS (SELECT seq, name, len, list_reduce(list_transform(list(o ORDER BY errors, o), lambda b: [b]),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a - x[1]) < 32)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM c GROUP BY ALL),
      h AS (SELECT seq, name, len, unnest(kept[1:200]) AS o FROM z)
      SELECT h.seq, h.name, h.o AS bit_offset, c.errors, c.errors / c.len <= 0.18e0 AS is_good FROM h JOIN c ON c.seq = h.seq AND c.name = h.name AND c.o = h.o""",
)
def _(v):
    return S.training_hits(_bit_rows(v), ["seq"], most=200).select(
        "seq", "name", F.col("bit_offset").cast("bigint").alias("bit_offset"), F.col("errors").cast("bigint").alias("errors"), "is_good"
    )


def _symbols(v):
    return v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("n", "e")).select(
        "vec_id", F.col("n").cast("bigint").alias("n"), (F.col("e").cast("double") * 20).alias("y")
    )


_SYM = """s AS (SELECT vec_id, pos AS n, CAST(e AS DOUBLE) * 20 AS y FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS pos FROM embeddings))"""


@query(
    "spc19_symbol_phase",
    _SYM
    + """, m AS (SELECT vec_id, n % 8 AS phase, median(least(abs(y + 3), abs(y + 1), abs(y - 1), abs(y - 3))) AS err FROM s GROUP BY ALL)
      SELECT vec_id, arg_min(phase, struct_pack(a := err, b := phase)) AS phase, round(min(err), 6) AS median_error FROM m GROUP BY vec_id""",
)
def _(v):
    return S.symbol_phase(_symbols(v), ["vec_id"], 8).select("vec_id", "phase", R6("median_error").alias("median_error"))


@query(
    "spc19_level_histogram",
    _SYM
    + """ SELECT vec_id, CASE WHEN y = 4 THEN 3 ELSE CAST(floor((y + 4) / 2) AS BIGINT) END AS level, count(*) AS samples
      FROM s WHERE y BETWEEN -4 AND 4 GROUP BY ALL""",
)
def _(v):
    return S.level_histogram(_symbols(v), ["vec_id"])


@query(
    "spc20_interpolate",
    """p AS (SELECT vec_id, embedding AS e, vec_id % 700 / 10e0 - 2 AS pos FROM embeddings),
       i AS (SELECT *, CAST(greatest(0, least(62, floor(pos))) AS INT) AS i, pos - floor(pos) AS f FROM p)
       SELECT vec_id, round(CAST(e[i + 1] AS DOUBLE) * (1 - f) + CAST(e[i + 2] AS DOUBLE) * f, 6) AS value FROM i""",
)
def _(v):
    df = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return df.select("vec_id", R6(S.interp_linear(F.col("e"), F.col("vec_id") % 700 / 10.0 - 2)).alias("value"))


@query(
    "spc21_frequency_errors",
    """e AS (SELECT label, capture_id AS burst, abs(power * 1000 - 10) AS a FROM v_psd)
       SELECT label, burst, round(median(a), 6) AS median_abs_hz, round(max(a), 6) AS max_abs_hz FROM e GROUP BY label, burst
       UNION ALL SELECT label, NULL, round(median(a), 6), round(max(a), 6) FROM e GROUP BY label""",
)
def _(v):
    df = v.psd.select("label", F.col("capture_id").alias("burst"), (F.col("power") * 1000 - 10).alias("error_hz"))
    return S.frequency_error_stats(df, ["label"], "burst").select(
        "label", "burst", R6("median_abs_hz").alias("median_abs_hz"), R6("max_abs_hz").alias("max_abs_hz")
    )


@query(
    "spc22_check_carriers",
    """m AS (SELECT vec_id AS capture_id, unnest([0, 1, 2]) AS c FROM embeddings), o AS (SELECT capture_id, c AS carrier_id, c * 1500e0 - 2000 AS offset_hz FROM m),
       pk AS (SELECT o.capture_id, carrier_id, offset_hz, max(power) AS pp, arg_max(freq_hz, struct_pack(a := power, b := -freq_hz)) AS peak_hz
         FROM o JOIN v_psd USING (capture_id) WHERE abs(freq_hz - offset_hz) <= 600 GROUP BY ALL),
       nz AS (SELECT capture_id, median(power) AS np FROM v_psd p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.capture_id = p.capture_id AND abs(p.freq_hz - o.offset_hz) <= 400) GROUP BY 1)
       SELECT capture_id, carrier_id, peak_hz, round(10 * log10(pp / np), 6) AS margin_db FROM pk JOIN nz USING (capture_id)""",
)
def _(v):
    m = v.table("embeddings").select(
        F.col("vec_id").alias("capture_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("carrier_id")
    ).withColumn("offset_hz", F.col("carrier_id") * 1500.0 - 2000)
    return S.check_carriers(v.psd.drop("label"), m, ["capture_id"], 600.0, 400.0).select(
        "capture_id", "carrier_id", "peak_hz", R6("margin_db").alias("margin_db")
    )
