"""Activity, epochs, windows and event logs."""

from pyspark.sql import functions as F

from radiolake.functions.formats import with_line
from radiolake.operators import activity as A
from radiolake.operators.conform import conform_pdus
from radiolake.plans.catalog import query

CFG = A.ActivityConfig(min_on_sec=0.15, off_hang_sec=0.3)
FLOOR = 2.0  # on above 12 dB, off below 8 dB
R6 = lambda c: F.round(c, 6)


def _halves(v):
    """Embeddings as chunks of 32 complex samples."""
    return v.table("embeddings").select(
        "vec_id", F.slice("embedding", 1, 32).alias("i"), F.slice("embedding", 33, 32).alias("q")
    )


@query(
    "act1_chunk_power",
    """SELECT vec_id, round(greatest(-160e0, 10 * log10(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 32)), 6)
       AS power_db FROM embeddings""",
)
def _(v):
    return A.chunk_power(_halves(v)).select("vec_id", R6("power_db").alias("power_db"))


@query("act2_spectral_noise")
def _(v):
    """Noise floor of each embedding read as 64 complex samples (imaginary part zero)."""
    df = v.table("embeddings").select(
        "vec_id", F.col("embedding").alias("i"), F.transform("embedding", lambda x: x * 0).alias("q")
    )
    return A.spectral_noise(df).select("vec_id", R6("spectral_floor_db").alias("spectral_floor_db"))


@query("act3_floor_sources")
def _(v):
    """How often each source decided the noise floor."""
    act = A.detect_adaptive(_adaptive_input(v), A.ActivityConfig(on_margin_db=6.0, off_margin_db=3.0))
    return act.groupBy("channel_id", "noise_source").agg(F.count(F.lit(1)).alias("chunks"))


def _adaptive_input(v):
    # a spectral estimate is available for most chunks, a few are too short for one
    spectral = F.when(F.col("k") % 6 != 0, F.least(F.col("power_db") - 4, F.lit(6.0)))
    return v.chunks.withColumn("spectral_floor_db", spectral)


@query("act5_adaptive_detector")
def _(v):
    act = A.detect_adaptive(_adaptive_input(v), A.ActivityConfig(on_margin_db=6.0, off_margin_db=3.0))
    return act.select(
        "channel_id", "seq", "phase", "is_active", "started", "ended", R6("noise_floor_db").alias("noise_floor_db"),
        R6("snr_db").alias("snr_db"), "noise_source", "candidate_start",
    )


GEN_SQL = """
  g0 AS (SELECT *, lag(end_sample) OVER (PARTITION BY channel_id ORDER BY seq) AS pe FROM v_chunks),
  g1 AS (SELECT *, coalesce(start_sample - pe, 0) AS gap_samples, discontinuity OR dropped_samples > 0 OR coalesce(start_sample <> pe, FALSE) AS reset FROM g0),
  g AS (SELECT *, sum(CAST(reset AS BIGINT)) OVER (PARTITION BY channel_id ORDER BY seq) AS generation FROM g1)"""

# the run lengths are summed inside islands; Spark subtracts samples instead
DET_SQL = (
    GEN_SQL
    + """,
  d0 AS (SELECT *, power_db > 12 AS above, power_db < 8 AS below FROM g),
  d1 AS (SELECT *, sum(CAST(NOT above AS BIGINT)) OVER w AS ia, sum(CAST(NOT below AS BIGINT)) OVER w AS ib FROM d0
    WINDOW w AS (PARTITION BY channel_id, generation ORDER BY seq)),
  d2 AS (SELECT *, sum(CASE WHEN above THEN end_sample - start_sample ELSE 0 END) OVER (PARTITION BY channel_id, generation, ia ORDER BY seq) AS la,
    sum(CASE WHEN below THEN end_sample - start_sample ELSE 0 END) OVER (PARTITION BY channel_id, generation, ib ORDER BY seq) AS lb,
    min(CASE WHEN above THEN start_sample END) OVER (PARTITION BY channel_id, generation, ia ORDER BY seq) AS run_start FROM d1),
  d3 AS (SELECT *, above AND la / 48000e0 >= 0.15e0 AS on_t, below AND lb / 48000e0 >= 0.3e0 AS off_t FROM d2),
  d4 AS (SELECT *, coalesce(last_value(CASE WHEN on_t THEN TRUE WHEN off_t THEN FALSE END IGNORE NULLS) OVER (PARTITION BY channel_id, generation ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS was FROM d3),
  det AS (SELECT *, on_t OR (was AND NOT off_t) AS is_active, on_t AND NOT was AS started, off_t AND was AS ended,
    CASE WHEN on_t OR (was AND NOT off_t) THEN CASE WHEN below THEN 'pending_off' ELSE 'active' END
      WHEN above THEN 'pending_on' ELSE 'inactive' END AS phase FROM d4)"""
)


def _detected(v):
    return A.detect_fixed(v.chunks, FLOOR, CFG)


@query(
    "act4_hysteresis_detector",
    DET_SQL + " SELECT channel_id, seq, is_active, started, ended, phase, round(power_db - 2, 6) AS snr_db FROM det",
)
def _(v):
    return _detected(v).select(
        "channel_id", "seq", "is_active", "started", "ended", "phase", R6("snr_db").alias("snr_db")
    )


@query("act6_generations", GEN_SQL + " SELECT channel_id, seq, reset, gap_samples, generation FROM g")
def _(v):
    return A.with_generations(v.chunks).select("channel_id", "seq", "reset", "gap_samples", "generation")


STATE_SQL = (
    DET_SQL
    + """,
  s0 AS (SELECT *, CASE WHEN is_active THEN 'CLASSIFYING' WHEN phase = 'pending_on' THEN 'ACTIVITY_PENDING' ELSE 'NO_SIGNAL' END AS state FROM det),
  st AS (SELECT *, coalesce(lag(state) OVER w, 'NO_SIGNAL') AS prev, sum(CAST(started AS BIGINT)) OVER w AS epoch_id FROM s0
    WINDOW w AS (PARTITION BY channel_id ORDER BY seq)),
  so AS (SELECT *, CASE WHEN reset THEN 'NO_SIGNAL' ELSE prev END AS old FROM st),
  ev AS (
    SELECT channel_id, seq, 'DISCONTINUITY' AS event, prev AS from_state, 'NO_SIGNAL' AS to_state, start_sample AS sample, 'input_discontinuity' AS reason, 0 AS epoch_id FROM so WHERE reset
    UNION ALL SELECT channel_id, seq, 'STATE_TRANSITION', old, 'ACTIVITY_PENDING', end_sample, 'activity_above_on_threshold', 0 FROM so WHERE old = 'NO_SIGNAL' AND state <> 'NO_SIGNAL'
    UNION ALL SELECT channel_id, seq, 'STATE_TRANSITION', 'ACTIVITY_PENDING', 'CLASSIFYING', end_sample, 'activity_confirmed', epoch_id FROM so WHERE old <> 'CLASSIFYING' AND state = 'CLASSIFYING'
    UNION ALL SELECT channel_id, seq, 'STATE_TRANSITION', old, 'NO_SIGNAL', end_sample, 'activity_too_short', 0 FROM so WHERE old = 'ACTIVITY_PENDING' AND state = 'NO_SIGNAL'
    UNION ALL SELECT channel_id, seq, 'STATE_TRANSITION', old, 'NO_SIGNAL', end_sample, 'rf_activity_ended', epoch_id FROM so WHERE old = 'CLASSIFYING' AND state <> 'CLASSIFYING'),
  e0 AS (SELECT *, min(CASE WHEN started THEN seq END) OVER (PARTITION BY channel_id, epoch_id) AS s_seq FROM so WHERE epoch_id > 0),
  ep AS (SELECT channel_id, epoch_id, max(CASE WHEN started THEN run_start END) AS candidate_start,
      coalesce(arg_min(CASE WHEN reset THEN start_sample ELSE end_sample END, seq) FILTER (seq > s_seq AND (ended OR reset)), max(end_sample)) AS end_sample,
      coalesce(arg_min(CASE WHEN reset THEN 'input_discontinuity' ELSE 'rf_activity_ended' END, seq) FILTER (seq > s_seq AND (ended OR reset)), 'end_of_input') AS close_reason
    FROM e0 GROUP BY channel_id, epoch_id)"""
)


@query("act7_channel_events", STATE_SQL + " SELECT * FROM ev")
def _(v):
    return A.channel_events(_detected(v)).select(
        "channel_id", "seq", "event", "from_state", "to_state", "sample", "reason", "epoch_id"
    )


@query("act8_epochs", STATE_SQL + " SELECT * FROM ep")
def _(v):
    return A.epochs(_detected(v)).select("channel_id", "epoch_id", "candidate_start", "end_sample", "close_reason")


@query(
    "act9_decode_ranges",
    STATE_SQL
    + """ SELECT channel_id, epoch_id, greatest(coalesce(lag(end_sample) OVER (PARTITION BY channel_id ORDER BY epoch_id), 0),
      greatest(0, candidate_start - 24000)) AS decode_start FROM ep""",
)
def _(v):
    return A.decode_ranges(A.epochs(_detected(v)), 24000).select("channel_id", "epoch_id", "decode_start")


# ---- envelope: each chunk's level as one 1 ms bucket of its channel; 1e-12 is added before the
# logarithm, as in ``envelope``, so that a silent bucket is one of -120 dB

WCFG = A.WindowConfig(
    merge_gap_sec=0.002, window_sec=0.030, overlap_sec=0.006, min_window_sec=0.004, pre_pad_sec=0.002, post_pad_sec=0.003,
    active_pad_sec=0.001, active_max_sec=0.006,
)
RATE = 48000.0


def _env(v):
    return v.chunks.select(
        "channel_id", (F.col("seq") % 4096 + 1).alias("bucket"), (F.lit(10.0) * F.log10(F.col("value") + 1e-12)).alias("power_db")
    )


def _captures(v):
    return v.chunks.groupBy("channel_id").agg((F.count(F.lit(1)) * 48 + 20).alias("sample_count"))


def _levels(v):
    """One level per bucket, as ``envelope`` gives it: the mean power of the bucket's chunks in dB.
    A power that is null, NaN, negative or infinite is no reading; a bucket without one has no level."""
    power = F.when((F.col("value") >= 0) & (F.col("value") < float("inf")), F.col("value"))
    power = v.chunks.groupBy("channel_id", _bucket().alias("bucket")).agg(F.avg(power).alias("_power"))
    return A.settle(power.select("channel_id", "bucket", (F.lit(10.0) * F.log10(F.col("_power") + 1e-12)).alias("power_db")))


def _bucket():
    return F.col("seq") - F.col("channel_id") * 4096 + 1


def _spans(v):
    """Captures that reach to their last bucket, also where buckets before it are missing."""
    return v.chunks.groupBy("channel_id").agg((F.max(_bucket()) * 48 + 20).alias("sample_count"))


ENV_HEAD = """
  env AS (SELECT channel_id, seq % 4096 + 1 AS bucket, 10 * log10(value + 1e-12) AS p FROM v_chunks),
  srt AS (SELECT channel_id, list(p ORDER BY p) AS l, count(*) AS n FROM env GROUP BY 1),"""

LEVEL_HEAD = """
  got AS (SELECT channel_id, seq - channel_id * 4096 + 1 AS bucket, CASE WHEN value >= 0 AND value < CAST('inf' AS DOUBLE) THEN value END AS power FROM v_chunks),
  env AS (SELECT channel_id, bucket, 10 * log10(avg(power) + 1e-12) AS p FROM got GROUP BY 1, 2),
  srt AS (SELECT channel_id, list(p ORDER BY p) AS l, count(*) AS n FROM env WHERE p IS NOT NULL GROUP BY 1),"""

RUN_SQL = """
  pos AS (SELECT *, least(greatest(n * 0.2e0 + 0.5, 1), n) AS x, least(greatest(n * 0.95e0 + 0.5, 1), n) AS y FROM srt),
  q AS (SELECT channel_id, n, l[CAST(floor(x) AS INT)] + (l[CAST(ceil(x) AS INT)] - l[CAST(floor(x) AS INT)]) * (x - floor(x)) AS floor_db,
     l[CAST(floor(y) AS INT)] + (l[CAST(ceil(y) AS INT)] - l[CAST(floor(y) AS INT)]) * (y - floor(y)) AS top_db FROM pos),
  thr AS (SELECT *, greatest(floor_db + 8, floor_db + 0.35e0 * greatest(top_db - floor_db, 0)) AS t FROM q),
  act AS (SELECT env.*, p > t AS a, thr.t AS threshold_db FROM env JOIN thr USING (channel_id)),
  isl AS (SELECT *, bucket - row_number() OVER (PARTITION BY channel_id, a ORDER BY bucket) AS isl FROM act),
  runs AS (SELECT channel_id, min(bucket) AS run_start, max(bucket) AS run_end, avg(p) AS mean_db, count(*) AS length FROM isl WHERE a GROUP BY channel_id, isl),
  md AS (SELECT channel_id, count(*) AS buckets, CASE WHEN count(*) < 4 THEN 'short' WHEN count(*) FILTER (a) < 3 OR count(*) FILTER (a) / count(*) > 0.85e0
     THEN 'continuous_or_uncertain' ELSE 'threshold' END AS cap_mode FROM act GROUP BY 1)"""

ENV_SQL = ENV_HEAD + RUN_SQL  # a row per chunk
LEVEL_SQL = LEVEL_HEAD + RUN_SQL  # a row per bucket


@query(
    "act10_thresholds",
    ENV_SQL
    + """ SELECT channel_id, round(floor_db, 6) AS floor_db, round(top_db, 6) AS top_db, round(any_value(t), 6) AS threshold_db,
      round(avg(CAST(a AS INT)), 6) AS active_ratio FROM act JOIN thr USING (channel_id) GROUP BY channel_id, floor_db, top_db""",
)
def _(v):
    out = A.activity_thresholds(_env(v), ["channel_id"], WCFG)
    return out.select("channel_id", *[R6(c).alias(c) for c in ("floor_db", "top_db", "threshold_db", "active_ratio")])


@query("act11_active_runs", LEVEL_SQL + " SELECT channel_id, run_start, run_end, length FROM runs")
def _(v):
    env = _levels(v)
    thr = A.activity_thresholds(env, ["channel_id"], WCFG)
    return A.active_runs(env, thr, ["channel_id"]).select("channel_id", "run_start", "run_end", "length")


MERGE_SQL = (
    LEVEL_SQL
    + """,
  m0 AS (SELECT *, coalesce(run_start - lag(run_end) OVER w - 1 > 2, TRUE) AS o FROM runs WINDOW w AS (PARTITION BY channel_id ORDER BY run_start)),
  m1 AS (SELECT *, sum(CAST(o AS BIGINT)) OVER (PARTITION BY channel_id ORDER BY run_start) AS g FROM m0),
  merged AS (SELECT channel_id, min(run_start) AS merged_start, max(run_end) AS merged_end, count(*) AS run_count FROM m1 GROUP BY channel_id, g)"""
)


@query("act12_merged_runs", MERGE_SQL + " SELECT * FROM merged")
def _(v):
    env = _levels(v)
    thr = A.activity_thresholds(env, ["channel_id"], WCFG)
    runs = A.active_runs(env, thr, ["channel_id"])
    return A.merge_runs(runs, ["channel_id"], 2).select("channel_id", "merged_start", "merged_end", "run_count")


# spans cut by walking them window by window
WIN_SQL = (
    MERGE_SQL
    + """,
  tot AS (SELECT channel_id, max(bucket) * 48 + 20 AS total FROM env GROUP BY 1),
  sp AS (SELECT channel_id, merged_start, merged_end, greatest(1, (merged_start - 1) * 48 + 1 - 96) AS s0, least(total, merged_end * 48 + 144) AS e0, 'active_run' AS mode
      FROM merged JOIN tot USING (channel_id) JOIN md USING (channel_id) WHERE cap_mode = 'threshold'
    UNION ALL SELECT channel_id, 1, CASE WHEN cap_mode = 'continuous_or_uncertain' THEN buckets ELSE 1 END, 1, total, coalesce(cap_mode, 'short')
      FROM tot LEFT JOIN md USING (channel_id) WHERE cap_mode IS DISTINCT FROM 'threshold'),
  cut AS (SELECT *, i + 1 AS split_index, s0 + i * 1152 AS s, least(e0, s0 + i * 1152 + 1439) AS e
    FROM sp, LATERAL (SELECT unnest(range(0, 1 + greatest(0, CAST(ceil((e0 - s0 + 1 - 1440) / 1152) AS BIGINT)))) AS i) WHERE e0 >= s0),
  tail AS (SELECT *, e - s + 1 < 192 AND split_index > 1 AS drop_me, lead(e - s + 1 < 192) OVER (PARTITION BY channel_id, merged_start ORDER BY split_index) AS absorbs FROM cut),
  win AS (SELECT channel_id, merged_start AS run_start, merged_end AS run_end, split_index, s AS start_sample,
    CASE WHEN absorbs THEN e0 ELSE e END AS end_sample, mode FROM tail WHERE NOT drop_me)"""
)


@query("act13_scan_windows", WIN_SQL + " SELECT * FROM win")
def _(v):
    return A.scan_windows(_levels(v), _spans(v), ["channel_id"], RATE, WCFG).select(
        "channel_id", "run_start", "run_end", "split_index", "start_sample", "end_sample", "mode"
    )


@query(
    "act14_whole_span_modes",
    """c AS (SELECT CAST(floor(seq / 20) * 5 AS BIGINT) + CAST(floor((seq % 20 + 2) / 5) AS BIGINT) AS capture, CASE WHEN k % 4 = 0 THEN 20e0 ELSE 0e0 END AS p
          FROM v_chunks),
       n AS (SELECT capture, count(*) AS n, list(p ORDER BY p) AS l FROM c GROUP BY 1),
       f AS (SELECT *, l[CAST(floor(n * 0.2e0 + 0.5e0) AS INT)] + (n * 0.2e0 + 0.5e0 - floor(n * 0.2e0 + 0.5e0)) * (l[CAST(floor(n * 0.2e0 + 0.5e0) AS INT) + 1] - l[CAST(floor(n * 0.2e0 + 0.5e0) AS INT)]) AS fl,
          l[n] AS top FROM n),
       a AS (SELECT c.capture, n, count(*) FILTER (p > greatest(fl + 8, fl + 0.35e0 * (top - fl))) AS act FROM c JOIN f USING (capture) GROUP BY ALL)
       SELECT capture, CASE WHEN n < 4 THEN 'short' WHEN act < 3 OR act / n > 0.85e0 THEN 'continuous_or_uncertain' ELSE 'threshold' END AS mode FROM a""",
)
def _(v):
    # every chunk belongs to a capture of three, five, five, five or two chunks in turn
    place = F.col("seq") % 20
    df = v.chunks.select(
        (F.floor(F.col("seq") / 20) * 5 + F.floor((place + 2) / 5)).alias("capture"), (place + 1).alias("bucket"),
        F.when(F.col("k") % 4 == 0, 20.0).otherwise(0.0).alias("power_db"),
    )
    return A.activity_thresholds(df, ["capture"]).select("capture", "mode")


@query(
    "act15_window_power",
    WIN_SQL
    + """ SELECT win.channel_id, start_sample, end_sample, round(avg(p), 6) AS mean_power_db, round(max(p), 6) AS peak_power_db
      FROM win LEFT JOIN env ON env.channel_id = win.channel_id AND bucket BETWEEN floor((start_sample - 1) / 48) + 1 AND ceil(end_sample / 48)
      GROUP BY win.channel_id, run_start, split_index, start_sample, end_sample""",
)
def _(v):
    env = _levels(v)
    wins = A.scan_windows(env, _spans(v), ["channel_id"], RATE, WCFG)
    return A.window_power(wins, env, ["channel_id"], 48).select(
        "channel_id", "start_sample", "end_sample", R6("mean_power_db").alias("mean_power_db"),
        R6("peak_power_db").alias("peak_power_db"),
    )


@query(
    "act16_best_window",
    ENV_SQL
    + """, tot AS (SELECT channel_id, count(*) * 48 + 20 AS total FROM v_chunks GROUP BY 1),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY round(mean_db + 0.05e0 * length, 9) DESC, run_start) AS rn FROM runs) WHERE rn = 1),
      p AS (SELECT channel_id, total, greatest(1, (run_start - 1) * 48 + 1 - 48) AS s, least(total, run_end * 48 + 48) AS e FROM b JOIN tot USING (channel_id)),
      c AS (SELECT *, e - s + 1 > 288 AS long, greatest(1, CAST(round((s + e) / 2) AS BIGINT) - 144) AS s1 FROM p)
      SELECT channel_id, CASE WHEN cap_mode = 'threshold' THEN 'bursty_active' ELSE cap_mode END AS mode,
        CASE WHEN cap_mode <> 'threshold' THEN 1 WHEN long THEN s1 ELSE s END AS start_sample,
        CASE cap_mode WHEN 'short' THEN t.total WHEN 'continuous_or_uncertain' THEN least(t.total, 48000)
          ELSE CASE WHEN long THEN least(t.total, s1 + 287) ELSE e END END AS end_sample
      FROM tot AS t JOIN md USING (channel_id) LEFT JOIN c USING (channel_id)""",
)
def _(v):
    return A.best_window(_env(v), _captures(v), ["channel_id"], RATE, WCFG).select(
        "channel_id", "mode", "start_sample", "end_sample"
    )


def _epochs(v):
    return A.decode_ranges(A.epochs(_detected(v)), 24000)


def _chunk_pdus(v):
    """One decoded row in every chunk, a little after its start."""
    return v.chunks.select("channel_id", "seq", (F.col("start_sample") + F.col("k") * 40).alias("sample"))


@query(
    "act17_epoch_pdus",
    STATE_SQL
    + """, r AS (SELECT *, greatest(coalesce(lag(end_sample) OVER (PARTITION BY channel_id ORDER BY epoch_id), 0), greatest(0, candidate_start - 24000)) AS ds FROM ep),
      p AS (SELECT channel_id, seq, start_sample + k * 40 AS sample FROM v_chunks)
      SELECT r.channel_id, epoch_id, count(seq) AS pdu_count, min(seq) AS first_pdu, max(seq) AS last_pdu, max(sample) AS last_good_sample
      FROM r LEFT JOIN p ON p.channel_id = r.channel_id AND sample >= ds AND sample < end_sample GROUP BY ALL""",
)
def _(v):
    eps = _epochs(v)
    inside = A.assign_to_epochs(_chunk_pdus(v), eps, ["channel_id"], "sample", 480000.0)
    return A.epoch_counts(eps, inside, ["channel_id"], "sample").select(
        "channel_id", "epoch_id", "pdu_count", "first_pdu", "last_pdu", "last_good_sample"
    )


@query(
    "act18_rebatch",
    """g0 AS (SELECT *, lag(end_sample) OVER w AS pe FROM v_chunks WINDOW w AS (PARTITION BY channel_id ORDER BY seq)),
       g1 AS (SELECT *, pe IS NULL OR discontinuity OR start_sample <> pe AS rs FROM g0),
       g2 AS (SELECT *, sum(CAST(rs AS BIGINT)) OVER (PARTITION BY channel_id ORDER BY seq) AS gid FROM g1),
       g3 AS (SELECT *, min(start_sample) OVER (PARTITION BY channel_id, gid) AS grid FROM g2),
       g4 AS (SELECT *, lag(grid) OVER (PARTITION BY channel_id ORDER BY seq) AS pgrid FROM g3),
       g5 AS (SELECT *, coalesce((pe - pgrid) % 7000 <> 0, FALSE) AS pend, coalesce(start_sample <> pe, FALSE) AS jump FROM g4),
       c AS (SELECT *, unnest(range((start_sample - grid) // 7000, (end_sample - 1 - grid) // 7000 + 1)) AS b FROM g5),
       p AS (SELECT *, greatest(start_sample, grid + b * 7000) AS f, least(end_sample, grid + (b + 1) * 7000) AS t FROM c)
       SELECT channel_id, min(f) AS start_sample, max(t) AS end_sample, count(*) AS piece_count,
         coalesce(bool_or(discontinuity OR (pend AND jump)) FILTER (f = start_sample AND f = grid + b * 7000), FALSE) AS discontinuity,
         coalesce(sum(dropped_samples + CASE WHEN pend AND jump AND start_sample > pe THEN start_sample - pe ELSE 0 END)
           FILTER (f = start_sample AND f = grid + b * 7000), 0) AS dropped_samples
       FROM p GROUP BY channel_id, gid, b""",
)
def _(v):
    return A.rebatch(v.chunks, 7000).select(
        "channel_id", "start_sample", "end_sample", "piece_count", "discontinuity", "dropped_samples"
    )


@query(
    "act19_operator_log",
    STATE_SQL
    + """ SELECT channel_id, sample, 0 AS kind, printf('SIGNAL_ON ch%d epoch %d', channel_id, epoch_id) AS line FROM ev WHERE to_state = 'CLASSIFYING'
      UNION ALL SELECT channel_id, end_sample, 1, printf('LOCK ch%d %s epoch %d', channel_id, CASE WHEN epoch_id % 2 = 0 THEN 'DMR' ELSE 'P25' END, epoch_id) FROM ep
      UNION ALL SELECT CAST(floor(seq / 4096) AS BIGINT), seq * 4800, 2, printf('PDU ch%d [%-12s] PROTO=%s SRC=%d DST=%d FLCO=%s FID=%s', CAST(floor(seq / 4096) AS BIGINT), type, coalesce(protocol, 'DMR'), src_num, dst_num, flco, fid) FROM v_pdus""",
)
def _(v):
    act = _detected(v)
    locks = A.epochs(act).select(
        "channel_id", F.col("end_sample").alias("sample"), "epoch_id",
        F.when(F.col("epoch_id") % 2 == 0, "DMR").otherwise("P25").alias("protocol"),
    )
    pdus = with_line(conform_pdus(v.pdus.drop("fo_hz"))).select(
        F.floor(F.col("seq") / 4096).alias("channel_id"), (F.col("seq") * 4800).alias("sample"), "line"
    )
    return A.operator_log(A.channel_events(act), locks, pdus)
