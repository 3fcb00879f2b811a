"""Reports, metrics and comparisons."""

from pyspark.sql import functions as F

from radiolake.operators import activity as A
from radiolake.operators import compare as C
from radiolake.operators import reports as R
from radiolake.operators.conform import conform_pdus
from radiolake.plans.catalog import query
from radiolake.plans.q_activity import CFG, FLOOR, STATE_SQL

R6 = lambda c: F.round(c, 6)


@query(
    "rpt1_frame_quality",
    """SELECT channel_id, count(*) AS frame_count, count(*) FILTER (frame_valid) AS valid_frame_count, round(avg(CAST(frame_valid AS INT)), 6) AS valid_frame_ratio,
         round(avg(CAST(block_ok AS INT)), 6) AS block_pass_ratio, round(avg(sync_score) FILTER (frame_valid), 6) AS mean_valid_sync_score FROM v_frame_quality GROUP BY 1""",
)
def _(v):
    return R.frame_quality(v.frame_quality, ["channel_id"]).select(
        "channel_id", "frame_count", "valid_frame_count", R6("valid_frame_ratio").alias("valid_frame_ratio"),
        R6("block_pass_ratio").alias("block_pass_ratio"), R6("mean_valid_sync_score").alias("mean_valid_sync_score"),
    )


@query("rpt1_lich_histogram", "SELECT channel_id, lich, count(*) AS frame_count FROM v_frame_quality GROUP BY ALL")
def _(v):
    return R.lich_histogram(v.frame_quality, ["channel_id"])


@query(
    "rpt2_decoder_counters",
    """SELECT channel_id, coalesce(protocol, 'DMR') AS protocol, count(DISTINCT floor(seq / 3)) AS candidate_count, count(*) AS pdu_count,
         count(*) FILTER (type IN ('LC_HEADER', 'TERMINATOR', 'LATE_ENTRY')) AS strong_pdu_count FROM v_pdus GROUP BY ALL""",
)
def _(v):
    df = conform_pdus(v.pdus.drop("value"))
    return R.decoder_counters(df, ["channel_id", "protocol"], F.floor(F.col("seq") / 3))


_WIN = """w AS (SELECT DISTINCT channel_id, CAST(floor(seq / 100) AS BIGINT) AS win FROM v_pdus_tetra),
  pc AS (SELECT channel_id, CAST(floor(seq / 100) AS BIGINT) AS win, count(*) AS pdu_count FROM v_pdus_tetra GROUP BY ALL),
  dg AS (SELECT channel_id, win, 0.1e0 * (win % 7) AS timing_error_rad, win % 3 AS confirmed_bursts, win % 2 AS dsb_count FROM w WHERE win % 4 <> 1),
  wr AS (SELECT channel_id, win, coalesce(pdu_count, 0) AS pdu_count, timing_error_rad, coalesce(confirmed_bursts, 0) AS confirmed_bursts, coalesce(dsb_count, 0) AS dsb_count
    FROM w LEFT JOIN pc USING (channel_id, win) LEFT JOIN dg USING (channel_id, win))"""


def _window_reports(v):
    win = F.floor(F.col("seq") / 100)
    pdus = v.pdus_tetra.withColumn("win", win)
    windows = pdus.select("channel_id", "win").distinct()
    diag = windows.where(F.col("win") % 4 != 1).select(
        "channel_id", "win", (F.col("win") % 7 * 0.1).alias("timing_error_rad"), (F.col("win") % 3).alias("confirmed_bursts"), (F.col("win") % 2).alias("dsb_count")
    )
    return R.window_reports(windows, diag, pdus, ["channel_id", "win"])


@query(
    "rpt3_scan_summary",
    _WIN
    + """, g AS (SELECT channel_id, count(*) AS window_count, count(*) FILTER (pdu_count > 0) AS decoded_window_count, sum(confirmed_bursts) AS confirmed_burst_count FROM wr GROUP BY 1)
      SELECT channel_id, any_value(window_count) AS window_count, any_value(decoded_window_count) AS decoded_window_count, any_value(confirmed_burst_count) AS confirmed_burst_count,
        count(*) AS pdu_count, count(*) FILTER (type = 'TETRA_DMAC_SYNC') AS dmac_sync_count, count(*) FILTER (type = 'TETRA_TCH_CANDIDATE') AS tch_candidate_count
      FROM v_pdus_tetra JOIN g USING (channel_id) GROUP BY channel_id""",
)
def _(v):
    reports = _window_reports(v).withColumn("dnb_count", F.lit(0))
    return R.scan_summary(v.pdus_tetra, reports, ["channel_id"]).select(
        "channel_id", "window_count", "decoded_window_count", "confirmed_burst_count", "pdu_count", "dmac_sync_count", "tch_candidate_count"
    )


@query("rpt4_window_reports", _WIN + " SELECT channel_id, win, pdu_count, round(timing_error_rad, 6) AS timing_error_rad, confirmed_bursts, dsb_count FROM wr")
def _(v):
    return _window_reports(v).withColumn("timing_error_rad", R6("timing_error_rad"))


@query(
    "rpt5_decoder_timing",
    """SELECT channel_id, count(*) AS completions, round(CAST(sum(CAST(compute_sec AS DECIMAL(28, 9))) AS DOUBLE) / count(*), 9) AS mean_compute_sec, max(compute_sec) AS max_compute_sec,
         round(CAST(sum(CAST(dispatch_sec AS DECIMAL(28, 9))) AS DOUBLE) / count(*), 9) AS mean_dispatch_sec, max(dispatch_sec) AS max_dispatch_sec FROM v_metrics GROUP BY ROLLUP (channel_id)""",
)
def _(v):
    return R.decoder_timing(v.metrics, ["channel_id"]).select(
        "channel_id", "completions", F.round("mean_compute_sec", 9).alias("mean_compute_sec"), "max_compute_sec",
        F.round("mean_dispatch_sec", 9).alias("mean_dispatch_sec"), "max_dispatch_sec",
    )


_KEY = "l_orderkey * 1000000 + l_partkey * 8 + l_linenumber"


def _metrics(v):
    """Metrics with an order number that also tells lines of one order apart."""
    c = F.col
    return v.table("lineitem").select(
        (c("l_suppkey") % 8).alias("channel_id"), (c("l_orderkey") * 1000000 + c("l_partkey") * 8 + c("l_linenumber")).alias("seq"),
        c("l_tax").alias("compute_sec"), c("l_discount").alias("dispatch_sec"), c("l_quantity").alias("queue_sec"),
        c("l_extendedprice").alias("wall_sec"), c("l_orderkey").cast("double").alias("logical_sec"),
    )


@query(
    "rpt6_slowest_feed",
    f"""m AS (SELECT l_suppkey % 8 AS channel_id, {_KEY} AS seq, l_tax + l_discount AS elapsed_sec FROM lineitem),
       x AS (SELECT channel_id, max(elapsed_sec) AS elapsed_sec FROM m GROUP BY 1)
       SELECT channel_id, round(elapsed_sec, 6) AS elapsed_sec, min(seq) AS seq FROM m JOIN x USING (channel_id, elapsed_sec) GROUP BY ALL""",
)
def _(v):
    out = R.slowest_feed(_metrics(v), ["channel_id"], F.col("compute_sec") + F.col("dispatch_sec"), "seq")
    return out.select("channel_id", R6("elapsed_sec").alias("elapsed_sec"), "seq")


TARGETS = [100.0, 500.0, 1000.0]


@query(
    "rpt7_checkpoints",
    f"""m AS (SELECT l_suppkey % 8 AS channel_id, {_KEY} AS seq, CAST(l_orderkey AS DOUBLE) AS logical_sec, l_quantity AS queue_sec FROM lineitem),
       r AS (SELECT m.*, t AS target, row_number() OVER (PARTITION BY channel_id, t ORDER BY logical_sec, seq) AS rn FROM m, (VALUES (100e0), (500e0), (1000e0)) AS x(t) WHERE logical_sec >= t)
       SELECT channel_id, target, logical_sec, queue_sec FROM r WHERE rn = 1""",
)
def _(v):
    return R.checkpoints(_metrics(v), ["channel_id"], "logical_sec", TARGETS, ["queue_sec"])


@query(
    "rpt8_interval_trends",
    f"""m AS (SELECT l_suppkey % 8 AS channel_id, {_KEY} AS seq, CAST(l_orderkey AS DOUBLE) AS x, l_extendedprice AS w, l_quantity AS q FROM lineitem),
       i AS (SELECT m.*, a AS start_sec, z AS end_sec FROM m JOIN (SELECT n * w AS a, (n + 1) * w AS z FROM (SELECT unnest([0e0, 1e0, 2e0]) AS n, (SELECT ceil(max(l_orderkey) / 3) FROM lineitem) AS w)) AS e(a, z) ON x BETWEEN a AND z),
       p AS (SELECT channel_id, start_sec, list(q ORDER BY q) AS l FROM i GROUP BY ALL)
       SELECT channel_id, start_sec, end_sec, count(*) AS sample_count, round(avg(q), 6) AS queue_mean_sec, max(q) AS queue_max_sec,
         arg_min(q, struct_pack(a := x, b := seq)) AS queue_start_sec, arg_max(q, struct_pack(a := x, b := seq)) AS queue_end_sec,
         round(regr_slope(q, x), 6) AS queue_slope, any_value(l[CAST(ceil(0.95e0 * len(l)) AS INT)]) AS queue_p95_sec, FALSE AS realtime_pass
       FROM i JOIN p USING (channel_id, start_sec) GROUP BY channel_id, start_sec, end_sec HAVING count(*) >= 2""",
)
def _(v):
    last = v.table("lineitem").agg(F.ceil(F.max("l_orderkey") / 3)).first()[0]
    edges = [float(n * last) for n in range(4)]  # thirds of the whole run
    out = R.passes_realtime(R.interval_trends(_metrics(v), ["channel_id"], edges))
    return out.select(
        "channel_id", "start_sec", "end_sec", "sample_count", R6("queue_mean_sec").alias("queue_mean_sec"), "queue_max_sec",
        "queue_start_sec", "queue_end_sec", R6("queue_slope").alias("queue_slope"), "queue_p95_sec",
        F.coalesce("realtime_pass", F.lit(False)).alias("realtime_pass"),
    )


@query(
    "rpt9_realtime_factor",
    """SELECT o_orderkey, round(o_custkey / 60e0, 6) AS duration_sec, round(o_totalprice / 1000000 / greatest(o_custkey / 60e0, 2.220446049250313e-16), 4) AS real_time_factor
       FROM orders""",
)
def _(v):
    runs = v.table("orders").select(
        "o_orderkey", (F.col("o_custkey") * 800).alias("input_samples"), F.lit(48000.0).alias("sample_rate_hz"), (F.col("o_totalprice") / 1e6).alias("elapsed_sec")
    )
    return R.realtime_factor(runs).select("o_orderkey", R6("duration_sec").alias("duration_sec"), F.round("real_time_factor", 4).alias("real_time_factor"))


@query(
    "rpt10_channel_counts",
    """SELECT n_nationkey AS channel_id, n_name AS label, (SELECT count(*) FROM v_pdus WHERE channel_id = n_nationkey) AS pdu_count FROM nation""",
)
def _(v):
    channels = v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("channel_id"), F.col("n_name").alias("label"))
    return R.channel_counts(channels.withColumn("channel_id", F.col("channel_id").cast("int")), v.pdus.withColumn("channel_id", F.col("channel_id").cast("int")), ["channel_id"])


@query(
    "rpt11_carrier_report",
    STATE_SQL
    + """, pd AS (SELECT CAST(floor(seq / 4096) AS BIGINT) AS channel_id, CASE WHEN k % 50 < 48 THEN 'P25' ELSE 'DMR' END AS protocol, seq FROM v_pdus),
      pp AS (SELECT channel_id, string_agg(protocol, ',' ORDER BY f) AS protocols, sum(n) AS pdu_count FROM (SELECT channel_id, protocol, min(seq) AS f, count(*) AS n FROM pd GROUP BY ALL) GROUP BY 1),
      ee AS (SELECT channel_id, count(*) AS epoch_count, sum(end_sample - candidate_start) AS epoch_samples FROM ep GROUP BY 1)
      SELECT channel_id, protocols, pdu_count, epoch_count, epoch_samples FROM pp JOIN ee USING (channel_id)""",
)
def _(v):
    eps = A.epochs(A.detect_fixed(v.chunks, FLOOR, CFG))
    pdus = v.pdus.select(
        F.floor(F.col("seq") / 4096).alias("channel_id"), "seq", F.when(F.col("k") % 50 < 48, "P25").otherwise("DMR").alias("protocol")
    )
    return R.carrier_report(pdus, eps, ["channel_id"]).withColumn("protocols", F.concat_ws(",", "protocols"))


# ---- comparisons: one sample per channel, some rows lost, some gained

_SIG = """printf('{"protocol":"DMR","type":"%s","src":"%d","dst":"%d","flco":"%s","fid":"%s","extra":{"color_code":%d}}', type, src_num, dst_num, flco, fid, color_code)"""


def _signed(v):
    df = conform_pdus(v.pdus.withColumn("protocol", F.lit("DMR")).drop("value", "fo_hz"))
    df = df.select("channel_id", "seq", "k", "protocol", "type", "src_num", "dst_num", "flco", "fid", F.struct("color_code").alias("extra"))
    return df.withColumn("signature", C.signature(df))


@query("cmp1_signatures", f"SELECT seq, {_SIG} AS signature FROM v_pdus")
def _(v):
    return _signed(v).select("seq", "signature")


_DIFF = f"""s AS (SELECT channel_id, k, {_SIG} AS signature FROM v_pdus),
  df AS (SELECT channel_id, signature, sum(CAST(k % 17 <> 0 AS BIGINT)) - sum(CAST(k % 19 <> 0 AS BIGINT)) AS d FROM s GROUP BY ALL)"""


@query(
    "cmp2_multiset_diff",
    _DIFF + " SELECT channel_id, signature, greatest(d, 0) AS missing, greatest(-d, 0) AS unexpected FROM df WHERE d <> 0",
)
def _(v):
    s = _signed(v)
    return C.multiset_diff(s.where(F.col("k") % 17 != 0), s.where(F.col("k") % 19 != 0), ["channel_id"])


@query(
    "cmp3_sample_verdicts",
    _DIFF
    + """, ct AS (SELECT channel_id, count(*) FILTER (k % 17 <> 0) AS expected_count, count(*) FILTER (k % 19 <> 0) AS actual_count FROM s GROUP BY 1),
      sm AS (SELECT DISTINCT channel_id FROM v_pdus),
      to_ AS (SELECT channel_id, sum(greatest(d, 0)) AS missing_count, sum(greatest(-d, 0)) AS unexpected_count FROM df GROUP BY 1),
      mx AS (SELECT channel_id, string_agg(signature, ';' ORDER BY signature) AS missing_examples FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY signature) AS rn
        FROM (SELECT channel_id, signature, unnest(range(0, CAST(d AS BIGINT))) FROM df WHERE d > 0)) WHERE rn <= 5 GROUP BY 1)
      SELECT channel_id, expected_count, actual_count, missing_count, unexpected_count, coalesce(missing_examples, '') AS missing_examples,
        CASE WHEN channel_id = 1 THEN 'missing golden JSON' WHEN channel_id = 2 THEN 'missing sample file' ELSE '' END AS reason,
        channel_id NOT IN (1, 2) AND missing_count = 0 AND unexpected_count = 0 AS ok
      FROM sm JOIN ct USING (channel_id) JOIN to_ USING (channel_id) LEFT JOIN mx USING (channel_id)""",
)
def _(v):
    s = _signed(v)
    samples = s.select("channel_id").distinct().withColumns({"has_golden": F.col("channel_id") != 1, "has_input": F.col("channel_id") != 2})
    out = C.sample_verdicts(samples, s.where(F.col("k") % 17 != 0), s.where(F.col("k") % 19 != 0), ["channel_id"])
    return out.select(
        "channel_id", "expected_count", "actual_count", "missing_count", "unexpected_count",
        F.concat_ws(";", "missing_examples").alias("missing_examples"), "reason", "ok",
    )


@query(
    "cmp4_schedule_parity",
    STATE_SQL + " SELECT *, CAST(1 AS BIGINT) AS n_first, CAST(1 AS BIGINT) AS n_second, TRUE AS agrees FROM ep",
)
def _(v):
    """Epochs must not depend on how the scan is cut into blocks."""
    cols = ["channel_id", "epoch_id", "candidate_start", "end_sample", "close_reason"]
    wide = A.epochs(A.detect_fixed(v.chunks, FLOOR, CFG))
    narrow = A.epochs(A.detect_fixed(v.chunks, FLOOR, CFG, width=300), width=300)
    return C.parity_report(wide, narrow, cols)
