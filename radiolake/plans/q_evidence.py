"""Evidence, races, sweeps and decoder health."""

from pyspark.sql import functions as F

from radiolake.operators import evidence as E
from radiolake.operators.conform import append_pdus
from radiolake.plans.catalog import query

R6 = lambda c: F.round(c, 6)


def _evidence_rows(v):
    k, grp = F.col("k"), F.floor(F.col("seq") / 6).alias("window")
    dmr = v.pdus.select(
        grp, F.lit("DMR").alias("protocol"), "type",
        F.struct(F.struct((k % 9 == 0).alias("rs_12_9_4_ok")).alias("fec"), (k % 8 == 0).alias("cs5_ok")).alias("extra"),
    )
    p25 = v.pdus_p25.select(grp, "protocol", "type", F.struct((k % 7 == 0).alias("valid_bch")).alias("extra"))
    cch = F.array(F.struct((k % 13 == 0).alias("crc_ok"), (k % 5 == 0).alias("hamming_ok")))
    dpmr = v.cch.select(grp, "protocol", "type", F.struct(cch.alias("cch")).alias("extra"))
    nxdn = v.pdus_nxdn.select(grp, "protocol", "type")
    tetra = v.pdus_tetra.select(grp, "protocol", "type")
    out = dmr
    for part in (p25, dpmr, nxdn, tetra):
        out = append_pdus(out, part)
    return out


def _diagnostics(v):
    k, grp = F.col("k"), F.floor(F.col("seq") / 6).alias("window")
    nxdn = v.pdus_nxdn.groupBy(grp).agg(
        F.count_if(k % 8 == 0).alias("valid_channel_blocks"), F.count_if(k % 4 == 0).alias("lich_ok_count"),
        F.lit(0).cast("bigint").alias("training_good_count"),
    ).withColumn("protocol", F.lit("NXDN"))
    tetra = v.pdus_tetra.groupBy(grp).agg(
        F.lit(0).cast("bigint").alias("valid_channel_blocks"), F.lit(0).cast("bigint").alias("lich_ok_count"),
        F.count_if(k % 5 == 0).alias("training_good_count"),
    ).withColumn("protocol", F.lit("TETRA"))
    return nxdn.unionByName(tetra)


def _verdicts(*rules: tuple) -> str:
    """Three CASE columns from (condition, status, confidence, class) rules."""
    out = []
    for i, name in ((1, "status"), (2, "confidence"), (3, "evidence_class")):
        cases = " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules)
        other = {1: "'no_evidence'", 2: "0e0", 3: "''"}[i]
        out.append(f"CASE {cases} ELSE {other} END AS {name}")
    return ", ".join(out)


_W = "CAST(floor(seq / 6) AS BIGINT) AS \"window\""
_EVD1 = f"""
  d AS (SELECT {_W}, count(*) AS n, count(*) FILTER (type IN ('LC_HEADER', 'TERMINATOR') AND k % 9 = 0) AS rs,
    count(*) FILTER (type = 'LATE_ENTRY' AND k % 8 = 0) AS le, count(*) FILTER (type = 'CSBK') AS wk FROM v_pdus GROUP BY 1),
  p AS (SELECT {_W}, count(*) AS n, count(*) FILTER (k % 7 = 0) AS b FROM v_pdus_p25 GROUP BY 1),
  c AS (SELECT {_W}, count(*) AS n, count(*) FILTER (k % 13 = 0) AS crc, count(*) FILTER (k % 5 = 0) AS ham FROM v_cch GROUP BY 1),
  x AS (SELECT {_W}, count(*) AS n, count(*) FILTER (k % 8 = 0) AS vb, count(*) FILTER (k % 4 = 0) AS lo FROM v_pdus_nxdn GROUP BY 1),
  t AS (SELECT {_W}, count(*) AS n, count(*) FILTER (type IN ('TETRA_DMAC_SYNC', 'TETRA_STCH', 'TETRA_SCHF')) AS ct,
    count(*) FILTER (k % 5 = 0) AS tg FROM v_pdus_tetra GROUP BY 1)
  SELECT "window", 'DMR' AS protocol, n AS pdu_count, {_verdicts(("rs + le > 0", "'confirmed'", "0.99e0", "CASE WHEN rs > 0 THEN 'rs_valid_full_link_control' ELSE 'cs5_valid_late_entry_lc' END"), ("wk > 0", "'candidate'", "0.45e0", "'sync_or_csbk_only'"))} FROM d
  UNION ALL SELECT "window", 'P25', n, {_verdicts(("b > 0", "'confirmed'", "0.99e0", "'bch_valid_nid'"))} FROM p
  UNION ALL SELECT "window", 'dPMR', n, {_verdicts(("crc > 0", "'confirmed'", "0.99e0", "'crc_valid_cch'"), ("ham >= 2", "'confirmed'", "0.9e0", "'repeated_hamming_valid_cch'"), ("ham = 1", "'candidate'", "0.6e0", "'single_hamming_valid_cch'"))} FROM c
  UNION ALL SELECT "window", 'NXDN', n, {_verdicts(("vb > 0 AND lo > 0", "'confirmed'", "0.99e0", "'crc_valid_channel_block'"), ("lo > 0", "'candidate'", "0.5e0", "'valid_lich_only'"))} FROM x
  UNION ALL SELECT "window", 'TETRA', n, {_verdicts(("ct > 0", "'confirmed'", "0.99e0", "'fec_valid_dmo_control_block'"), ("tg > 0", "'candidate'", "0.45e0", "'training_sequence_only'"))} FROM t"""


@query("evd1_probe_evidence", _EVD1)
def _(v):
    return E.probe_evidence(_evidence_rows(v), ["window"], _diagnostics(v)).select(
        "window", "protocol", "pdu_count", "status", "confidence", "evidence_class"
    )


_RANK = "CASE protocol WHEN 'DMR' THEN 0 WHEN 'P25' THEN 1 WHEN 'dPMR' THEN 2 WHEN 'NXDN' THEN 3 ELSE 4 END"


@query(
    "evd2_resolve_race",
    f"""g AS (SELECT epoch_id, generation, count(*) AS n, count(*) FILTER (status = 'confirmed') AS ok, count(*) FILTER (status = 'rejected') AS bad,
          count(*) FILTER (status = 'error') AS err, coalesce(string_agg(protocol, ',' ORDER BY {_RANK}, seq) FILTER (status = 'confirmed'), '') AS confirmed_protocols
        FROM v_probe GROUP BY ALL)
       SELECT epoch_id, generation, confirmed_protocols, CASE WHEN ok = 1 THEN 'confirmed' WHEN ok > 1 THEN 'ambiguous' WHEN bad = n THEN 'rejected_all'
         WHEN err > 0 AND err + bad = n THEN 'error' ELSE 'classifying' END AS outcome, CASE WHEN ok = 1 THEN confirmed_protocols END AS winner FROM g""",
)
def _(v):
    return E.resolve_race(v.probe).select(
        "epoch_id", "generation", F.concat_ws(",", "confirmed_protocols").alias("confirmed_protocols"), "outcome", "winner"
    )


@query(
    "evd3_stale_results",
    """a AS (SELECT c_custkey AS epoch_id, 1 + c_custkey % 2 AS generation, CASE c_custkey % 5 WHEN 0 THEN 'DMR' WHEN 1 THEN 'P25' WHEN 2 THEN 'dPMR'
          WHEN 3 THEN 'NXDN' ELSE 'TETRA' END AS protocol FROM customer)
       SELECT seq, EXISTS (SELECT 1 FROM a WHERE a.epoch_id = p.epoch_id AND a.generation = p.generation AND a.protocol = p.protocol) AS current FROM v_probe AS p""",
)
def _(v):
    c = F.col("c_custkey")
    names = F.array(*[F.lit(n) for n in ("DMR", "P25", "dPMR", "NXDN", "TETRA")])
    active = v.table("customer").select(
        c.alias("epoch_id"), (1 + c % 2).alias("generation"), F.get(names, (c % 5).cast("int")).alias("protocol")
    )
    current, stale = E.split_stale(v.probe, active)
    return current.select("seq", F.lit(True).alias("current")).unionByName(stale.select("seq", F.lit(False).alias("current")))


@query(
    "evd4_early_confirm",
    """f AS (SELECT epoch_id, generation, min(seq) AS s, arg_min(confidence, seq) AS c FROM v_probe WHERE status = 'confirmed' GROUP BY ALL)
       SELECT seq, CASE WHEN c >= 0.99e0 AND seq > s THEN 'pending' ELSE status END AS status, coalesce(c >= 0.99e0, FALSE) AS ended_early,
         CASE WHEN c >= 0.99e0 AND seq > s THEN 'not_evaluated_after_strong_winner' ELSE '' END AS reason
       FROM v_probe LEFT JOIN f USING (epoch_id, generation)""",
)
def _(v):
    return E.early_confirm(v.probe).select("seq", "status", "ended_early", "reason")


@query(
    "evd5_probe_schedule",
    """w(protocol, ws) AS (VALUES ('DMR', [0.3e0, 0.6e0, 1.2e0, 1.5e0]), ('P25', [0.1e0, 0.2e0, 0.4e0, 0.8e0, 1e0]), ('dPMR', [0.32e0, 0.64e0, 1.28e0, 1.5e0]),
         ('NXDN', [0.16e0, 0.32e0, 0.64e0, 1e0]), ('TETRA', [0.5e0, 1e0, 2e0, 4e0, 6e0])),
       s AS (SELECT seq, protocol, status, window_samples / 100 AS sec, ws FROM v_probe JOIN w USING (protocol)),
       d AS (SELECT *, sec + 0.01e0 >= ws[-1] AND status NOT IN ('confirmed', 'error') AS done FROM s)
       SELECT seq, CASE WHEN done THEN 'rejected' ELSE status END AS final_status, len(ws) AS windows, round(list_sum(ws), 6) AS total_sec,
         round(CASE WHEN NOT done AND status IN ('candidate', 'error', 'no_evidence') THEN least(ws[-1], greatest(ws[1], sec * 2)) END, 6) AS next_window_sec FROM d""",
)
def _(v):
    trials = E.probe_status(v.probe.withColumn("sample_rate_hz", F.lit(100.0)))
    plan = E.probe_schedule(v.probe.select("seq", "protocol")).groupBy("seq").agg(
        F.count(F.lit(1)).alias("windows"), R6(F.sum("window_sec")).alias("total_sec")
    )
    return trials.select("seq", "final_status", R6("next_window_sec").alias("next_window_sec")).join(plan, "seq")


@query(
    "evd6_probe_ready",
    """s AS (SELECT seq, status, window_samples / 100 + 0.01e0 < CASE WHEN seq % 2 = 0 THEN 2e0 ELSE 4e0 END AS short, seq % 3 = 0 AS old FROM v_probe),
       r AS (SELECT *, CASE WHEN status IN ('confirmed', 'rejected') THEN 'terminal_probe_state' WHEN short THEN 'awaiting_probe_window'
         WHEN old THEN 'awaiting_new_samples' ELSE '' END AS wait_reason FROM s) SELECT seq, wait_reason, wait_reason = '' AS ready FROM r""",
)
def _(v):
    seq = F.col("seq")
    df = v.probe.select(
        "seq", "status", F.col("window_samples").alias("available_samples"), F.lit(100.0).alias("sample_rate_hz"),
        F.when(seq % 2 == 0, 2.0).otherwise(4.0).alias("next_window_sec"), F.col("window_end_sample").alias("end_sample"),
        F.when(seq % 3 == 0, F.col("window_end_sample")).otherwise(F.col("window_end_sample") - 1).alias("last_attempted_end"),
    )
    return E.probe_ready(df).select("seq", "wait_reason", "ready")


OFFSETS, SNRS, SHIFTS, WINDOWS = [0.0, 0.1, 0.5], [6.0, 12.0], [-200.0, 200.0], [0.1, 0.2, 0.4, 0.8]


def _trials(v, stop=True):
    s = F.col("s_suppkey")
    rec = v.table("supplier").select(
        s.alias("recording_id"), (400 + s % 900).alias("sample_count"), F.lit(1000.0).alias("sample_rate_hz")
    )
    # each trial's outcome comes from the part its number falls on
    grid = rec
    for name, values in (("offset_sec", OFFSETS), ("snr_db", SNRS), ("shift_hz", SHIFTS), ("window_sec", WINDOWS)):
        grid = grid.select("*", F.posexplode(F.array(*[F.lit(x) for x in values])).alias(f"i_{name}", name))
    number = (
        F.col("recording_id") * 48 + F.col("i_offset_sec") * 16 + F.col("i_snr_db") * 8 + F.col("i_shift_hz") * 4 + F.col("i_window_sec")
    )
    parts = v.table("part").select((F.col("p_partkey") % 200).alias("n"), "p_partkey", "p_size").groupBy("n").agg(
        F.min_by("p_size", "p_partkey").alias("size")
    )
    outcomes = grid.withColumn("n", number % 200).join(parts, "n").select(
        "recording_id", "offset_sec", "snr_db", "shift_hz", "window_sec", F.lit(1).alias("seed"),
        F.when(F.col("size") > 35, "confirmed").otherwise("candidate").alias("status"),
        (F.col("size") / 100).alias("elapsed_sec"), F.lit("bch_valid_nid").alias("evidence_class"),
    )
    return E.sweep_trials(rec, outcomes, OFFSETS, SNRS, SHIFTS, WINDOWS, [1], stop)


_SWEEP = """
  pt AS (SELECT p_partkey % 200 AS n, arg_min(p_size, p_partkey) AS size FROM part GROUP BY 1),
  gr AS (SELECT s_suppkey AS recording_id, 400 + s_suppkey % 900 AS cnt, o.i AS oi, o.x AS offset_sec, s.i AS si, s.x AS snr_db, f.i AS fi, f.x AS shift_hz, w.i AS attempt, w.x AS window_sec
    FROM supplier, (VALUES (0, 0e0), (1, 0.1e0), (2, 0.5e0)) AS o(i, x), (VALUES (0, 6e0), (1, 12e0)) AS s(i, x), (VALUES (0, -200e0), (1, 200e0)) AS f(i, x),
      (VALUES (0, 0.1e0), (1, 0.2e0), (2, 0.4e0), (3, 0.8e0)) AS w(i, x)),
  tr AS (SELECT gr.*, size, ceil(window_sec * 1000) <= least(cnt - floor(offset_sec * 1000), 800) AS enough FROM gr JOIN pt ON pt.n = (recording_id * 48 + oi * 16 + si * 8 + fi * 4 + attempt) % 200
    WHERE floor(offset_sec * 1000) < cnt),
  ts AS (SELECT *, enough AND size > 35 AS confirmed, CASE WHEN NOT enough THEN 'unavailable' WHEN size > 35 THEN 'confirmed' ELSE 'candidate' END AS status,
    CASE WHEN enough THEN size / 100 ELSE 0 END AS elapsed_sec FROM tr),
  tk AS (SELECT * FROM (SELECT *, coalesce(bool_or(confirmed) OVER (PARTITION BY recording_id, oi, si, fi ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS hit FROM ts) WHERE NOT hit),
  cd AS (SELECT recording_id, offset_sec, snr_db, shift_hz, bool_or(confirmed) AS confirmed, min(window_sec) FILTER (confirmed) AS minimum_sec,
    count(*) AS attempt_count, sum(elapsed_sec) AS elapsed_sec FROM tk GROUP BY ALL)"""


@query("evd7_sweep_trials", _SWEEP + " SELECT recording_id, offset_sec, snr_db, shift_hz, window_sec, status FROM tk")
def _(v):
    return _trials(v).select("recording_id", "offset_sec", "snr_db", "shift_hz", "window_sec", "status")


@query(
    "evd8_sweep_conditions",
    _SWEEP + " SELECT recording_id, offset_sec, snr_db, shift_hz, confirmed, minimum_sec, attempt_count, round(elapsed_sec, 6) AS elapsed_sec FROM cd",
)
def _(v):
    return E.sweep_conditions(_trials(v)).select(
        "recording_id", "offset_sec", "snr_db", "shift_hz", "confirmed", "minimum_sec", "attempt_count", R6("elapsed_sec").alias("elapsed_sec")
    )


@query(
    "evd9_sweep_summary",
    _SWEEP
    + """ SELECT snr_db, shift_hz, count(*) AS condition_count, count(*) FILTER (confirmed) AS confirmed_count,
      round(count(*) FILTER (confirmed) / count(*), 6) AS success_ratio, round(quantile_cont(minimum_sec, 0.5) FILTER (confirmed), 6) AS p50_sec,
      round(quantile_cont(minimum_sec, 0.95) FILTER (confirmed), 6) AS p95_sec, round(quantile_cont(minimum_sec, 0.99) FILTER (confirmed), 6) AS p99_sec,
      max(minimum_sec) AS max_sec FROM cd GROUP BY ALL""",
)
def _(v):
    out = E.sweep_summary(E.sweep_conditions(_trials(v)))
    return out.select(
        "snr_db", "shift_hz", "condition_count", "confirmed_count", R6("success_ratio").alias("success_ratio"),
        *[R6(c).alias(c) for c in ("p50_sec", "p95_sec", "p99_sec")], "max_sec",
    )


@query(
    "evd10_epoch_rollup",
    f"""e AS (SELECT epoch_id AS capture, seq, CASE WHEN status = 'candidate' THEN CASE WHEN seq % 3 = 0 THEN 'ambiguous' ELSE 'timeout' END ELSE status END AS outcome,
          CASE WHEN status = 'confirmed' THEN protocol ELSE '' END AS protocol, CASE seq % 3 WHEN 0 THEN 'serial' WHEN 1 THEN 'parallel' ELSE '' END AS mode FROM v_probe),
       pr AS (SELECT capture, string_agg(protocol, ',' ORDER BY f) AS protocols, count(*) AS np FROM (SELECT capture, protocol, min(seq) AS f FROM e WHERE protocol <> '' GROUP BY ALL) GROUP BY 1),
       mo AS (SELECT capture, CASE WHEN count(DISTINCT mode) > 1 THEN 'mixed' ELSE max(mode) END AS m FROM e WHERE mode <> '' GROUP BY 1),
       g AS (SELECT capture, count(*) AS n, count(*) FILTER (outcome = 'confirmed') AS ok, bool_or(outcome = 'ambiguous') AS am, bool_or(outcome = 'timeout') AS ti, bool_or(outcome = 'error') AS er FROM e GROUP BY 1)
       SELECT capture, n AS epoch_count, ok AS confirmed_count, CASE WHEN ok = n THEN 'confirmed' WHEN ok > 0 THEN 'partial' WHEN am THEN 'ambiguous' WHEN ti THEN 'timeout'
         WHEN er THEN 'error' ELSE 'unclassified' END AS outcome, coalesce(protocols, '') AS protocols, CASE WHEN np = 1 THEN protocols ELSE '' END AS selected_protocol,
         coalesce(m, '') AS execution_mode FROM g LEFT JOIN pr USING (capture) LEFT JOIN mo USING (capture)""",
)
def _(v):
    seq = F.col("seq")
    eps = v.probe.select(
        F.col("epoch_id").alias("capture"), "seq",
        F.when(F.col("status") == "candidate", F.when(seq % 3 == 0, "ambiguous").otherwise("timeout")).otherwise(F.col("status")).alias("outcome"),
        F.when(F.col("status") == "confirmed", F.col("protocol")).otherwise("").alias("protocol"),
        F.when(seq % 3 == 0, "serial").when(seq % 3 == 1, "parallel").otherwise("").alias("execution_mode"),
    )
    return E.epoch_rollup(eps, ["capture"]).withColumn("protocols", F.concat_ws(",", "protocols"))


_VERD = "CASE WHEN k % 4 = 0 THEN 'confirmed' WHEN k = 77 THEN 'error' ELSE 'no_evidence' END"
_HEALTH = f"""
  vd AS (SELECT CAST(floor(seq / 512) AS BIGINT) AS lock, seq, {_VERD} AS verdict FROM v_chunks),
  gr AS (SELECT *, sum(CAST(verdict = 'confirmed' AS BIGINT)) OVER (PARTITION BY lock ORDER BY seq) AS g FROM vd),
  ms AS (SELECT *, sum(CAST(verdict <> 'confirmed' AS BIGINT)) OVER (PARTITION BY lock, g ORDER BY seq) AS misses FROM gr),
  he AS (SELECT lock, seq, misses, CASE WHEN verdict = 'confirmed' THEN 'healthy' WHEN verdict = 'error' THEN 'error' WHEN misses >= 6 THEN 'lost'
    WHEN misses >= 3 THEN 'suspect' ELSE 'no_evidence' END AS health FROM ms)"""


def _health(v):
    k = F.col("k")
    df = v.chunks.select(
        F.floor(F.col("seq") / 512).alias("lock"), "seq",
        F.when(k % 4 == 0, "confirmed").when(k == 77, "error").otherwise("no_evidence").alias("verdict"),
    )
    return E.decoder_health(df, ["lock"])


@query("evd11_decoder_health", _HEALTH + " SELECT * FROM he")
def _(v):
    return _health(v).select("lock", "seq", "misses", "health")


@query(
    "evd11_health_events",
    _HEALTH
    + """, st AS (SELECT *, last_value(CASE health WHEN 'suspect' THEN 1 WHEN 'healthy' THEN 0 END IGNORE NULLS) OVER w AS pend,
      coalesce(bool_or(health IN ('lost', 'error')) OVER w, FALSE) AS gone FROM he WINDOW w AS (PARTITION BY lock ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ev AS (SELECT *, coalesce(pend, 0) = 1 AS p FROM st WHERE NOT gone)
    SELECT lock, seq, CASE WHEN health IN ('lost', 'error') THEN 'DECODER_LOST' WHEN health = 'healthy' THEN 'DECODER_RECOVERED' ELSE 'DECODER_SUSPECT' END AS event,
      CASE WHEN p THEN 'LOSS_PENDING' ELSE 'LOCKED' END AS from_state, CASE WHEN health IN ('lost', 'error') THEN 'RECLASSIFYING' WHEN health = 'healthy' THEN 'LOCKED' ELSE 'LOSS_PENDING' END AS to_state
    FROM ev WHERE health IN ('lost', 'error') OR (health = 'healthy' AND p) OR (health = 'suspect' AND NOT p)""",
)
def _(v):
    return E.health_events(_health(v), ["lock"])


@query(
    "evd12_protocol_rollover",
    """w AS (SELECT channel_id, seq, end_sample AS sample, CASE WHEN k < 60 THEN 'DMR' ELSE 'P25' END AS protocol, CASE WHEN k % 10 = 0 THEN 0 ELSE end_sample - k * 200 END AS ls, start_sample FROM v_chunks),
       l AS (SELECT *, lag(protocol) OVER (PARTITION BY channel_id ORDER BY seq) AS old FROM w),
       e AS (SELECT *, coalesce(old <> protocol, FALSE) AS sw, CASE WHEN old IS NULL THEN start_sample WHEN old <> protocol THEN CASE WHEN ls > 0 THEN ls ELSE sample END END AS edge FROM l)
       SELECT channel_id, seq, protocol, sw AS is_switch, max(edge) OVER x AS boundary, sum(CAST(sw OR old IS NULL AS BIGINT)) OVER x AS epoch_id
       FROM e WINDOW x AS (PARTITION BY channel_id ORDER BY seq)""",
)
def _(v):
    k = F.col("k")
    df = v.chunks.select(
        "channel_id", "seq", F.col("end_sample").alias("sample"), "start_sample", F.when(k < 60, "DMR").otherwise("P25").alias("protocol"),
        F.when(k % 10 == 0, 0).otherwise(F.col("end_sample") - k * 200).alias("last_strong_sample"),
    )
    return E.protocol_rollover(df, ["channel_id"]).select("channel_id", "seq", "protocol", "is_switch", "boundary", "epoch_id")


@query(
    "evd13_catchup_range",
    """c AS (SELECT seq, start_sample AS cs, greatest(0, start_sample - k * 500) AS rs, end_sample AS re, end_sample - CASE WHEN k % 2 = 0 THEN 0 ELSE 100 END AS es FROM v_chunks),
       d AS (SELECT *, greatest(0, cs - 24000) AS ds FROM c)
       SELECT seq, greatest(rs, ds) AS catchup_start, greatest(rs, ds) > ds AS truncated, es - greatest(rs, ds) AS samples, es = re AS at_live_edge FROM d""",
)
def _(v):
    k = F.col("k")
    df = v.chunks.select(
        "seq", F.col("start_sample").alias("candidate_start"), F.greatest(F.lit(0), F.col("start_sample") - k * 500).alias("retained_start"),
        F.col("end_sample").alias("retained_end"), (F.col("end_sample") - F.when(k % 2 == 0, 0).otherwise(100)).alias("end_sample"), "sample_rate_hz",
    )
    return E.catchup_range(df).select("seq", "catchup_start", "truncated", "samples", "at_live_edge")


@query(
    "evd14_best_variant",
    """s AS (SELECT *, CAST(floor(seq / 4) AS BIGINT) AS scan, seq % 4 AS v, k % 7 * 10 + k % 3 * 1000 + k % 5 * 100 AS s FROM v_payload)
       SELECT scan, arg_max(v, struct_pack(a := s, b := -v)) AS variant, max(s) AS total FROM s GROUP BY scan""",
)
def _(v):
    k = F.col("k")
    df = v.payload.select(
        F.floor(F.col("seq") / 4).alias("scan"), (F.col("seq") % 4).alias("variant"), (k % 7 * 10).alias("score"),
        (k % 3).alias("good_count"), (k % 5).alias("candidate_count"),
    )
    total = F.col("score") + 1000 * F.col("good_count") + 100 * F.col("candidate_count")
    return E.best_variant(df, ["scan"], "variant").select("scan", "variant", total.alias("total"))


@query(
    "evd15_frame_quality",
    """f AS (SELECT CAST(floor(seq / 2) AS BIGINT) AS frame, min(color_code) AS cc, min(k) AS k, list(struct_pack(n := frame_number, c := crc_ok, h := hamming_ok)) AS r FROM v_cch GROUP BY 1),
       q AS (SELECT *, len(list_filter(r, lambda x: x.c)) AS crc, len(list_filter(r, lambda x: x.h)) AS ham,
         list_transform(list_filter(r, lambda x: x.c OR x.h), lambda x: x.n) AS ns FROM f),
       p AS (SELECT *, (list_contains(ns, 0) AND list_contains(ns, 1)) OR (list_contains(ns, 2) AND list_contains(ns, 3)) AS pair FROM q)
       SELECT frame, CAST(crc AS BIGINT) AS crc_ok_count, CAST(ham AS BIGINT) AS hamming_ok_count, pair AS valid_frame_pair, cc >= 0 AND len(ns) > 0 AS usable,
         CASE WHEN crc > 0 THEN 'high' WHEN pair THEN 'medium' WHEN ham > 0 THEN 'low' ELSE 'none' END AS confidence,
         round(8 * crc + 2 * ham + CASE WHEN cc >= 0 THEN 2 ELSE 0 END + CASE WHEN pair THEN 3 ELSE 0 END - 0.2e0 * (k / 10e0), 6) AS header_score FROM p""",
)
def _(v):
    df = v.cch.groupBy(F.floor(F.col("seq") / 2).alias("frame")).agg(
        F.min("color_code").alias("color_code"), (F.min("k") / 10.0).alias("resid"),
        F.collect_list(F.struct("frame_number", "crc_ok", "hamming_ok")).alias("cch"),
    )
    return E.frame_quality(df).select(
        "frame", F.col("crc_ok_count").cast("bigint").alias("crc_ok_count"), F.col("hamming_ok_count").cast("bigint").alias("hamming_ok_count"),
        "valid_frame_pair", "usable", "confidence", R6("header_score").alias("header_score"),
    )
