"""Call and session assembly."""

from pyspark.sql import functions as F

from radiolake.functions.keys import dmr_key
from radiolake.functions.ordered import settle
from radiolake.operators import sessions as S
from radiolake.operators.conform import conform_pdus
from radiolake.operators.dedup import first_by_key
from radiolake.plans.catalog import query


def dmr_rows(v):
    return conform_pdus(v.pdus).select(
        "channel_id", "seq", "protocol", "type", "src_num", "dst_num", "flco", "fid", "fo_hz",
        F.struct("fs_start", "color_code").alias("extra"),
    )


def _dmr_sql(source: str) -> str:
    return f"""
      r AS (SELECT channel_id, seq, type, src_num AS src, dst_num AS dst, nullif(flco, '') AS flco, nullif(fid, '') AS fid,
          color_code, fs_start, type IN ('LC_HEADER', 'LATE_ENTRY') OR (type = 'CSBK' AND (src_num <> 0 OR dst_num <> 0)) AS starter
        FROM {source} WHERE type IN ('LC_HEADER', 'LATE_ENTRY', 'TERMINATOR', 'CSBK')),
      a AS (SELECT *, max(CASE WHEN starter THEN seq END) OVER w AS ls, max(CASE WHEN type = 'TERMINATOR' THEN seq END) OVER w AS lt
        FROM r WINDOW w AS (PARTITION BY channel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      b AS (SELECT *, ls IS NOT NULL AND (lt IS NULL OR ls > lt) AS open FROM a),
      c AS (SELECT *, type = 'TERMINATOR' AND open AS closes,
          type IN ('LC_HEADER', 'LATE_ENTRY') OR (type = 'TERMINATOR' AND open) OR (type = 'CSBK' AND starter AND NOT open) AS upd FROM b),
      d AS (SELECT *, coalesce(sum(CAST(closes AS BIGINT)) OVER w, 0) AS sid FROM c
        WINDOW w AS (PARTITION BY channel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      e AS (SELECT *, last_value(CASE WHEN upd THEN flco END IGNORE NULLS) OVER (PARTITION BY channel_id, sid ORDER BY seq) AS sflco FROM d),
      f AS (SELECT *, CASE WHEN upd THEN CASE sflco WHEN 'GroupVoiceChannelUser' THEN 'group'
          WHEN 'UnitToUnitVoiceChannelUser' THEN 'unit_to_unit' END END AS ct FROM e),
      calls AS (SELECT channel_id, min(CASE WHEN starter THEN seq END) AS start_seq,
          coalesce(arg_max(src, seq) FILTER (upd AND src <> 0), 0) AS src, coalesce(arg_max(dst, seq) FILTER (upd AND dst <> 0), 0) AS dst,
          coalesce(arg_max(flco, seq) FILTER (upd AND flco IS NOT NULL), '') AS flco,
          coalesce(arg_max(fid, seq) FILTER (upd AND fid IS NOT NULL), '') AS fid,
          coalesce(arg_max(ct, seq) FILTER (ct IS NOT NULL), '') AS call_type,
          arg_max(color_code, seq) FILTER (upd) AS color_code, min(fs_start) FILTER (upd) AS start_sample,
          max(fs_start) FILTER (upd) AS end_sample, count(*) FILTER (type <> 'TERMINATOR') AS signalling_count,
          count(*) FILTER (type = 'LATE_ENTRY') AS late_entry_count, count(*) FILTER (type = 'CSBK') AS csbk_count,
          CASE WHEN bool_or(closes) THEN 'terminator' ELSE 'end_of_scan' END AS closed_by
        FROM f GROUP BY channel_id, sid HAVING bool_or(starter))"""


_CALL_COLS = """channel_id, start_seq, src, dst, flco, fid, call_type, color_code, start_sample, end_sample,
  round((end_sample - start_sample) / 48000, 3) AS duration_s, signalling_count, late_entry_count, csbk_count, closed_by"""
_CALL_NAMES = [
    "channel_id", "start_seq", "src", "dst", "flco", "fid", "call_type", "color_code", "start_sample", "end_sample",
    "duration_s", "signalling_count", "late_entry_count", "csbk_count", "closed_by",
]


@query("ses1_dmr_calls", f"{_dmr_sql('v_pdus')} SELECT {_CALL_COLS} FROM calls")
def _(v):
    return S.dmr_calls(dmr_rows(v)).select(*_CALL_NAMES)


@query(
    "calls_per_channel",
    f"""n AS (SELECT *, row_number() OVER (PARTITION BY channel_id, coalesce(protocol, 'DMR'), src_num, dst_num, type,
          CAST(round(coalesce(fo_hz, 0) / 5000) AS BIGINT) ORDER BY seq) AS rn FROM v_pdus),
      u AS (SELECT * FROM n WHERE rn = 1), {_dmr_sql('u')}
      SELECT channel_id, closed_by, count(*) AS calls, sum(signalling_count) AS signalling,
        round(sum(CAST(end_sample - start_sample AS BIGINT)) / 48000, 3) AS air_time_s, max(end_sample - start_sample) AS longest_samples
      FROM calls GROUP BY channel_id, closed_by""",
)
def _(v):
    """Calls per channel with duration and closing reason, after duplicate removal."""
    rows = dmr_rows(v)
    calls = S.dmr_calls(settle(first_by_key(rows, dmr_key(rows), ["channel_id"], ["seq"])))
    length = F.col("end_sample") - F.col("start_sample")
    return calls.groupBy("channel_id", "closed_by").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("signalling_count").alias("signalling"),
        F.round(F.sum(length) / 48000, 3).alias("air_time_s"),
        F.max(length).alias("longest_samples"),
    )


@query(
    "ses2_p25_calls",
    """t AS (SELECT *, max(CASE WHEN duid_name = 'TDU' THEN seq END) OVER (PARTITION BY channel_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sid FROM v_pdus_p25),
       s AS (SELECT *, min(CASE WHEN duid_name IN ('HDU', 'LDU1', 'LDU2') THEN seq END) OVER (PARTITION BY channel_id, sid) AS start_seq FROM t)
       SELECT channel_id, start_seq, coalesce(arg_max(lc_src, seq) FILTER (lc_src IS NOT NULL), 0) AS src,
         coalesce(arg_max(lc_dst, seq) FILTER (lc_src IS NOT NULL), 0) AS dst,
         CASE WHEN arg_max(lc_is_group, seq) FILTER (lc_src IS NOT NULL) THEN 'GROUP' ELSE '' END AS flco,
         arg_min(nac, seq) FILTER (seq >= start_seq) AS nac, count(*) FILTER (duid_name IN ('LDU1', 'LDU2')) AS ldu_count,
         round((max(fs_start) FILTER (duid_name = 'TDU') - min(fs_start) FILTER (seq >= start_seq)) / 48000, 3) AS duration_s
       FROM s WHERE start_seq IS NOT NULL GROUP BY channel_id, sid, start_seq HAVING bool_or(duid_name = 'TDU')""",
)
def _(v):
    lc = F.when(
        F.col("lc_src").isNotNull(),
        F.struct(F.col("lc_src").alias("src"), F.col("lc_dst").alias("dst"), F.col("lc_is_group").alias("is_group")),
    )
    df = v.pdus_p25.select("channel_id", "seq", "duid_name", "nac", "fs_start", lc.alias("lc"))
    return S.p25_calls(df).select("channel_id", "start_seq", "src", "dst", "flco", "nac", "ldu_count", "duration_s")


def _nxdn(v):
    return v.pdus_nxdn.select(
        "channel_id", "seq", "type", "src_num", "dst_num",
        F.struct(
            "call_type", "ran", "fs_start", "alias_segment", "alias_total",
            F.array("alias_byte", F.lit(32), F.col("alias_byte") + 1, F.lit(7)).alias("alias_bytes"), "payload_hex",
        ).alias("extra"),
    )


_NXDN_OPEN = """
  m AS (SELECT * FROM v_pdus_nxdn WHERE type <> 'NXDN_IDLE'),
  t AS (SELECT *, max(CASE WHEN type = 'NXDN_VCALL' THEN seq END) OVER w AS lv,
      coalesce(max(CASE WHEN type = 'NXDN_TX_REL' THEN seq END) OVER w, -1) AS sid
    FROM m WINDOW w AS (PARTITION BY channel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  o AS (SELECT * FROM t WHERE type = 'NXDN_VCALL' OR (lv IS NOT NULL AND lv > sid)),
  p AS (SELECT * FROM o WHERE type = 'NXDN_PROP_ALIAS' AND alias_segment >= 1 AND alias_total >= alias_segment),
  g AS (SELECT channel_id, sid, alias_segment, arg_max(alias_byte, seq) AS b FROM p GROUP BY ALL),
  l AS (SELECT channel_id, sid, arg_max(alias_total, seq) AS total FROM p GROUP BY ALL),
  n AS (SELECT g.channel_id, g.sid, trim(string_agg(chr(CAST(b AS INT)) || ' ' || chr(CAST(b + 1 AS INT)), '' ORDER BY alias_segment)) AS alias
    FROM g JOIN l USING (channel_id, sid) WHERE alias_segment <= total GROUP BY ALL)"""


@query(
    "ses3_nxdn_calls",
    _NXDN_OPEN
    + """, c AS (SELECT channel_id, sid, min(seq) FILTER (type = 'NXDN_VCALL') AS start_seq,
          arg_max(src_num, seq) FILTER (type = 'NXDN_VCALL') AS src, arg_max(dst_num, seq) FILTER (type = 'NXDN_VCALL') AS dst,
          upper(arg_max(call_type, seq) FILTER (type = 'NXDN_VCALL')) AS flco, arg_max(ran, seq) FILTER (type = 'NXDN_VCALL') AS ran,
          min(fs_start) FILTER (type = 'NXDN_VCALL') AS start_sample, max(fs_start) AS end_sample,
          count(*) FILTER (type = 'NXDN_VCALL') AS message_count,
          CASE WHEN bool_or(type = 'NXDN_TX_REL') THEN 'NXDN_TX_REL' ELSE 'end_of_input' END AS closed_by,
          coalesce(max(payload_hex) FILTER (type = 'NXDN_TX_REL'), '') AS last_payload_hex
        FROM o GROUP BY channel_id, sid)
       SELECT c.channel_id, start_seq, src, dst, flco, ran, start_sample, end_sample,
         round((end_sample - start_sample) / 48000, 3) AS duration_s, message_count, coalesce(alias, '') AS alias, closed_by, last_payload_hex
       FROM c LEFT JOIN n USING (channel_id, sid)""",
)
def _(v):
    return S.nxdn_calls(_nxdn(v)).select(
        "channel_id", "start_seq", "src", "dst", "flco", "ran", "start_sample", "end_sample", "duration_s",
        "message_count", "alias", "closed_by", "last_payload_hex",
    )


@query("ses4_dpmr_calls")
def _(v):
    cch = F.struct(
        "frame_number", "id_half", "crc_ok", "hamming_ok", "communication_mode", "version", "comms_format",
        "emergency_priority",
    )
    part = F.when(F.col("frame_number") < 2, "dst").otherwise("src")
    df = v.cch.select(
        "channel_id", "seq", "type", "src", "dst",
        F.struct("color_code", "fs_start", "sync_type", part.alias("superframe_part"), F.array(cch).alias("cch")).alias("extra"),
    )
    calls = S.dpmr_calls(df)
    lists = ["sync_types", "superframe_parts", "communication_modes", "versions", "comms_formats", "emergency_priorities"]
    return calls.withColumns({n: F.concat_ws(",", F.col(n).cast("array<string>")) for n in lists})


def _tetra(v):
    return v.pdus_tetra.select(
        "channel_id", "seq", "type", "flco", "src_num", "dst_num",
        F.struct(
            "start_time_s", "end_time_s", "slot_start_bit", "slot_end_bit", "frame_number", "slot_number", "mni", "service"
        ).alias("extra"),
    )


@query(
    "ses5_tetra_sessions",
    """r AS (SELECT *, coalesce(start_time_s, end_time_s, seq) AS t, type = 'TETRA_TCH_CANDIDATE' AS tch FROM v_pdus_tetra),
       a AS (SELECT *, NOT tch AND flco IN ('DM-SETUP', 'DM-OCCUPIED') AS starts FROM r),
       b AS (SELECT *, last_value(CASE WHEN starts THEN src_num * 10 + dst_num END IGNORE NULLS) OVER (PARTITION BY channel_id
          ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS who FROM a),
       c AS (SELECT *, starts AND (who IS NULL OR who <> src_num * 10 + dst_num) AS opens FROM b),
       d AS (SELECT *, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY channel_id ORDER BY t, seq) AS sid,
          row_number() OVER (PARTITION BY channel_id ORDER BY t, seq) AS pos FROM c),
       g AS (SELECT channel_id, sid, max(CASE WHEN opens THEN seq END) AS start_seq, max(CASE WHEN opens THEN src_num END) AS src,
          max(CASE WHEN opens THEN dst_num END) AS dst, max(CASE WHEN opens THEN start_time_s END) AS st,
          arg_max(end_time_s, pos) FILTER (end_time_s IS NOT NULL) AS et, max(CASE WHEN opens THEN slot_start_bit END) AS start_bit,
          arg_max(slot_end_bit, pos) AS end_bit, arg_max(frame_number, pos) FILTER (NOT tch) AS end_frame_number,
          arg_min(service, pos) FILTER (NOT tch AND service <> '') AS service,
          count(*) FILTER (type = 'TETRA_DMAC_SYNC') AS sync_event_count, count(*) FILTER (type = 'TETRA_STCH') AS stch_event_count,
          count(*) FILTER (NOT tch) AS control_event_count, count(*) FILTER (tch) AS tch_candidate_count,
          arg_max(flco, pos) FILTER (NOT tch AND flco IN ('DM-RELEASE', 'DM-TX CEASED')) AS rel
        FROM d WHERE sid > 0 GROUP BY channel_id, sid)
       SELECT channel_id, start_seq, src, dst, CASE WHEN sid < max(sid) OVER (PARTITION BY channel_id) THEN 'closed_by_new_session'
           WHEN rel IS NOT NULL THEN 'closed' ELSE 'open' END AS state, round(st, 6) AS start_time_s, round(coalesce(et, st), 6) AS end_time_s,
         start_bit, end_bit, end_frame_number, coalesce(service, '') AS service, sync_event_count, stch_event_count,
         control_event_count, tch_candidate_count, coalesce(rel, '') AS release_message FROM g""",
)
def _(v):
    df = S.tetra_sessions(_tetra(v), width_sec=86400.0)
    return df.select(
        "channel_id", "start_seq", "src", "dst", "state", F.round("start_time_s", 6).alias("start_time_s"),
        F.round("end_time_s", 6).alias("end_time_s"), "start_bit", "end_bit", "end_frame_number", "service",
        "sync_event_count", "stch_event_count", "control_event_count", "tch_candidate_count", "release_message",
    )


@query("ses6_alias_assembly", _NXDN_OPEN + " SELECT channel_id, sid, alias FROM n")
def _(v):
    from radiolake.functions.ordered import before, scan

    df = v.pdus_nxdn
    typ, seq = F.col("type"), F.col("seq")
    rows = scan(
        df, ["channel_id"], "seq",
        [
            before("lv", "max", F.when(typ == "NXDN_VCALL", seq)),
            before("sid", "max", F.when(typ == "NXDN_TX_REL", seq)),
        ],
    ).withColumn("sid", F.coalesce("sid", F.lit(-1)))
    inside = rows.where((typ == "NXDN_PROP_ALIAS") & (F.col("lv") > F.col("sid")))
    named = inside.withColumn(
        "alias_bytes", F.array("alias_byte", F.lit(32), F.col("alias_byte") + 1, F.lit(7)).cast("array<bigint>")
    )
    return S.assemble_alias(named, ["channel_id", "sid"])


@query(
    "ses7_superframes",
    """r AS (SELECT *, lag(part, 1) OVER w AS p1, lag(part, 2) OVER w AS p2, lag(part, 3) OVER w AS p3,
          lag(crc_ok AND superframe, 1) OVER w AND lag(crc_ok AND superframe, 2) OVER w AND lag(crc_ok AND superframe, 3) OVER w AS okb,
          lag(ran, 1) OVER w AS r1, lag(ran, 2) OVER w AS r2, lag(ran, 3) OVER w AS r3,
          lag(fs_start, 1) OVER w AS f1, lag(fs_start, 2) OVER w AS f2, lag(fs_start, 3) OVER w AS f3,
          lag(bits, 1) OVER w AS b1, lag(bits, 2) OVER w AS b2, lag(bits, 3) OVER w AS b3
        FROM v_frames_sf WHERE NOT (crc_ok AND NOT superframe) WINDOW w AS (PARTITION BY channel_id ORDER BY seq))
       SELECT channel_id, seq, f3 AS first_sample, fs_start AS last_sample, b3 || b2 || b1 || bits AS layer3_bits, TRUE AS superframe
       FROM r WHERE crc_ok AND superframe AND okb AND part = 4 AND p1 = 3 AND p2 = 2 AND p3 = 1 AND r1 = ran AND r2 = ran AND r3 = ran
         AND abs(fs_start - f1 - 1920) <= 20 AND abs(f1 - f2 - 1920) <= 20 AND abs(f2 - f3 - 1920) <= 20
       UNION ALL SELECT channel_id, seq, fs_start, fs_start, bits, FALSE FROM v_frames_sf WHERE crc_ok AND NOT superframe""",
)
def _(v):
    return S.assemble_superframes(v.frames_sf, ["channel_id"]).select(
        "channel_id", "seq", "first_sample", "last_sample", "layer3_bits", "superframe"
    )


@query(
    "ses8_cch_ids",
    """h AS (SELECT channel_id, CAST(floor(seq / 64) AS BIGINT) AS call, arg_min(id_half, seq) FILTER (frame_number = 0) AS h0,
          arg_min(id_half, seq) FILTER (frame_number = 1) AS h1, arg_min(id_half, seq) FILTER (frame_number = 2) AS h2,
          arg_min(id_half, seq) FILTER (frame_number = 3) AS h3 FROM v_cch WHERE crc_ok GROUP BY ALL),
       i AS (SELECT channel_id, call, (h2 * 4096 + h3) % 16777216 AS s, (h0 * 4096 + h1) % 16777216 AS d FROM h)
       SELECT channel_id, call, array_to_string(list_transform(range(6, -1, -1), lambda p:
           CASE WHEN p < 6 AND (s // CAST(pow(11, p) AS BIGINT)) % 11 = 10 THEN '*' WHEN p < 6 THEN CAST((s // CAST(pow(11, p) AS BIGINT)) % 11 AS STRING)
           ELSE CAST(s // 1771561 AS STRING) END), '') AS src,
         array_to_string(list_transform(range(6, -1, -1), lambda p:
           CASE WHEN p < 6 AND (d // CAST(pow(11, p) AS BIGINT)) % 11 = 10 THEN '*' WHEN p < 6 THEN CAST((d // CAST(pow(11, p) AS BIGINT)) % 11 AS STRING)
           ELSE CAST(d // 1771561 AS STRING) END), '') AS dst
       FROM i WHERE s IS NOT NULL AND d IS NOT NULL""",
)
def _(v):
    df = v.cch.withColumn("call", F.floor(F.col("seq") / 64))
    return S.cch_ids(df, ["channel_id", "call"]).where("src IS NOT NULL AND dst IS NOT NULL")


@query(
    "ses9_stable_color",
    """f AS (SELECT *, CAST(floor(seq / 50) AS BIGINT) AS grp FROM v_cch),
       c AS (SELECT channel_id, grp, color_code, count(*) AS n, min(seq) AS first, bool_or(confidence IN ('high', 'medium')) AS good
         FROM f WHERE color_code >= 0 GROUP BY ALL),
       b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, grp ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1 AND n >= 2)
       SELECT f.channel_id, f.seq, b.color_code AS stable_color_code, b.n AS stable_color_repeats
       FROM f LEFT JOIN b USING (channel_id, grp)
       WHERE b.n IS NULL OR (f.color_code = b.color_code AND (NOT b.good OR f.confidence IN ('high', 'medium')))""",
)
def _(v):
    df = v.cch.withColumn("grp", F.floor(F.col("seq") / 50))
    return S.stable_color(df, ["channel_id", "grp"]).select(
        "channel_id", "seq", "stable_color_code", "stable_color_repeats"
    )


_NAC_SQL = """f AS (SELECT *, CAST(floor(seq / 200) AS BIGINT) AS grp, CASE WHEN floor(seq / 200) % 2 = 0 THEN valid_bch ELSE FALSE END AS ok FROM v_pdus_p25),
   g AS (SELECT channel_id, grp, nac, count(*) AS n FROM f GROUP BY ALL),
   t AS (SELECT channel_id, grp, count(*) AS total, bool_or(ok) AS any_ok FROM f GROUP BY ALL),
   m AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY channel_id, grp ORDER BY n DESC, nac) AS rn FROM g) WHERE rn = 1)
   SELECT f.channel_id, f.seq FROM f JOIN t USING (channel_id, grp) JOIN m USING (channel_id, grp)
   WHERE CASE WHEN any_ok THEN ok ELSE f.nac = m.nac AND n >= 5 AND n >= floor(0.4e0 * total) END"""


@query("ses10_stable_nac", _NAC_SQL)
def _(v):
    df = v.pdus_p25.withColumn("grp", F.floor(F.col("seq") / 200))
    df = df.withColumn("valid_bch", F.when(F.col("grp") % 2 == 0, F.col("valid_bch")).otherwise(F.lit(False)))
    return S.stable_nac(df, ["channel_id", "grp"]).select("channel_id", "seq")


@query(
    "ses11_carry_context",
    """SELECT channel_id, seq, last_value(CASE WHEN k % 9 = 0 THEN mni END IGNORE NULLS) OVER w AS mni,
         last_value(CASE WHEN k % 9 = 0 THEN start_bit END IGNORE NULLS) OVER w AS context_bit,
         last_value(CASE WHEN k % 9 = 0 THEN start_bit END IGNORE NULLS) OVER w IS NOT NULL AS context_valid
       FROM v_pdus_tetra WINDOW w AS (PARTITION BY channel_id ORDER BY start_bit, seq)""",
)
def _(v):
    df = v.pdus_tetra.select("channel_id", "seq", "k", F.col("start_bit").alias("slot_start_bit"), "mni")
    out = S.carry_context(df, ["channel_id"], F.col("k") % 9 == 0, ["mni", "slot_start_bit"])
    return out.select(
        "channel_id", "seq", F.col("context.mni").alias("mni"), F.col("context.slot_start_bit").alias("context_bit"),
        "context_valid",
    )


@query(
    "ses12_infer_timing",
    """b AS (SELECT channel_id, seq, start_bit, k % 11 = 0 AS ok, frame_number AS fn, slot_number AS tn FROM v_pdus_tetra),
       d AS (SELECT b.*, r.seq AS rseq, r.fn AS rfn, r.tn AS rtn, CAST(round((b.start_bit - r.start_bit) / 510) AS BIGINT) AS d
         FROM b JOIN b AS r ON r.channel_id = b.channel_id AND r.ok WHERE NOT b.ok),
       n AS (SELECT *, row_number() OVER (PARTITION BY channel_id, seq ORDER BY abs(d), rseq) AS rn FROM d),
       p AS (SELECT *, (((rfn - 1) * 4 + rtn - 1 + d) % 72 + 72) % 72 AS i FROM n WHERE rn = 1)
       SELECT channel_id, seq, CAST(floor(i / 4) AS BIGINT) + 1 AS frame_number, i % 4 + 1 AS slot_number, d AS timing_slot_delta FROM p
       UNION ALL SELECT channel_id, seq, fn, tn, NULL FROM b WHERE ok""",
)
def _(v):
    df = v.pdus_tetra.select(
        "channel_id", "seq", F.col("start_bit").alias("slot_start_bit"), (F.col("k") % 11 == 0).alias("sch_s_ok"),
        "frame_number", "slot_number",
    )
    return S.infer_timing(df, ["channel_id"]).select(
        "channel_id", "seq", "frame_number", "slot_number", "timing_slot_delta"
    )


@query(
    "ses13_late_entry",
    """r AS (SELECT *, lag(l, 1) OVER w AS l1, lag(l, 2) OVER w AS l2, lag(l, 3) OVER w AS l3, lag(seq, 3) OVER w AS first_seq,
          lag(bits, 3) OVER w || lag(bits, 2) OVER w || lag(bits, 1) OVER w || bits AS embedded_bits
        FROM (SELECT *, CASE part WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS l FROM v_frames_sf)
        WINDOW w AS (PARTITION BY channel_id ORDER BY seq))
       SELECT channel_id, seq, first_seq, embedded_bits FROM r WHERE l = 2 AND l1 = 3 AND l2 = 3 AND l3 = 1""",
)
def _(v):
    lcss = F.when(F.col("part") == 1, 1).when(F.col("part") == 4, 2).otherwise(3)
    df = v.frames_sf.select("channel_id", "seq", lcss.alias("lcss"), "bits")
    return S.assemble_late_entry(df, ["channel_id"], width=512)
