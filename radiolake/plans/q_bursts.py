"""Slot and burst tables."""

from pyspark.sql import functions as F

from radiolake.functions import bits as B
from radiolake.functions.ordered import settle
from radiolake.operators import bursts as U
from radiolake.operators import spectrum as S
from radiolake.plans.catalog import query
from radiolake.plans.q_conform import _bits
from radiolake.plans.q_spectrum import _TRAIN

R6 = lambda c: F.round(c, 6)


def _hits(v):
    """Training hits of each 256-bit text, placed 384 bits into that text written four times."""
    rows = v.payload.select("seq", B.hex_to_bits(F.concat("hex", "hex2")).alias("bits"))
    hits = S.training_candidates(rows, ["seq"], keep_bits=True, dealt=True)  # the view is spread by all its columns
    return hits.select("seq", "name", "length", "bits", F.explode("candidates").alias("c")).select(
        "seq", "name", "length", (F.col("c.p") + 384).cast("bigint").alias("bit_offset"), F.col("c.s").cast("bigint").alias("errors"),
        (F.col("c.s") / F.col("length")).alias("error_fraction"), (F.col("c.s") / F.col("length") <= 0.18).alias("is_good"),
        F.repeat("bits", 4).alias("bits"),
    )


_SLOTS = (
    _TRAIN
    + """, hi AS (SELECT c.seq, c.name, c.len, c.o + 384 AS bit_offset, c.errors, c.errors / c.len AS error_fraction, c.errors / c.len <= 0.18e0 AS is_good,
      repeat(b.b, 4) AS bits FROM c JOIN b ON b.seq = c.seq),
    sl AS (SELECT *, bit_offset - ((510 - len) // 2 + 1) + 1 AS slot_start_bit FROM hi),
    sc AS (SELECT *, slot_start_bit >= 1 AND slot_start_bit + 509 <= 1024 AS is_complete FROM sl)"""
)


@query(
    "bst1_slot_candidates",
    _SLOTS
    + """ SELECT seq, name, bit_offset, slot_start_bit, is_complete, slot_start_bit % 2 IN (1, -1) AS symbol_aligned,
      CASE WHEN name LIKE 'normal%' THEN 'DNB' WHEN name = 'sync' THEN 'DSB' ELSE 'extended' END AS burst_class,
      CASE WHEN is_complete THEN md5(substr(bits, slot_start_bit, 510)) ELSE md5('') END AS bits_md5 FROM sc""",
)
def _(v):
    return U.slot_candidates(_hits(v)).select(
        "seq", "name", "bit_offset", "slot_start_bit", "is_complete", "symbol_aligned", "burst_class", F.md5("bit_string").alias("bits_md5")
    )


@query(
    "bst2_limit_slots",
    _SLOTS
    + """, r1 AS (SELECT *, row_number() OVER (PARTITION BY seq // 16, name ORDER BY is_complete DESC, is_good DESC, error_fraction, errors, slot_start_bit, bit_offset, name, seq) AS n1 FROM sc),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY seq // 16 ORDER BY is_complete DESC, is_good DESC, error_fraction, errors, slot_start_bit, bit_offset, name, seq) AS n2 FROM r1 WHERE n1 <= 12)
    SELECT seq // 16 AS capture, name, slot_start_bit, errors FROM r2 WHERE n2 <= 40""",
)
def _(v):
    slots = U.slot_candidates(_hits(v)).select(
        F.floor(F.col("seq") / 16).alias("capture"), "name", "slot_start_bit", "bit_offset", "errors", "error_fraction", "is_good", "is_complete"
    )
    return U.limit_slots(slots, ["capture"], 40, 12).select("capture", "name", "slot_start_bit", "errors")


def _slot_bits(v):
    """510-bit slots: hash bits with the fields of one burst written in, some bits flipped."""
    raw = v.payload.select("seq", "channel_id", "k", F.repeat(B.hex_to_bits(F.concat("hex", "hex2")), 2).alias("r"))
    k = F.col("k")

    def text(d):
        _, _, training, preamble, t0, has_freq, _, _ = d
        word = S.TRAINING[training]
        out = F.substring("r", 1, 34)
        out = F.concat(out, F.lit(preamble), F.substring("r", 47, 2))
        at = 49
        if has_freq:
            out, at = F.concat(out, F.lit(U.FREQUENCY_BITS)), 49 + 80
        out = F.concat(out, F.substring("r", at, t0 - at), F.lit(word))
        at = t0 + len(word)
        return F.concat(out, F.substring("r", at, 503 - at), F.lit(U.TAIL_BITS), F.substring("r", 505, 6))

    built = F.when(k % 4 == 0, text(U.BURSTS[0])).when(k % 4 == 1, text(U.BURSTS[1])).when(k % 4 == 2, text(U.BURSTS[2])).otherwise(
        F.substring("r", 1, 510)
    )
    # overwrite k % 7 bits inside the training sequence
    n = (k % 7).cast("int")
    out = F.concat(F.substring("b", 1, 268), F.substring(F.lit("0000000"), F.lit(1), n), F.expr("substring(b, 269 + CAST(k % 7 AS INT), 510)"))
    # slots are a stored table; a filter on them must not rebuild the texts
    return settle(
        raw.withColumn("b", built).select(
            "seq", "channel_id", "k", out.alias("bit_string"), (F.col("seq") * 510 + 1).alias("slot_start_bit")
        )
    )


def _sql_text(d) -> str:
    _, _, training, preamble, t0, has_freq, _, _ = d
    word = S.TRAINING[training]
    at = 129 if has_freq else 49
    freq = f"'{U.FREQUENCY_BITS}' || " if has_freq else ""
    end = t0 + len(word)
    return (
        f"substr(r, 1, 34) || '{preamble}' || substr(r, 47, 2) || {freq}substr(r, {at}, {t0 - at}) || '{word}' || "
        f"substr(r, {end}, {503 - end}) || '00' || substr(r, 505, 6)"
    )


def _ham(start: int, pattern: str) -> str:
    return f"hamming(substr(b, {start}, {len(pattern)}), '{pattern}')"


def _def_sql(k: int, d) -> str:
    name, kind, training, preamble, t0, has_freq, _, _ = d
    word = S.TRAINING[training]
    freq = _ham(49, U.FREQUENCY_BITS) if has_freq else "0"
    checked = 12 + len(word) + 2 + (80 if has_freq else 0)
    return f"""SELECT seq, channel_id, k, b, slot_start_bit, {k} AS d, '{name}' AS burst_name, '{kind}' AS burst_type, {_ham(35, preamble)} AS pre, {_ham(t0, word)} AS trn,
        {_ham(503, "00")} AS tail, {freq} AS freq, {checked} AS checked, {int(len(word) * 0.18 + 1e-9)} AS mt, {int(checked * 0.18 + 1e-9)} AS mx FROM sb"""


_BURST = (
    f"""ra AS (SELECT seq, channel_id, k, repeat({_bits('(hex || hex2)')}, 2) AS r FROM v_payload),
  bu AS (SELECT seq, channel_id, k, CASE k % 4 WHEN 0 THEN {_sql_text(U.BURSTS[0])} WHEN 1 THEN {_sql_text(U.BURSTS[1])}
    WHEN 2 THEN {_sql_text(U.BURSTS[2])} ELSE substr(r, 1, 510) END AS b0 FROM ra),
  sb AS (SELECT seq, channel_id, k, substr(b0, 1, 268) || substr('0000000', 1, k % 7) || substr(b0, 269 + k % 7) AS b, seq * 510 + 1 AS slot_start_bit FROM bu),
  de AS ({" UNION ALL ".join(_def_sql(k, d) for k, d in enumerate(U.BURSTS))}),
  dc AS (SELECT *, pre + trn + tail + freq AS total, trn <= mt AND pre <= 2 AND tail <= 1 AND freq <= 8 AND pre + trn + tail + freq <= mx AS is_confirmed FROM de),
  cl AS (SELECT *, total / checked AS error_fraction FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY is_confirmed DESC, total / checked, total, d) AS rn FROM dc) WHERE rn = 1)"""
)


def _classified(v):
    return U.classify_slots(_slot_bits(v))


@query(
    "bst3_classify_bursts",
    _BURST + " SELECT seq, burst_name, burst_type, is_confirmed, total AS total_errors, trn AS training_errors, round(error_fraction, 6) AS error_fraction FROM cl",
)
def _(v):
    return _classified(v).select(
        "seq", "burst_name", "burst_type", "is_confirmed", "total_errors", "training_errors", R6("error_fraction").alias("error_fraction")
    )


@query(
    "bst4_limit_bursts",
    _BURST
    + """, nc AS (SELECT channel_id, count(*) AS n FROM cl WHERE is_confirmed GROUP BY 1),
    rj AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY error_fraction, total, slot_start_bit, seq) AS r2 FROM cl WHERE NOT is_confirmed)
    SELECT seq FROM cl WHERE is_confirmed UNION ALL SELECT seq FROM rj LEFT JOIN nc USING (channel_id) WHERE r2 <= 600 - coalesce(n, 0)""",
)
def _(v):
    return U.limit_bursts(_classified(v), ["channel_id"], 600).select("seq")


_MASK = "repeat(CASE WHEN k % 3 = 0 THEN '1110' WHEN k % 3 = 1 THEN '1' ELSE '10' END, 510)"
_BLOCK = (
    _BURST
    + """, ma AS (SELECT *, substr("""
    + _MASK
    + """, 1, 510) AS m FROM cl WHERE is_confirmed),
  bl AS (SELECT seq, channel_id, k, burst_name, slot_start_bit, 1 AS block_index, CASE burst_name WHEN 'DSB_sync' THEN 129 ELSE 49 END AS s, CASE burst_name WHEN 'DSB_sync' THEN 248 ELSE 264 END AS e, b, m FROM ma
    UNION ALL SELECT seq, channel_id, k, burst_name, slot_start_bit, 2, 287, 502, b, m FROM ma),
  pb AS (SELECT *, e - s + 1 AS length, length(replace(substr(m, s, e - s + 1), '0', '')) AS valid_bits FROM bl)"""
)


def _blocks(classified):
    masks = F.when(F.col("k") % 3 == 0, "1110").when(F.col("k") % 3 == 1, "1").otherwise("10")
    df = classified.withColumn("valid_mask", F.substring(F.repeat(masks, F.lit(510)), 1, 510))
    return U.payload_blocks(df)


@query(
    "bst5_payload_blocks",
    _BLOCK
    + """ SELECT seq, block_index, slot_start_bit + s - 1 AS absolute_start_bit, slot_start_bit + e - 1 AS absolute_end_bit, CAST(length AS BIGINT) AS length,
      CAST(valid_bits AS BIGINT) AS valid_bits, round(valid_bits / length, 6) AS valid_ratio, md5(substr(b, s, e - s + 1)) AS bits_md5 FROM pb""",
)
def _(v):
    return _blocks(_classified(v)).select(
        "seq", "block_index", "absolute_start_bit", "absolute_end_bit", "length", "valid_bits", R6("valid_ratio").alias("valid_ratio"),
        F.md5("block_bits").alias("bits_md5"),
    )


def _routed(classified):
    k = F.col("k")
    keep = ["seq", "channel_id", "k", "burst_name", "burst_type", "training_name", "slot_start_bit"]
    names = ["block_index", "block_name", "absolute_start_bit", "absolute_end_bit", "valid_bits", "length"]
    both = _blocks(classified).groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("blocks"))
    return U.route_blocks(
        both.withColumns(
            {
                "context_valid": k % 5 != 0, "stch1_ok": k % 2 == 0, "second_half_stolen": k % 3 != 2, "stch2_ok": k % 7 != 0,
                "schf_ok": k % 13 < 6,
            }
        )
    )


_ROUTE = (
    _BLOCK
    + """, pr AS (SELECT a.seq, a.channel_id, a.k, a.burst_name, a.slot_start_bit, a.valid_bits AS v1, a.length AS l1, z.valid_bits AS v2, z.length AS l2 FROM pb a JOIN pb z ON z.seq = a.seq AND z.block_index = 2 WHERE a.block_index = 1),
  n2 AS (SELECT *, v1 / l1 >= 0.7e0 AND k % 5 <> 0 AS t1, v2 / l2 >= 0.7e0 AND k % 5 <> 0 AS t2, (v1 + v2) / (l1 + l2) >= 0.7e0 AND k % 5 <> 0 AS tf FROM pr),
  ro AS (
    SELECT seq, channel_id, k, slot_start_bit, 'BKN1' AS block_name, 'STCH' AS logical_channel, t1 AS attempted, t1 AND k % 2 = 0 AS decode_ok, v1 / l1 AS ratio FROM n2 WHERE burst_name = 'DNB_normal_2'
    UNION ALL SELECT seq, channel_id, k, slot_start_bit, 'BKN2', CASE WHEN st THEN 'STCH' ELSE 'TCH' END, st AND t2, st AND t2 AND k % 7 <> 0, v2 / l2
      FROM (SELECT *, t1 AND k % 2 = 0 AND k % 3 <> 2 AS st FROM n2 WHERE burst_name = 'DNB_normal_2')
    UNION ALL SELECT seq, channel_id, k, slot_start_bit, 'BKN1+BKN2', 'SCH/F', tf, tf AND k % 13 < 6, (v1 + v2) / (l1 + l2) FROM n2 WHERE burst_name = 'DNB_normal_1')"""
)


@query(
    "bst6_route_blocks",
    _ROUTE
    + """ SELECT seq, block_name, logical_channel, attempted, decode_ok, CASE WHEN logical_channel = 'TCH' THEN 'BKN2 kept as TCH candidate; first-half STCH did not steal second half'
      WHEN ratio < 0.7e0 THEN printf('skipped: low burst-valid ratio %.3f', ratio) WHEN k % 5 = 0 THEN 'skipped: no DCC context' WHEN decode_ok THEN 'decoded'
      ELSE 'channel decode failed' END AS status FROM ro""",
)
def _(v):
    return _routed(_classified(v)).select("seq", "block_name", "logical_channel", "attempted", "decode_ok", "status")


@query(
    "bst7_burst_events",
    _ROUTE
    + """, ev AS (SELECT seq, 'TETRA_DMAC_SYNC' AS type, k % 9 AS src_num, NULL AS block_name, 'SYNC' AS flco, slot_start_bit FROM cl WHERE is_confirmed AND burst_name = 'DSB_sync' AND k % 8 <> 0
      UNION ALL SELECT seq, CASE WHEN NOT decode_ok THEN 'TETRA_TCH_CANDIDATE' WHEN logical_channel = 'SCH/F' THEN 'TETRA_SCHF' ELSE 'TETRA_STCH' END,
        CASE WHEN decode_ok AND k % 3 = 0 THEN k WHEN k % 4 <> 3 THEN 500 + k ELSE 0 END, block_name,
        CASE WHEN NOT decode_ok THEN 'TCH' WHEN k % 6 = 0 THEN 'NULL' ELSE 'DM-INFO' END, slot_start_bit FROM ro WHERE decode_ok OR logical_channel IN ('SCH/F', 'TCH'))
    SELECT seq, type, src_num, block_name, flco, round(0.5e0 + (slot_start_bit - 1) / 36000, 6) AS start_time_s, round(0.5e0 + (slot_start_bit + 508) / 36000, 6) AS end_time_s FROM ev""",
)
def _(v):
    k = F.col("k")
    null = F.lit(None).cast("bigint")
    timing = {"frame_number": 1 + k % 18, "slot_number": 1 + k % 4, "active_start_sec": F.lit(0.5)}
    classified = _classified(v)  # read twice, found once
    syncs = classified.where("is_confirmed AND burst_name = 'DSB_sync'").withColumns(
        {"src": k % 9, "dst": null, "message": F.lit("SYNC"), "dmac_sync_ok": k % 8 != 0} | timing
    )
    blocks = _routed(classified).withColumns(
        {
            "src": F.when(k % 3 == 0, k), "dst": null, "context_src": F.when(k % 4 != 3, 500 + k), "context_dst": null,
            "null_pdu": k % 6 == 0, "message": F.lit("DM-INFO"),
        }
        | timing
    )
    return U.burst_events(syncs, blocks).select(
        "seq", "type", "src_num", "block_name", "flco", R6("start_time_s").alias("start_time_s"), R6("end_time_s").alias("end_time_s")
    )


@query(
    "bst8_burst_report",
    _BURST
    + """ SELECT channel_id, count(*) AS candidate_count, count(*) AS complete_count, count(*) FILTER (is_confirmed) AS confirmed_count,
      count(*) FILTER (is_confirmed AND burst_type = 'DSB') AS dsb_count, count(*) FILTER (is_confirmed AND burst_type = 'DNB') AS dnb_count,
      count(*) FILTER (k % 8 = 0) AS dmac_sync_count, sum(k % 3) AS stch_count, count(*) FILTER (k % 6 = 0) AS schf_count, count(*) FILTER (k % 5 <> 0) AS timing_count FROM cl GROUP BY channel_id""",
)
def _(v):
    k = F.col("k")
    df = _classified(v).withColumns(
        {
            "is_complete": F.lit(True), "dmac_sync_ok": k % 8 == 0, "stch_count": k % 3, "schf_ok": k % 6 == 0,
            "frame_number": F.when(k % 5 != 0, k), "slot_number": k,
        }
    )
    return U.burst_report(df, ["channel_id"])


@query(
    "bst9_event_order",
    """e AS (SELECT channel_id, seq, CASE WHEN k % 10 = 3 THEN end_time_s ELSE start_time_s END AS t FROM v_pdus_tetra)
       SELECT channel_id, seq, row_number() OVER (PARTITION BY channel_id ORDER BY coalesce(t, 1e12), seq) AS position FROM e""",
)
def _(v):
    df = v.pdus_tetra.withColumn("type", F.when(F.col("k") % 10 == 3, "TETRA_SESSION").otherwise(F.col("type")))
    return U.order_events(df, ["channel_id"], 86400.0).select("channel_id", "seq", "position")
