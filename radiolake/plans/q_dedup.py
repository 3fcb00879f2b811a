"""Duplicate removal and neighbour merging."""

from pyspark.sql import functions as F

from radiolake.functions import keys as K
from radiolake.operators import dedup as D
from radiolake.operators.conform import append_pdus, conform_pdus
from radiolake.plans.catalog import query


def _first(view: str, key: str, out: str = "seq", order: str = "seq", more: str = "") -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {view} {more})
        SELECT {out} FROM n WHERE rn = 1"""


_DMR_KEY = """channel_id, coalesce(protocol, 'DMR'), src_num, dst_num, type,
  CAST(round(coalesce(fo_hz, 0) / 5000) AS BIGINT) * 5000"""


def dmr(v):
    return conform_pdus(v.pdus.drop("value")).select(
        "channel_id", "seq", "protocol", "type", "src_num", "dst_num", "flco", "fid", "fo_hz",
        F.struct("fs_start", "color_code").alias("extra"),
    )


def p25(v):
    k = F.col("k")
    return v.pdus_p25.select(
        "channel_id", "seq", "protocol", "type",
        F.coalesce("lc_src", F.lit(0)).alias("src_num"), F.coalesce("lc_dst", F.lit(0)).alias("dst_num"),
        F.lit("").alias("flco"),
        F.struct(
            "nac", "fs_start",
            F.when(k % 2 == 0, k % 3).alias("mi"),
            F.when((k % 2 == 0) & F.col("lc_src").isNotNull(), k % 4).alias("lco"),
            (k % 7).alias("tgid"),
            F.when(k % 3 == 0, k % 5).alias("es_mi"),
        ).alias("extra"),
    )


_P25_KEY = """channel_id, nac, CASE
    WHEN type = 'P25_HDU' AND k % 2 = 0 THEN printf('HDU %d %d', k % 3, coalesce(lc_dst, 0))
    WHEN type = 'P25_LDU1' AND k % 2 = 0 AND lc_src IS NOT NULL THEN printf('LDU1 %d %d %d', lc_src,
      CASE WHEN lc_dst = 0 THEN k % 7 ELSE lc_dst END, k % 4)
    WHEN type = 'P25_LDU2' AND k % 3 = 0 THEN printf('LDU2 %d', k % 5)
    ELSE printf('%s %d', type, CAST(round(fs_start / 8640) AS BIGINT)) END"""


def dpmr(v):
    cch = F.struct(*K.CCH_FIELDS)
    return v.cch.select(
        "channel_id", "seq", "protocol", "type", "src", "dst",
        F.struct(
            "color_code", "sync_type", "fs_start", F.when(F.col("k") % 4 != 0, F.array(cch)).alias("cch")
        ).alias("extra"),
    )


_DPMR_KEY = """channel_id, type, color_code, sync_type, CASE
    WHEN src <> '' OR dst <> '' THEN 'A ' || src || ' ' || dst
    WHEN k % 4 <> 0 THEN printf('C %d %d %d %d %d', frame_number, id_half, communication_mode, comms_format, emergency_priority)
    ELSE printf('F %d', CAST(round(fs_start / 3840) AS BIGINT)) END"""


def nxdn(v):
    typ = F.when(F.col("k") % 10 == 3, "NXDN_CALL").otherwise(F.col("type"))
    return v.pdus_nxdn.select(
        "channel_id", "seq", "protocol", typ.alias("type"), "src_num", "dst_num", F.upper("call_type").alias("flco"),
        F.struct("ran", "payload_hex", "fs_start", (F.col("k") % 4 * 100).alias("start_sample")).alias("extra"),
    )


_NXDN_KEY = """channel_id, ran, src_num, dst_num, CASE WHEN k % 10 = 3 THEN printf('CALL %s %d', call_type, k % 4)
    ELSE type || ' ' || payload_hex END"""


def tetra(v):
    return v.pdus_tetra.select(
        "channel_id", "seq", "protocol",
        F.when(F.col("k") % 10 == 3, "TETRA_SESSION").otherwise(F.col("type")).alias("type"),
        "src_num", "dst_num", "flco",
        F.struct(
            F.when(F.col("slot_start_bit").isNotNull(), F.floor(F.col("slot_start_bit") / 51000)).alias("slot_start_bit"),
            F.floor(F.col("start_bit") / 25500).alias("start_bit"),
            "frame_number", "slot_number", "block_name", "logical_channel", "start_time_s", "end_time_s",
        ).alias("extra"),
    )


_TETRA_KEY = """channel_id, src_num, dst_num, CASE WHEN k % 10 = 3 THEN printf('S %d', CAST(floor(start_bit / 25500) AS BIGINT))
    ELSE printf('E %s %d %d %s %s %d', type, frame_number, slot_number, block_name, flco,
      coalesce(CAST(floor(slot_start_bit / 51000) AS BIGINT), CAST(floor(start_bit / 25500) AS BIGINT))) END"""


@query("ded2_dmr_first_wins", _first("v_pdus", _DMR_KEY))
def _(v):
    return D.deduplicate_pdus(dmr(v), ["channel_id"]).select("seq")


@query("ded3_p25_first_wins", _first("v_pdus_p25", _P25_KEY))
def _(v):
    return D.deduplicate_pdus(p25(v), ["channel_id"]).select("seq")


@query("ded4_dpmr_first_wins", _first("v_cch", _DPMR_KEY))
def _(v):
    return D.deduplicate_pdus(dpmr(v), ["channel_id"]).select("seq")


@query("ded5_nxdn_first_wins", _first("v_pdus_nxdn", _NXDN_KEY))
def _(v):
    return D.deduplicate_pdus(nxdn(v), ["channel_id"]).select("seq")


@query("ded6_tetra_first_wins", _first("v_pdus_tetra", _TETRA_KEY))
def _(v):
    return D.deduplicate_pdus(tetra(v), ["channel_id"]).select("seq")


def _branch(view: str, key: str, name: str) -> str:
    return f"""SELECT '{name}' AS protocol, seq FROM (SELECT seq, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn
        FROM {view}) WHERE rn = 1"""


@query(
    "ded1_all_protocols",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        _branch(*x)
        for x in (
            ("v_pdus", _DMR_KEY, "DMR"), ("v_pdus_p25", _P25_KEY, "P25"), ("v_cch", _DPMR_KEY, "dPMR"),
            ("v_pdus_nxdn", _NXDN_KEY, "NXDN"), ("v_pdus_tetra", _TETRA_KEY, "TETRA"),
        )
    )
    + ")",
)
def _(v):
    """One lake of all protocols; the same rule picks each row's own key."""
    lake = None
    for part in (dmr(v), p25(v), dpmr(v), nxdn(v), tetra(v)):
        lake = part if lake is None else append_pdus(lake, part)
    lake = lake.withColumn("capture_id", F.col("protocol"))
    return D.deduplicate_pdus(lake, ["capture_id", "channel_id"]).select("protocol", "seq")


@query(
    "ded7_scan_windows",
    _first(
        "v_pdus_tetra",
        """channel_id, type, src_num, dst_num, flco, logical_channel, block_name,
           CAST(round(coalesce(start_time_s, end_time_s, 0) / 100 / 0.005) AS BIGINT)""",
        order="coalesce(start_time_s, end_time_s, seq), seq",
    ),
)
def _(v):
    shrunk = {n: F.col(n) / 100 for n in ("start_time_s", "end_time_s")}
    df = v.pdus_tetra.withColumn("_t", F.coalesce("start_time_s", "end_time_s", "seq")).withColumns(shrunk)
    df = df.select(
        "channel_id", "seq", "type", "src_num", "dst_num", "flco", "_t",
        F.struct("logical_channel", "block_name", "start_time_s", "end_time_s").alias("extra"),
    )
    return D.first_by_key(df, K.scan_key(df), ["channel_id"], ["_t", "seq"]).select("seq")


def _live(v):
    df = conform_pdus(v.pdus.drop("value")).select(
        "channel_id", "seq", "protocol", "src_num", "dst_num", "fo_hz", "k",
        F.when(F.col("k") % 5 == 0, "DMR_CALL").otherwise(F.col("type")).alias("type"),
        F.lit(48000.0).alias("sample_rate_hz"),
        F.struct(F.struct((F.floor(F.col("fs_start") / 48000) * 100).alias("source_sample")).alias("stream")).alias("extra"),
    )
    return df


_LIVE_KEY = """channel_id, coalesce(protocol, 'DMR'), src_num, dst_num, CASE WHEN k % 5 = 0 THEN 'DMR_CALL' ELSE type END,
  CAST(round(coalesce(fo_hz, 0) / 5000) AS BIGINT), CASE WHEN k % 5 <> 0 THEN
  CAST(round(floor(fs_start / 48000) * 100 / 240) AS BIGINT) END"""


@query("ded8_stream_key", _first("v_pdus", _LIVE_KEY))
def _(v):
    df = _live(v)
    return D.first_by_key(df, K.stream_key(df), ["channel_id"], ["seq"]).select("seq")


@query("ded9_unseen_ledger")
def _(v):
    """Rows new to a ledger seeded from the first tenth; passes retain the last 5 ms bucket."""
    df = _live(v).withColumn("retained_start", F.col("extra.stream.source_sample") - 400)
    seeded = df.where(F.col("k") < 10)
    seed = seeded.select(
        "channel_id",
        F.to_json(K.stream_key(seeded)).alias("ledger_key"),
        F.when(~K.is_persistent(seeded), F.col("extra.stream.source_sample")).alias("seen_sample"),
    )
    ledger = seed.groupBy("channel_id", "ledger_key").agg(F.min("seen_sample").alias("seen_sample"))
    return D.unseen(df.where(F.col("k") >= 10), ledger, ["channel_id"]).select("channel_id", "seq")


@query("ded10_burst_candidates", _first("v_pdus", "channel_id, CAST(round(seq * 3 / 50) AS BIGINT), flco"))
def _(v):
    df = v.pdus.select("channel_id", "seq", F.col("flco").alias("sync_type"), (F.col("seq") * 3).alias("center_sample"))
    return D.burst_candidates(df, ["channel_id"]).select("seq")


@query("ded11_frame_payloads", _first("v_pdus_nxdn", "channel_id, CAST(floor(seq / 20) AS BIGINT), payload_hex"))
def _(v):
    df = v.pdus_nxdn.select(
        "channel_id", F.floor(F.col("seq") / 20).alias("frame_index"), F.col("seq").alias("half_index"), "payload_hex"
    )
    return D.frame_payloads(df, ["channel_id", "frame_index"]).select(F.col("half_index").alias("seq"))


@query("ded12_chain_merge")
def _(v):
    df = v.payload.select(
        "channel_id", "seq", (F.col("seq") * 10 + F.col("k")).alias("fs_start"), (F.col("k") % 4).alias("errors"),
        (F.col("k") % 7 / 10).alias("resid"), (F.col("k") % 9 / 10).alias("ncc"),
    )
    return D.chain_merge(df, ["channel_id"], 60).select("channel_id", "seq")


@query(
    "ded13_detection_merge",
    """g AS (SELECT *, CASE WHEN frequency_offset_hz - lag(frequency_offset_hz) OVER w <= 2500 THEN 0 ELSE 1 END AS s
         FROM v_detections WINDOW w AS (PARTITION BY batch ORDER BY frequency_offset_hz, seq)),
       c AS (SELECT *, sum(s) OVER (PARTITION BY batch ORDER BY frequency_offset_hz, seq) AS cl FROM g),
       m AS (SELECT *, max(snr_db) OVER (PARTITION BY batch, cl) AS top FROM c)
       SELECT batch, count(*) AS member_count, max(snr_db) AS snr_db,
         round(sum(frequency_offset_hz * pow(10e0, (snr_db - top) / 10)) / sum(pow(10e0, (snr_db - top) / 10)), 4) AS frequency_offset_hz,
         arg_max(seq, struct_pack(a := snr_db, b := -frequency_offset_hz, c := -seq)) AS best_seq
       FROM m GROUP BY batch, cl""",
)
def _(v):
    return D.merge_detections(v.detections, ["batch"]).select(
        "batch",
        "member_count",
        "snr_db",
        F.round("frequency_offset_hz", 4).alias("frequency_offset_hz"),
        F.col("seq").alias("best_seq"),
    )


@query(
    "ded14_best_per_slot",
    _first("v_pdus", "channel_id, CAST(floor(seq / 12) AS BIGINT)", order="k % 10 / 10e0, k, seq", more="WHERE k % 3 <> 0"),
)
def _(v):
    k = F.col("k")
    df = v.pdus.select(
        "channel_id", "seq", F.floor(F.col("seq") / 12).alias("slot_start_bit"), (k % 3 != 0).alias("is_confirmed"),
        (k % 10 / 10.0).alias("error_fraction"), k.alias("total_errors"),
    )
    return D.best_per_slot(df, ["channel_id"]).select("seq")


@query(
    "ded15_epoch_ledger",
    _first("v_chunks", "channel_id, CAST(floor(seq / 7) AS BIGINT)", out="channel_id, CAST(floor(seq / 7) AS BIGINT) AS epoch_id, seq"),
)
def _(v):
    df = v.chunks.select("channel_id", F.floor(F.col("seq") / 7).alias("epoch_id"), "seq")
    return D.first_epochs(df).select("channel_id", "epoch_id", "seq")
