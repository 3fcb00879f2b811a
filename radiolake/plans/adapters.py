"""Views that express radio-signalling inputs on the star-schema test tables.

Each definition is one SELECT that Spark and DuckDB read alike, so the same input rows
feed a Spark job and its SQL check.  ``{events}`` and friends name the table; ``{us}`` is
the engine's spelling of "microseconds since 1970" for the column ``ts``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_E = f"(SELECT event_id, ts, user_id, event_type, value, {_K} AS k FROM {{events}}) AS e"

VIEWS: dict[str, str] = {
    # DMR signalling rows
    "v_pdus": f"""
        SELECT event_id AS seq, user_id % 8 AS channel_id,
          CASE WHEN k % 29 = 0 THEN NULL ELSE 'DMR' END AS protocol,
          CASE event_type WHEN 'signup' THEN 'LC_HEADER' WHEN 'view' THEN 'LATE_ENTRY'
            WHEN 'click' THEN 'CSBK' WHEN 'purchase' THEN 'TERMINATOR' ELSE 'IDLE' END AS type,
          k % 4 AS src_num, CAST(floor(k / 4) AS BIGINT) % 3 AS dst_num,
          CASE k % 3 WHEN 0 THEN 'GroupVoiceChannelUser' WHEN 1 THEN 'UnitToUnitVoiceChannelUser'
            ELSE '' END AS flco,
          CASE WHEN k % 5 = 0 THEN '' ELSE 'StandardizedFID' END AS fid,
          k % 16 AS color_code, event_id * 480 AS fs_start,
          CASE WHEN k % 7 = 0 THEN NULL ELSE k * 700e0 END AS fo_hz, k, value
        FROM {_E}""",
    # P25 frames
    "v_pdus_p25": f"""
        SELECT event_id AS seq, user_id % 8 AS channel_id, 'P25' AS protocol,
          CASE event_type WHEN 'signup' THEN 'HDU' WHEN 'view' THEN 'LDU1' WHEN 'click' THEN 'LDU2'
            WHEN 'purchase' THEN 'TDU' ELSE 'TSBK' END AS duid_name,
          CASE event_type WHEN 'signup' THEN 'P25_HDU' WHEN 'view' THEN 'P25_LDU1'
            WHEN 'click' THEN 'P25_LDU2' WHEN 'purchase' THEN 'P25_NID' ELSE 'P25_NID' END AS type,
          k % 5 AS nac, k % 7 <> 0 AS valid_bch, event_id * 1728 AS fs_start,
          CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN k % 4 END AS lc_src,
          CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN k % 6 END AS lc_dst,
          CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN k % 2 = 0 END AS lc_is_group, k
        FROM {_E}""",
    # NXDN layer-3 messages
    "v_pdus_nxdn": f"""
        SELECT event_id AS seq, user_id % 8 AS channel_id, 'NXDN' AS protocol,
          CASE event_type WHEN 'signup' THEN 'NXDN_VCALL' WHEN 'view' THEN 'NXDN_PROP_ALIAS'
            WHEN 'purchase' THEN 'NXDN_TX_REL' ELSE 'NXDN_IDLE' END AS type,
          k % 4 AS src_num, k % 3 AS dst_num, k % 6 AS ran,
          CASE k % 3 WHEN 0 THEN 'conference_group' WHEN 1 THEN 'individual' ELSE 'broadcast' END AS call_type,
          k % 4 AS alias_segment, 1 + k % 3 AS alias_total, 65 + k % 26 AS alias_byte,
          event_id * 1920 AS fs_start, md5(CAST(k % 9 AS STRING)) AS payload_hex, k
        FROM {_E}""",
    # TETRA direct-mode events
    "v_pdus_tetra": f"""
        SELECT event_id AS seq, user_id % 8 AS channel_id, 'TETRA' AS protocol,
          CASE event_type WHEN 'signup' THEN 'TETRA_DMAC_SYNC' WHEN 'view' THEN 'TETRA_TCH_CANDIDATE'
            WHEN 'click' THEN 'TETRA_STCH' WHEN 'purchase' THEN 'TETRA_SCHF'
            ELSE 'TETRA_DMAC_SYNC' END AS type,
          CASE event_type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'DM-SETUP' ELSE 'DM-OCCUPIED' END
            WHEN 'view' THEN 'TCH' WHEN 'click' THEN 'STCH'
            WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'DM-RELEASE' ELSE 'DM-TX CEASED' END
            ELSE 'DMAC-SYNC' END AS flco,
          CAST(floor(k / 50) AS BIGINT) AS src_num, k % 2 AS dst_num,
          CASE WHEN k % 31 = 0 THEN NULL ELSE {{us}} / 1000000e0 END AS start_time_s,
          CASE WHEN k % 37 = 0 THEN NULL ELSE {{us}} / 1000000e0 + 0.014e0 END AS end_time_s,
          1 + k % 18 AS frame_number, 1 + k % 4 AS slot_number,
          CASE WHEN k % 5 = 0 THEN NULL ELSE event_id * 510 + 1 END AS slot_start_bit,
          event_id * 510 + 510 AS slot_end_bit, event_id * 510 + 2 AS start_bit,
          CASE WHEN k % 3 = 0 THEN 'BKN1' ELSE 'BKN2' END AS block_name,
          CASE WHEN k % 4 = 0 THEN 'STCH' ELSE 'TCH' END AS logical_channel,
          CASE WHEN k % 6 = 0 THEN 'speech' ELSE '' END AS service, 900 + k % 3 AS mni, k
        FROM {_E}""",
    # control-channel fragments
    "v_frames_sf": f"""
        SELECT event_id AS seq, CAST(floor(event_id / 4096) AS BIGINT) AS channel_id,
          1 + (event_id + CAST(k % 5 = 0 AS BIGINT)) % 4 AS part, k % 11 <> 0 AS crc_ok,
          k % 13 <> 0 AS superframe, CAST(k % 17 = 0 AS BIGINT) AS ran,
          'outbound' AS direction, 'RTCH' AS rf_channel_type,
          event_id * 1920 + k % 12 + CAST(k % 19 = 0 AS BIGINT) * 30 AS fs_start,
          md5(CAST(event_id AS STRING)) AS bits, k
        FROM {_E}""",
    # dPMR frames with one CCH record each
    "v_cch": f"""
        SELECT event_id AS seq, user_id % 8 AS channel_id, 'dPMR' AS protocol,
          CASE WHEN event_type = 'signup' THEN 'DPMR_HEADER' ELSE 'DPMR_VOICE' END AS type,
          k % 4 AS frame_number, event_id % 4096 AS id_half, k % 3 <> 0 AS crc_ok,
          k % 5 <> 0 AS hamming_ok, CASE WHEN k % 10 = 9 THEN -1 ELSE CAST(floor(k / 20) AS BIGINT) END AS color_code,
          CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS confidence,
          k % 2 AS communication_mode, k % 3 AS version, k % 4 AS comms_format, k % 2 AS emergency_priority,
          CASE WHEN k % 2 = 0 THEN 'FS1' ELSE 'FS2' END AS sync_type,
          CASE WHEN k % 6 = 0 THEN CAST(100 + k % 3 AS STRING) ELSE '' END AS src,
          CASE WHEN k % 6 = 0 THEN CAST(200 + k % 2 AS STRING) ELSE '' END AS dst,
          event_id * 1920 AS fs_start, value, k
        FROM {_E}""",
    # IQ chunk metadata with a power reading; a few chunks lost samples
    "v_chunks": f"""
        SELECT event_id AS seq, CAST(floor(event_id / 4096) AS BIGINT) AS channel_id,
          event_id AS sequence_number,
          event_id * 4800 + CASE WHEN k % 23 = 1 THEN 100 ELSE 0 END AS start_sample,
          event_id * 4800 + 4800 AS end_sample, 48000e0 AS sample_rate_hz,
          10 * log10(value + 1e-12) AS power_db, k = 50 AS discontinuity,
          CASE WHEN k = 0 THEN 4800 ELSE 0 END AS dropped_samples, value, k
        FROM {_E}""",
    # one 64-bin spectrum per vector
    "v_psd": """
        SELECT vec_id AS capture_id, label, pos AS bin, (pos - 32) * 100e0 AS freq_hz,
          CAST(e AS DOUBLE) * CAST(e AS DOUBLE) AS power
        FROM {psd_bins}""",
    "v_detections": f"""
        SELECT event_id AS seq, CAST(floor(event_id / 16) AS BIGINT) AS batch,
          value * 100 AS frequency_offset_hz, 400000000e0 + value * 100 AS center_frequency_hz,
          CAST(floor(value / 10) AS BIGINT) AS coarse_bin, floor(value / 10) * 1000 AS coarse_center_offset_hz,
          CAST(k AS DOUBLE) AS snr_db, k - 90e0 AS power_db, -90e0 AS noise_floor_db, k
        FROM {_E}""",
    "v_frame_quality": """
        SELECT l_suppkey % 8 AS channel_id, l_orderkey, l_linenumber, l_returnflag <> 'R' AS frame_valid,
          l_linestatus = 'F' AS block_ok, l_partkey % 128 AS lich, l_discount AS sync_score
        FROM {lineitem}""",
    "v_probe": """
        SELECT o_orderkey AS seq, o_custkey AS epoch_id, 1 + o_orderkey % 2 AS generation,
          CASE o_orderkey % 5 WHEN 0 THEN 'DMR' WHEN 1 THEN 'P25' WHEN 2 THEN 'dPMR'
            WHEN 3 THEN 'NXDN' ELSE 'TETRA' END AS protocol,
          CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'confirmed'
            WHEN o_orderstatus = 'O' THEN 'rejected'
            WHEN o_totalprice < 40000 THEN 'error' ELSE 'candidate' END AS status,
          CASE WHEN o_totalprice > 400000 THEN 0.99e0 ELSE 0.9e0 END AS confidence,
          CAST(floor(o_totalprice / 1000) AS BIGINT) AS window_samples, o_orderkey * 100 AS window_end_sample,
          o_totalprice / 1000000e0 AS elapsed_sec
        FROM {orders}""",
    "v_payload": f"""
        SELECT event_id AS seq, user_id % 8 AS channel_id, upper(md5(CAST(event_id AS STRING))) AS hex,
          upper(md5(CAST(event_id * 7 + 1 AS STRING))) AS hex2, k
        FROM {_E}""",
    "v_metrics": """
        SELECT l_suppkey % 8 AS channel_id, l_orderkey * 8 + l_linenumber AS seq, l_tax AS compute_sec,
          l_discount AS dispatch_sec, l_quantity AS queue_sec, l_extendedprice AS wall_sec,
          l_orderkey AS feed_index
        FROM {lineitem}""",
}


def _names(text: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", text)]


def oracle(body: str) -> str:
    """DuckDB text of ``body`` with the views it mentions defined in front."""
    tables = {t: t for t in TABLES} | {
        "us": "epoch_us(ts)",
        "psd_bins": "(SELECT vec_id, label, unnest(embedding) AS e, "
        "unnest(range(len(embedding))) AS pos FROM embeddings)",
    }
    views = ", ".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in _names(body))
    body = body.strip()
    if not views:
        return body if body.upper().startswith(("SELECT", "WITH")) else f"WITH {body}"
    joiner = " " if body.upper().startswith("SELECT") else ", "
    return f"WITH {views}{joiner}{body}"


class Views:
    """The adapter views and tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name == "v_psd":
            return self.table("embeddings").select(
                F.col("vec_id").alias("capture_id"), "label", F.posexplode("embedding").alias("bin", "e")
            ).select(
                "capture_id",
                "label",
                F.col("bin").cast("bigint").alias("bin"),
                ((F.col("bin") - 32) * 100.0).alias("freq_hz"),
                (F.col("e").cast("double") * F.col("e").cast("double")).alias("power"),
            )
        tables = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES} | {
            "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
            "psd_bins": "",
        }
        df = self.spark.sql(VIEWS[name].format(**tables))
        return spread(df, *df.columns) if name == "v_payload" else df  # texts to work through

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in VIEWS:
            return self.view(f"v_{name}")
        raise AttributeError(name)
