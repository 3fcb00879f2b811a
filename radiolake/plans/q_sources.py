"""Sources, sinks and user decoders, on files Spark derives from the test tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from radiolake.operators.decode import decode_windows
from radiolake.operators.conform import conform_pdus
from radiolake.plans.catalog import query
from radiolake.plans.q_spectrum import iq
from radiolake.session import scratch_path
from radiolake.sources import files as S
from radiolake.sources import sinks

R6 = lambda c: F.round(c, 6)


def _recordings(v) -> str:
    """int16 recordings of 50 embeddings each, written by tasks to the shared folder."""
    folder = scratch_path(v.spark, "recordings")
    v.spark.range(1).write.parquet(f"{folder}/.made")  # creates the folder on its file system

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sample")
        i, q = np.concatenate(pdf["i"].to_list()), np.concatenate(pdf["q"].to_list())
        x = np.empty(2 * len(i), "<i2")
        x[0::2], x[1::2] = np.round(np.float64(i) * 32767), np.round(np.float64(q) * 32767)
        path = f"{folder}/cap{int(pdf['capture_id'].iloc[0])}_48000.rawiq"
        system, inner = S.locate(path)
        with system.open_output_stream(inner) as f:
            f.write(x.tobytes())
        return pd.DataFrame({"n": [len(i)]})

    iq(v).groupBy("capture_id").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return f"{folder}/*.rawiq"


_ID = "cap([0-9]+)_"


@query(
    "src1_capture_catalog",
    """SELECT CAST(floor(vec_id / 50) AS BIGINT) AS capture_id, 'raw' AS format, 48000e0 AS sample_rate_hz, count(*) * 32 AS total_samples,
         round(count(*) * 32 / 48000, 6) AS duration_sec, count(*) * 128 AS file_bytes, TRUE AS is_valid FROM embeddings GROUP BY 1""",
)
def _(v):
    cat = S.capture_catalog(v.spark, _recordings(v))
    return cat.select(
        F.regexp_extract("path", _ID, 1).cast("bigint").alias("capture_id"), "format", "sample_rate_hz", "total_samples",
        R6("duration_sec").alias("duration_sec"), "file_bytes", "is_valid",
    )


@query(
    "src2_iq_chunks",
    """s AS (SELECT CAST(floor(vec_id / 50) AS BIGINT) AS capture_id, vec_id % 50 * 32 + pos AS n, CAST(embedding[pos + 1] AS DOUBLE) AS i, CAST(embedding[pos + 33] AS DOUBLE) AS q
         FROM embeddings, (SELECT unnest(range(32)) AS pos))
       SELECT capture_id, n // 300 AS sequence_number, min(n) AS start_sample, max(n) + 1 AS end_sample, round(sum(round(i * 32767)) / 32768, 4) AS sum_i,
         round(sum(round(q * 32767)) / 32768, 4) AS sum_q FROM s GROUP BY ALL""",
)
def _(v):
    chunks = S.iq_chunks(S.capture_catalog(v.spark, _recordings(v)), chunk_samples=300)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return chunks.select(
        F.regexp_extract("path", _ID, 1).cast("bigint").alias("capture_id"), "sequence_number", "start_sample", "end_sample",
        total("i").alias("sum_i"), total("q").alias("sum_q"),
    )


@query(
    "src3_full_scale",
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 128e0 WHEN 1 THEN 32768e0 WHEN 2 THEN 2147483648e0 WHEN 3 THEN 1e0 WHEN 4 THEN 1e0 END AS full_scale FROM part""",
)
def _(v):
    kinds = F.array(*[F.lit(k) for k in ("int8", "INT16", "int32", "single", "float64", "uint4")])
    return v.table("part").select("p_partkey", S.full_scale(F.get(kinds, F.col("p_size") % 6)).alias("full_scale"))


@query(
    "src4_rate_from_name",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN CAST(48000 + page_id AS DOUBLE) WHEN 1 THEN 2500000e0 + page_id % 7 * 100000 WHEN 2 THEN NULL ELSE 78125e0 END AS rate_hz FROM pages""",
)
def _(v):
    p = F.col("page_id")
    name = (
        F.when(p % 4 == 0, F.concat(F.lit("/d/a_"), (48000 + p).cast("string"), F.lit(".rawiq")))
        .when(p % 4 == 1, F.concat(F.lit("/d/wide_"), ((25 + p % 7) / 10).cast("string"), F.lit(" mhz.rawiq")))
        .when(p % 4 == 2, F.concat("url", F.lit("/plain.bin")))
        .otherwise(F.lit("x_2.5MHz_78125.rawiq"))
    )
    return v.table("pages").select("page_id", S.rate_from_name(name).alias("rate_hz"))


@query(
    "src5_pdu_json",
    "SELECT seq, coalesce(protocol, 'DMR') AS protocol, type, CAST(src_num AS STRING) AS src, flco, fo_hz, color_code, fs_start FROM v_pdus",
)
def _(v):
    """Events written as JSON, with the offset under its old spelling, and read back."""
    path = scratch_path(v.spark, "pdus")
    df = conform_pdus(v.pdus).select(
        "protocol", "type", "src", "dst", "ts", "flco", "fid", F.col("fo_hz").alias("_fo_hz"), F.struct("seq", "color_code", "fs_start").alias("extra")
    )
    df.write.json(path)
    back = S.read_pdus(v.spark, path, "seq bigint, color_code bigint, fs_start bigint", multi_line=False)
    return back.select("extra.seq", "protocol", "type", "src", "flco", "fo_hz", "extra.color_code", "extra.fs_start")


@query(
    "src6_manifest",
    """SELECT c_nationkey AS recording, c_custkey AS carrier_id, CASE c_custkey % 3 WHEN 0 THEN 'DMR' WHEN 1 THEN 'P25' ELSE 'TETRA' END AS protocol,
         round(c_acctbal * 100, 2) AS offset_hz, 2500000e0 AS sample_rate_hz FROM customer""",
)
def _(v):
    """A manifest per nation, its customers as carriers."""
    c = F.col("c_custkey")
    proto = F.when(c % 3 == 0, "DMR").when(c % 3 == 1, "P25").otherwise("TETRA")
    channel = F.struct(
        c.alias("channelId"), proto.alias("protocol"), F.round(F.col("c_acctbal") * 100, 2).alias("frequencyOffsetHz"), F.lit(0.5).alias("outputStartSec")
    )
    path = scratch_path(v.spark, "manifest")
    man = v.table("customer").groupBy("c_nationkey").agg(F.collect_list(channel).alias("channels")).select(
        F.lit(1).alias("schemaVersion"), F.lit(2500000.0).alias("sampleRateHz"), F.col("c_nationkey").cast("double").alias("centerFrequencyHz"),
        F.lit(4.0).alias("durationSec"), F.lit(10000000).alias("sampleCount"), "channels",
    )
    man.repartition("centerFrequencyHz").write.option("maxRecordsPerFile", 1).json(path)
    return S.read_manifest(v.spark, path).select(
        F.col("center_frequency_hz").cast("int").alias("recording"), "carrier_id", "protocol", "offset_hz", "sample_rate_hz"
    )


_REPLAY = """
  c AS (SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY seq) - 1 AS n, (seq % 4096) * 4800 AS s, (seq % 4096) * 4800 + 4800 AS e FROM v_chunks),
  t AS (SELECT channel_id, max(e) AS total, count(*) AS cnt FROM c GROUP BY 1),
  l AS (SELECT unnest(range(0, 3)) AS lp),
  d AS (SELECT channel_id, lp * (cnt + 3) + n AS sequence_number, s + lp * (total + 12000) AS start_sample, e + lp * (total + 12000) AS end_sample,
      lp > 0 AND n = 0 AS discontinuity, lp + 1 AS loop_index, FALSE AS is_silence FROM c JOIN t USING (channel_id), l),
  q AS (SELECT channel_id, lp * (cnt + 3) + cnt + k AS sequence_number, (lp + 1) * total + lp * 12000 + k * 4800 AS start_sample,
      (lp + 1) * total + lp * 12000 + least(12000, (k + 1) * 4800) AS end_sample, FALSE, lp + 1, TRUE FROM t, l, (SELECT unnest(range(0, 3)) AS k) WHERE lp < 2)"""


@query("src7_replay_timeline", _REPLAY + " SELECT * FROM d UNION ALL SELECT * FROM q")
def _(v):
    c = v.chunks.select(
        "channel_id", (F.col("seq") % 4096).alias("sequence_number"), (F.col("seq") % 4096 * 4800).alias("start_sample"),
        (F.col("seq") % 4096 * 4800 + 4800).alias("end_sample"), F.lit(False).alias("discontinuity"),
    )
    out = S.replay_timeline(c, ["channel_id"], 3, "epoch-repeat", 12000, 4800)
    return out.select("channel_id", "sequence_number", "start_sample", "end_sample", "discontinuity", "loop_index", "is_silence")


@query("snk1_pdu_json", "SELECT seq, type, FALSE AS has_raw_bits FROM v_pdus")
def _(v):
    path = scratch_path(v.spark, "out-pdus")
    sinks.write_pdus(v.pdus.withColumn("raw_bits", F.lit("0101")), path)
    back = v.spark.read.json(path)
    return back.select("seq", "type", F.lit("raw_bits" in back.columns).alias("has_raw_bits"))


@query(
    "snk2_window_csv",
    """SELECT CAST(o_orderkey AS STRING) AS "index", printf('%.6f', o_custkey / 8) AS start_s, CAST(o_custkey % 7 AS STRING) AS events,
         CASE WHEN o_orderkey % 5 = 0 THEN 'NaN' ELSE printf('%g', o_custkey / 8) END AS timing_error_rad, o_orderstatus AS variant FROM orders""",
)
def _(v):
    c, n = F.col("o_custkey"), F.col("o_orderkey")
    df = v.table("orders").select(
        n.alias("index"), (c / 8).alias("start_sec"), (c / 8 + 1).alias("end_sec"), F.lit(1.0).alias("duration_sec"), (c % 7).alias("pdu_count"),
        *[F.lit(0).alias(x) for x in ("confirmed_bursts", "dsb_count", "dnb_count", "dmac_sync_count", "stch_count", "schf_count")],
        F.when(n % 5 != 0, c / 8).alias("timing_error_rad"), (c * 10.0).alias("coarse_frequency_offset_hz"), F.col("o_orderstatus").alias("decision_variant"),
    )
    path = scratch_path(v.spark, "windows-csv")
    sinks.write_window_csv(df, path)
    return v.spark.read.csv(path, header=True).select("index", "start_s", "events", "timing_error_rad", "variant")


@query(
    "snk3_line_text",
    """SELECT printf('[%-12s] PROTO=%s SRC=%d DST=%d FLCO=%s FID=%s', type, coalesce(protocol, 'DMR'), src_num, dst_num, flco, fid) AS line, count(*) AS n
       FROM v_pdus GROUP BY 1""",
)
def _(v):
    path = scratch_path(v.spark, "lines")
    sinks.write_lines(conform_pdus(v.pdus.drop("fo_hz")), path)
    return v.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk4_carrier_hints",
    """SELECT CAST(s_suppkey AS STRING) AS source_path, 4e8 + round(s_acctbal * 10) AS rf_frequency_hz, round(s_acctbal * 10) AS offset_hz, 12500e0 AS refine_bandwidth_hz FROM supplier""",
)
def _(v):
    df = v.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("path"), F.lit("raw").alias("format"), F.lit(2.5e6).alias("sample_rate_hz"),
        F.lit(4e8).alias("center_frequency_hz"), F.round(F.col("s_acctbal") * 10).alias("offset_hz"), F.lit(12500.0).alias("bandwidth_hz"),
    )
    path = scratch_path(v.spark, "hints")
    sinks.write_carrier_hints(df, path)
    return v.spark.read.json(path).select("source_path", "rf_frequency_hz", "offset_hz", "refine_bandwidth_hz")


def _energy(x: np.ndarray, rate: float, window: dict) -> pd.DataFrame:
    """A stand-in decoder: sample count and mean power of the window."""
    return pd.DataFrame({"samples": [len(x)], "power": [float(np.mean(np.abs(x) ** 2))]})


@query(
    "udf2_window_decoder",
    """s AS (SELECT CAST(floor(vec_id / 50) AS BIGINT) AS capture_id, vec_id % 50 * 32 + pos AS n, CAST(embedding[pos + 1] AS DOUBLE) AS i, CAST(embedding[pos + 33] AS DOUBLE) AS q
         FROM embeddings, (SELECT unnest(range(32)) AS pos)), w AS (SELECT unnest(range(0, 6)) AS window_id)
       SELECT capture_id, window_id, count(*) AS samples, round(avg(i * i + q * q), 6) AS power FROM s JOIN w ON n >= window_id * 250 AND n < window_id * 250 + 400 GROUP BY ALL""",
)
def _(v):
    chunks = iq(v)
    windows = chunks.select("capture_id").distinct().withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    end = F.least(F.col("window_id") * 250 + 400, F.lit(1600))  # the last window ends with the capture
    windows = windows.withColumns({"start_sample": F.col("window_id") * 250, "end_sample": end})
    out = decode_windows(chunks, windows, ["capture_id"], _energy, "samples long, power double", 64.0)
    return out.select("capture_id", "window_id", "samples", R6("power").alias("power"))


@query(
    "udf1_protocol_handlers",
    """c AS (SELECT channel_id, color_code, count(*) AS n, min(seq) AS first, bool_or(confidence IN ('high', 'medium')) AS good FROM v_cch WHERE color_code >= 0 GROUP BY ALL),
       b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1 AND n >= 2)
       SELECT 'dPMR' AS protocol, channel_id, v_cch.seq FROM v_cch LEFT JOIN b USING (channel_id)
       WHERE b.n IS NULL OR (v_cch.color_code = b.color_code AND (NOT good OR confidence IN ('high', 'medium')))
       UNION ALL SELECT 'P25', channel_id, seq FROM v_pdus_p25""",
)
def _(v):
    """Postprocessing by protocol: dPMR keeps its stable colour, P25 passes unchanged."""
    from radiolake.operators.handlers import install_defaults
    from radiolake.registry import run_handler

    install_defaults(["channel_id"])
    dpmr = v.cch.select("channel_id", "seq", "protocol", "type", F.struct("color_code", "confidence").alias("extra"))
    p25 = v.pdus_p25.select("channel_id", "seq", "protocol", "type")
    lake = dpmr.unionByName(p25, allowMissingColumns=True)
    return run_handler(lake, "postprocess").select("protocol", "channel_id", "seq")
