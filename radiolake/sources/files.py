"""Reading recordings and event files.

File lists come from Spark's file listing, the bytes are read in tasks, by range, through
the file system the path names, so a recording is never read whole by one task.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.fields import has_path
from radiolake.registry import literal_map

# Full scale and bytes of one scalar by sample type
FULL_SCALE = {
    "int8": 128.0, "integer*1": 128.0, "int16": 32768.0, "integer*2": 32768.0, "int32": 2147483648.0,
    "integer*4": 2147483648.0, "uint8": 128.0, "int24": 8388608.0, "single": 1.0, "float32": 1.0, "double": 1.0, "float64": 1.0,
}
SCALAR_BYTES = {"int8": 1, "int16": 2, "int32": 4, "single": 4, "float32": 4, "double": 8, "float64": 8}
_NUMPY = {"int8": "<i1", "int16": "<i2", "int32": "<i4", "single": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
WAV_BYTES = SCALAR_BYTES | {"uint8": 1, "int24": 3}
BATCH_BYTES = 64 << 20  # samples a reading task holds before it hands them on


def _scalars(raw: bytes, kind: str) -> np.ndarray:
    """Numbers of a payload: 8-bit WAV samples have their zero at 128, 24-bit ones are signed."""
    if kind == "uint8":
        return np.frombuffer(raw, "<u1").astype(np.int16) - 128
    if kind == "int24":
        b = np.frombuffer(raw, "<u1").reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.int32)
    return np.frombuffer(raw, _NUMPY[kind])


def full_scale(dtype: Column) -> Column:
    """Divisor that brings samples of a type to full scale one; null for an unknown type."""
    return F.try_element_at(literal_map(FULL_SCALE), F.lower(dtype))


def rate_from_name(path: Column) -> Column:
    """Sample rate a recording's name tells: ``_<digits>.rawiq`` in Hz, else ``<x>MHz.rawiq``."""
    name = F.regexp_extract(path, "([^/\\\\]+)$", 1)
    hz = F.regexp_extract(name, "_([0-9]{4,9})[.]rawiq$", 1)
    mhz = F.regexp_extract(name, "([0-9]+([.][0-9]+)?)[ ]*[mM][hH][zZ][.]rawiq$", 1)
    return F.when(hz != "", hz.cast("double")).when(mhz != "", F.round(mhz.cast("double") * 1e6))


def named_rate(path: str) -> float | None:
    """``rate_from_name`` for one name."""
    name = re.split(r"[/\\]", path)[-1]
    hz, mhz = re.search(r"_([0-9]{4,9})[.]rawiq$", name), re.search(r"([0-9]+([.][0-9]+)?) *[mM][hH][zZ][.]rawiq$", name)
    return float(hz[1]) if hz else float(round(float(mhz[1]) * 1e6)) if mhz else None


# ------------------------------------------------------------ range reads


def locate(path: str):
    """File system and inner path of a path as Spark writes it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _open(path: str):
    system, inner = locate(path)
    return system.open_input_file(inner)


def _wav_header(f, size: int) -> dict:
    """Format, channels, rate and data position of a RIFF/WAVE file, found by walking the chunk
    headers, however much else lies between them."""

    def at(pos: int, n: int) -> bytes:
        f.seek(pos)
        return f.read(n)

    head = at(0, min(size, 12))
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return {"error": "not a WAV file"}
    pos, out = 12, {}
    while pos + 8 <= size:
        tag, length = struct.unpack("<4sI", at(pos, 8))
        if tag == b"fmt ":
            body = at(pos + 8, min(length, 40))
            if len(body) < 16:
                return {"error": "WAV format chunk is cut short"}
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if code == 0xFFFE and len(body) >= 26:  # extensible: the sub-format tells
                code = struct.unpack("<H", body[24:26])[0]
            out |= {"channels": channels, "rate": rate, "align": align, "bits": bits, "code": code}
        elif tag == b"data":
            return out | {"data": pos + 8, "bytes": length} if out else {"error": "WAV header without format chunk"}
        pos += 8 + length + length % 2
    return {"error": "WAV header without data chunk"}


def _wav_type(wav: dict) -> str:
    if wav["code"] == 3:
        return {32: "float32", 64: "float64"}.get(wav["bits"], f"float{wav['bits']}")
    if wav["code"] != 1:
        return f"code {wav['code']}"
    return "uint8" if wav["bits"] == 8 else f"int{wav['bits']}"


def _is_wav(path: str, size: int) -> bool:
    if path.lower().endswith((".wav", ".wave")):
        return True
    if size < 12:
        return False
    with _open(path) as f:
        head = f.read(12)
    return head[:4] == b"RIFF" and head[8:12] == b"WAVE"


CATALOG = (
    "path string, format string, header_bytes long, sample_rate_hz double, center_frequency_hz double, "
    "bandwidth_hz double, total_samples long, duration_sec double, device string, file_index long, "
    "declared_bytes long, file_bytes long, dtype string, frame_bytes long, is_valid boolean, error string"
)


def _describe(path: str, size: int, named_rate, opts: dict) -> dict:
    """Catalogue row of one recording from its first bytes."""
    row = {
        "path": path, "format": "raw", "header_bytes": 0, "sample_rate_hz": None, "center_frequency_hz": opts["center_hz"] or 0.0,
        "bandwidth_hz": 0.0, "total_samples": 0, "duration_sec": None, "device": "", "file_index": 0, "declared_bytes": 0,
        "file_bytes": size, "dtype": opts["dtype"], "frame_bytes": 0, "error": None,
    }
    lower = path.lower()
    if lower.endswith(".bvsp"):
        row.update(format="bvsp-usrp-ci16", header_bytes=112, frame_bytes=4)
        if size < 112:
            return row | {"error": "shorter than its 112-byte header"}
        with _open(path) as f:
            head = f.read(112)
        u32 = lambda at: struct.unpack("<I", head[at : at + 4])[0]
        row.update(
            declared_bytes=struct.unpack("<Q", head[8:16])[0], file_index=u32(28), device=head[32:48].split(b"\0")[0].decode("latin-1"),
            sample_rate_hz=float(u32(48)), bandwidth_hz=float(u32(52)), center_frequency_hz=1000.0 * u32(56),
        )
        if row["dtype"] != "int16":
            row["error"] = "payload is interleaved int16"
        elif row["declared_bytes"] not in (0, size):
            row["error"] = "header file size does not match the file"
        elif (size - 112) % 4:
            row["error"] = "payload is not aligned to I/Q pairs"
        row["total_samples"] = (size - 112) // 4
    elif _is_wav(path, size):
        with _open(path) as f:
            wav = _wav_header(f, size)
        row["format"] = "wav"
        if "error" in wav:
            return row | {"error": wav["error"]}
        row.update(
            sample_rate_hz=float(wav["rate"]), header_bytes=wav["data"], frame_bytes=wav["align"],
            total_samples=min(wav["bytes"], size - wav["data"]) // max(1, wav["align"]), dtype=_wav_type(wav),
        )
        if wav["channels"] < 2:
            row["error"] = "WAV IQ input must have at least two channels"
        elif opts["rate_hz"] and opts["rate_hz"] != wav["rate"]:
            row["error"] = "requested sample rate does not match the file"
        elif row["dtype"] not in WAV_BYTES:
            row["error"] = f"unsupported WAV sample type {row['dtype']}"
        elif wav["align"] != wav["channels"] * WAV_BYTES[row["dtype"]]:
            row["error"] = "WAV frames do not fit their sample type"
    else:
        width = SCALAR_BYTES.get(row["dtype"])
        row.update(header_bytes=opts["header_bytes"], sample_rate_hz=opts["rate_hz"] or named_rate)
        if width is None:
            return row | {"error": f"unsupported dtype {row['dtype']}"}
        payload = size - row["header_bytes"]
        row.update(frame_bytes=2 * width, total_samples=max(0, payload) // (2 * width))
        if row["sample_rate_hz"] is None:
            row["error"] = "sample rate is required for a headerless file"
        elif payload < 0 or payload % (2 * width):
            row["error"] = "payload is not aligned to I/Q pairs"
    if row["error"] is None and row["total_samples"] == 0:
        row["error"] = "no samples"
    if row["sample_rate_hz"]:
        row["duration_sec"] = row["total_samples"] / row["sample_rate_hz"]
    return row


def capture_catalog(
    spark: SparkSession, paths: list[str] | str, rate_hz: float | None = None, center_hz: float | None = None,
    dtype: str = "int16", header_bytes: int = 0,
) -> DataFrame:
    """One row per recording: what it is, how long, and whether it can be read.

    Only headers are read.  Faulty recordings stay in the catalogue with an ``error``.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length", rate_from_name(F.col("path")).alias("named"))
    opts = {"rate_hz": rate_hz, "center_hz": center_hz, "dtype": dtype.lower(), "header_bytes": int(header_bytes)}
    names = [c.split()[0] for c in CATALOG.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = _describe(r.path, int(r.length), None if pd.isna(r.named) else float(r.named), opts)
                rows.append(d | {"is_valid": d["error"] is None})
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, CATALOG)


CHUNKS = (
    "path string, channel_id long, sequence_number long, start_sample long, end_sample long, timestamp_ns long, "
    "center_frequency_hz double, sample_rate_hz double, total_samples long, discontinuity boolean, dropped_samples long, "
    "i array<float>, q array<float>"
)


def read_chunk(f, r, scale: float | None, channel_id: int) -> tuple:
    """Chunk row for one planned range of an open recording."""
    frame = int(r.frame_bytes)
    f.seek(int(r.header_bytes) + int(r.start_sample) * frame)
    raw = f.read(int(r.end_sample - r.start_sample) * frame)
    x = _scalars(raw, r.dtype).reshape(-1, frame // WAV_BYTES[r.dtype])
    by = float(scale if scale is not None else FULL_SCALE[r.dtype])
    ns = int(round(r.start_sample / r.sample_rate_hz * 1e9))
    return (
        r.path, channel_id, r.sequence_number, r.start_sample, r.start_sample + len(x), ns, r.center_frequency_hz,
        r.sample_rate_hz, r.total_samples, False, 0, (x[:, 0] / by).astype("float32"), (x[:, 1] / by).astype("float32"),
    )


def iq_chunks(
    captures: DataFrame, chunk_sec: float = 0.1, chunk_samples: int | None = None, scale: float | None = None,
    channel_id: int = 1, task_bytes: int = 128 << 20,
) -> DataFrame:
    """Chunk rows of the valid recordings of a catalogue.

    Chunks are planned from the catalogue, dealt over tasks of about ``task_bytes`` by the bytes
    that the catalogue adds up to, and read by byte range where they land; a task hands samples
    on every 64 MB.  An incomplete last sample is left out, the last chunk may be short.
    """
    if scale is not None and (scale == 0 or not np.isfinite(scale)):
        raise ValueError("scale must be finite and not zero")
    size = (
        F.lit(int(chunk_samples)) if chunk_samples
        else F.greatest(F.lit(1), F.round(F.col("sample_rate_hz") * chunk_sec)).cast("bigint")
    )
    plan = captures.where("is_valid").withColumn("_n", size)
    last = F.ceil(F.col("total_samples") / F.col("_n")) - 1
    plan = plan.withColumn("sequence_number", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("sequence_number") * F.col("_n")
    plan = plan.select(
        "path", "dtype", "header_bytes", "frame_bytes", "sample_rate_hz", "center_frequency_hz", "total_samples", "sequence_number",
        start.alias("start_sample"), F.least(start + F.col("_n"), F.col("total_samples")).alias("end_sample"),
    )
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def read(batches):
        handles: dict = {}
        for pdf in batches:
            out, held = [], 0
            for r in pdf.itertuples(index=False):
                if r.path not in handles:
                    handles[r.path] = _open(r.path)
                out.append(read_chunk(handles[r.path], r, scale, channel_id))
                held += 8 * len(out[-1][-1])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)
        for f in handles.values():
            f.close()

    planned = captures.where("is_valid").agg(F.sum(F.col("total_samples") * F.col("frame_bytes"))).first()[0] or 0
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, -(-int(planned) // task_bytes))
    return plan.repartition(tasks, "path", "sequence_number").mapInPandas(read, CHUNKS)


# ------------------------------------------------------------ JSON sources

PDU_JSON = (
    "protocol string, type string, src string, dst string, ts bigint, flco string, fid string, extra string, "
    "_fo_hz double, x_fo_hz double, fo_hz double, raw_bits string"
)


def read_pdus(spark: SparkSession, path: str, extra_schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """PDU records from JSON.  ``extra`` stays JSON text in ``extra_json``; with a schema its
    listed leaves also become a struct.  The carrier offset may have any of its spellings."""
    df = spark.read.schema(PDU_JSON).json(path, multiLine=multi_line)
    df = df.withColumn("fo_hz", F.coalesce("fo_hz", "_fo_hz", "x_fo_hz")).drop("_fo_hz", "x_fo_hz")
    df = df.withColumnRenamed("extra", "extra_json")
    return df.withColumn("extra", F.from_json("extra_json", extra_schema)) if extra_schema else df


MANIFEST = (
    "schemaVersion int, sampleRateHz double, centerFrequencyHz double, durationSec double, sampleCount bigint, "
    "channels array<struct<channelId bigint, protocol string, frequencyOffsetHz double, outputStartSec double, "
    "durationSec double>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per carrier a fixture recording holds."""
    df = spark.read.schema(MANIFEST).json(path, multiLine=True)
    top = ["sampleRateHz", "centerFrequencyHz", "sampleCount"]
    rows = df.select(F.col("durationSec").alias("recording_sec"), *top, F.explode("channels").alias("c"))
    return rows.select(
        F.col("c.channelId").alias("carrier_id"), F.col("c.protocol").alias("protocol"), F.col("c.frequencyOffsetHz").alias("offset_hz"),
        F.col("c.outputStartSec").alias("start_sec"), F.coalesce("c.durationSec", "recording_sec").alias("duration_sec"),
        F.col("sampleRateHz").alias("sample_rate_hz"), F.col("centerFrequencyHz").alias("center_frequency_hz"),
        F.col("sampleCount").alias("sample_count"),
    )


# ------------------------------------------------------------ replay


def replay_timeline(
    chunks: DataFrame, scope: list[str], loops: int = 1, mode: str = "once", silence_samples: int = 0, chunk_samples: int = 4800
) -> DataFrame:
    """Chunks of recordings repeated on one growing timeline.

    ``once`` plays one time, ``continuous-test`` joins the loops without a gap, and
    ``epoch-repeat`` puts silence between them and flags the chunk after it.
    """
    if mode not in ("once", "continuous-test", "epoch-repeat"):
        raise ValueError(f"unknown replay mode {mode}")
    if mode == "once" and loops != 1:
        raise ValueError("replay mode once plays one loop")
    if mode == "epoch-repeat" and silence_samples <= 0:
        raise ValueError("epoch-repeat needs silence between loops")
    gap = int(silence_samples) if mode == "epoch-repeat" else 0
    quiet = -(-gap // chunk_samples)  # silent chunks after a loop
    totals = chunks.groupBy(*scope).agg(
        F.max("end_sample").alias("_total"), F.count(F.lit(1)).alias("_n"), F.min("sequence_number").alias("_first")
    )
    loop = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(loops - 1).cast("bigint")))
    data = chunks.join(totals, scope).withColumn("_loop", loop)
    shift = F.col("_loop") * (F.col("_total") + gap)
    keep = [c for c in chunks.columns if c not in ("start_sample", "end_sample", "sequence_number", "discontinuity")]
    again = (F.col("_loop") > 0) & (F.lit(gap) > 0) & (F.col("sequence_number") == F.col("_first"))
    played = data.select(
        *keep,
        (F.col("_loop") * (F.col("_n") + quiet) + F.col("sequence_number") - F.col("_first")).alias("sequence_number"),
        (F.col("start_sample") + shift).alias("start_sample"), (F.col("end_sample") + shift).alias("end_sample"),
        again.alias("discontinuity"), (F.col("_loop") + 1).alias("loop_index"), F.lit(False).alias("is_silence"),
        F.col("start_sample").alias("file_sample_start"),
    )
    if not gap or loops == 1:
        return played
    pauses = totals.withColumn("_loop", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(loops - 2).cast("bigint"))))
    pauses = pauses.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(quiet - 1).cast("bigint"))))
    begin = (F.col("_loop") + 1) * F.col("_total") + F.col("_loop") * gap + F.col("_k") * chunk_samples
    silent = pauses.select(
        *scope, (F.col("_loop") * (F.col("_n") + quiet) + F.col("_n") + F.col("_k")).alias("sequence_number"),
        begin.alias("start_sample"),
        (begin + F.least(F.lit(chunk_samples).cast("bigint"), F.lit(gap).cast("bigint") - F.col("_k") * chunk_samples)).alias("end_sample"),
        F.lit(False).alias("discontinuity"), (F.col("_loop") + 1).alias("loop_index"), F.lit(True).alias("is_silence"),
    )
    out = played.unionByName(silent, allowMissingColumns=True)
    if has_path(chunks.schema, "i"):
        zeros = F.array_repeat(F.lit(0.0).cast("float"), (F.col("end_sample") - F.col("start_sample")).cast("int"))
        out = out.withColumns({c: F.when(F.col("is_silence"), zeros).otherwise(F.col(c)) for c in ("i", "q")})
    return out
