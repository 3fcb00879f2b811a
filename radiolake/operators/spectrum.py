"""Spectra, carrier search and signal-level analytics over chunk tables.

A spectrum table has one row per (capture, bin): ``bin`` counts up with frequency,
``freq_hz``, ``power``.  The bins of one spectrum are bounded by the FFT length, so windows
over them are small.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.functions.joins import interval_join
from radiolake.functions.ordered import WIDTH, before, scan, settle, upto, with_lags
from radiolake.functions.stats import grouped_quantiles
from radiolake.session import spread

# ------------------------------------------------------------ spectra from samples


def _hamming(n: int) -> np.ndarray:
    return np.ones(1) if n == 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))


def _frames(a: int, b: int, total: int, n: int, hop: int, row_len: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the complete frames that touch samples [a, b) of a capture."""
    if row_len is None:
        k = np.arange(max(0, (a - n) // hop + 1), (b - 1) // hop + 1)
        starts, rows = k * hop, np.zeros(len(k), int)
    else:
        r = np.arange(a // row_len, (b - 1) // row_len + 1)
        j = np.arange(row_len // n)
        starts = (r[:, None] * row_len + j[None, :] * n).ravel()
        rows = np.repeat(r, len(j))
    ok = (starts + n <= total) & (starts < b) & (starts + n > a)
    return rows[ok], starts[ok]


def _power(frames: np.ndarray, window: np.ndarray, rate: float) -> np.ndarray:
    """Summed power of windowed frames, lowest frequency first."""
    spectrum = np.fft.fft(frames * window, axis=1)
    return np.fft.fftshift((np.abs(spectrum) ** 2).sum(axis=0) / (rate * np.sum(window**2)))


def _spectra(chunks: DataFrame, keys: list[str], n: int, window, hop_of, row_len: int | None) -> DataFrame:
    """Mean spectrum per (keys, row).

    Frames inside a chunk are transformed and summed where the chunk is read, so what
    travels is one partial sum per batch.  Only the pieces of frames that straddle chunks
    are shuffled, to be joined and transformed afterwards.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    head = ", ".join(f"{k} {fields[k]}" for k in keys)
    names = [*keys, "row", "seg", "off", "psd", "frames", "i", "q", "rate", "n"]
    schema = (
        f"{head}, row long, seg long, off long, psd array<double>, frames long, i array<double>, q array<double>, "
        "rate double, n long"
    )

    def local(batches):
        for pdf in batches:
            sums: dict = {}
            pieces = []
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.i, float) + 1j * np.asarray(r.q, float)
                a, total, rate = int(r.start_sample), int(r.total_samples), float(r.sample_rate_hz)
                b, size = a + len(x), max(8, min(n, total))
                if total < size:  # a capture below the minimum is padded with zeros
                    x, b, total = np.append(x, np.zeros(size - total)), size, size
                key = tuple(getattr(r, k) for k in keys)
                if not len(x):
                    continue
                rows, starts = _frames(a, b, total, size, hop_of(size), row_len)
                inside = (starts >= a) & (starts + size <= b)
                for row in np.unique(rows[inside]):
                    at = starts[inside & (rows == row)] - a
                    frames = x[at[:, None] + np.arange(size)[None, :]]
                    got = sums.setdefault((*key, int(row), rate, size), [np.zeros(size), 0])
                    got[0] += _power(frames, window(size), rate)
                    got[1] += len(at)
                for row, s in zip(rows[~inside], starts[~inside], strict=True):
                    lo, hi = max(a, s), min(b, s + size)
                    part = x[lo - a : hi - a]
                    pieces.append((*key, int(row), int(s), int(lo - s), None, 0, part.real, part.imag, rate, size))
            out = [(*k[: len(keys)], k[-3], None, None, v[0], v[1], None, None, k[-2], k[-1]) for k, v in sums.items()]
            yield pd.DataFrame(out + pieces, columns=names)

    def joined(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.i, float) + 1j * np.asarray(r.q, float)
                psd = _power(x[None, :], window(int(r.n)), float(r.rate))
                out.append((*[getattr(r, k) for k in keys], r.row, None, None, psd, 1, None, None, r.rate, r.n))
            yield pd.DataFrame(out, columns=names)

    need = [*keys, "start_sample", "total_samples", "sample_rate_hz", "i", "q"]
    parts = settle(spread(chunks.select(*need), *keys, "start_sample").mapInPandas(local, schema))
    sums = parts.where("psd IS NOT NULL")
    whole = (
        parts.where("psd IS NULL")
        .groupBy(*keys, "row", "seg", "rate", "n")
        .agg(F.sort_array(F.collect_list(F.struct("off", "i", "q"))).alias("_p"))
        .select(
            *keys, "row", "rate", "n",
            F.flatten(F.transform("_p", lambda p: p["i"])).alias("i"),
            F.flatten(F.transform("_p", lambda p: p["q"])).alias("q"),
        )
        .where(F.size("i") == F.col("n"))
        .mapInPandas(joined, schema)
    )
    bins = sums.unionByName(whole).select(
        *keys, "row", "rate", "n", "frames", F.posexplode("psd").alias("bin", "p")
    )
    out = bins.groupBy(*keys, "row", "bin", "rate", "n").agg(
        (F.sum("p") / F.sum("frames")).alias("power"), F.sum("frames").alias("frame_count")
    )
    half = F.floor(F.col("n") / 2)
    return out.select(
        *keys, "row", F.col("bin").cast("bigint").alias("bin"),
        ((F.col("bin") - half) * F.col("rate") / F.col("n")).alias("freq_hz"), "power", "frame_count",
    )


def welch_psd(chunks: DataFrame, keys: list[str], nperseg: int = 4096) -> DataFrame:
    """Averaged two-sided spectrum of each capture: Hamming frames, half overlapping.

    Chunks carry start_sample (counted from the start of the capture), total_samples,
    sample_rate_hz, i and q.
    """
    return _spectra(chunks, keys, int(nperseg), _hamming, lambda size: max(1, size // 2), None).drop("row")


def waterfall(chunks: DataFrame, keys: list[str], nfft: int, samples_per_row: int) -> DataFrame:
    """Spectrum over time: Hann frames, averaged over ``samples_per_row`` samples a row."""
    row_len = max(int(nfft), int(samples_per_row))
    return _spectra(chunks, keys, int(nfft), _hann, lambda size: size, row_len)


# ------------------------------------------------------------ spectra over time


def average_and_hold(spectra: DataFrame, by: list[str]) -> DataFrame:
    return spectra.groupBy(*by).agg(F.avg("power").alias("average"), F.max("power").alias("max_hold"))


def _decayed_sum(rows: DataFrame, keys: list[str], order: str, value: str, keep: float, name: str, level: int = 0) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the key up to this one, each weighted
    with ``keep`` to the power of its distance in ``order``.

    Rows are cut into blocks.  Inside one, values are scaled up from the block's start, and
    the block is short enough for that to stay a double.  The sums at the block ends form the
    same problem with ``keep`` to the power of the block length, which is solved in the same
    way, level by level, until a block fades its predecessor by 1e-99 or more: then only the two
    blocks before a row can be seen in a double.  A level has at most a row for each 512 of the one
    below where that is not so yet, and no level has a window or list over a whole key.
    """
    if keep == 0:
        return rows.withColumn(name, F.col(value))
    block = max(1, min(512, int(200 / -math.log10(keep)))) if keep < 1 else 512
    blk, own, end, total, held = (f"_{x}{level}" for x in ("block", "own", "end", "total", "held"))
    at = F.col(order) - F.floor(F.col(order) / block) * block
    rows = rows.withColumn(blk, F.floor(F.col(order) / block).cast("bigint"))
    scaled = F.col(value) * F.pow(F.lit(1.0 / keep), at)
    local = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(own, F.sum(scaled).over(local) * F.pow(F.lit(keep), at))
    ends = rows.groupBy(*keys, blk).agg((F.sum(scaled) * F.pow(F.lit(keep), F.lit(block - 1))).alias(end))
    fade = keep**block
    # what the blocks before have gathered, faded by the distance to this row
    if fade < 1e-99 or level == 6:  # 512**7 updates are more than a bigint counts
        near = F.array(
            F.struct((F.col(blk) + 1).alias("b"), F.col(end).alias("x")),
            F.struct((F.col(blk) + 2).alias("b"), (F.col(end) * fade).alias("x")),
        )
        seen = ends.select(*keys, F.inline(near)).groupBy(*keys, F.col("b").alias(blk))
        carried = seen.agg(F.sum("x").alias(held))
    else:
        ends = _decayed_sum(ends, keys, blk, end, fade, total, level + 1)
        carried = ends.select(*keys, (F.col(blk) + 1).alias(blk), F.col(total).alias(held))
    joined = rows.join(carried, [*keys, blk], "left")
    faded = F.coalesce(held, F.lit(0.0)) * F.pow(F.lit(keep), at + 1)
    return joined.withColumn(name, F.col(own) + faded).drop(own, held, blk)


def live_average(spectra: DataFrame, keys: list[str], order: str, alpha: float = 0.25, reset: str | None = None) -> DataFrame:
    """Smoothed spectrum and held maximum after every update, for any ``alpha`` in (0, 1].

    ``keys`` names capture and bin, ``order`` counts updates from 0 without gaps.  ``reset``
    names a boolean column that restarts the maximum.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    keys = list(keys)
    weight = F.when(F.col(order) == 0, 1.0).otherwise(alpha)
    rows = spectra.withColumn("_term", weight * F.col("power"))
    out = _decayed_sum(rows, keys, order, "_term", 1.0 - alpha, "average").drop("_term")
    if reset is None:
        return scan(settle(out), keys, order, [upto("max_hold", "max", F.col("power"))])
    out = scan(settle(out), keys, order, [upto("_epoch", "sum", F.col(reset).cast("bigint"))])
    return scan(settle(out), [*keys, "_epoch"], order, [upto("max_hold", "max", F.col("power"))]).drop("_epoch")


def display_factor(nfft: int, max_bins: int) -> int:
    """Bins averaged for display: the least count that fits and divides the FFT length."""
    k = max(1, -(-nfft // max_bins))
    while nfft % k:
        k += 1
    return k


def decimate_display(spectra: DataFrame, keys: list[str], nfft: int, max_bins: int) -> DataFrame:
    k = display_factor(nfft, max_bins)
    return spectra.groupBy(*keys, F.floor(F.col("bin") / k).alias("display_bin")).agg(
        F.avg("power").alias("power"), F.avg("freq_hz").alias("freq_hz")
    )


# ------------------------------------------------------------ carrier search


def smooth_bins(psd: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Centred mean over ``bins`` bins, shorter at the edges; an even count reaches one bin
    further up than down."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-((bins - 1) // 2), bins // 2)
    return psd.withColumn("channel_power", F.avg("power").over(w))


def with_threshold(psd: DataFrame, keys: list[str], margin_db: float = 15.0) -> DataFrame:
    """Level in dB, the median level of the spectrum, and the threshold above it."""
    db = F.lit(10.0) * F.log10(F.col("channel_power") + 1e-12)
    rows = psd.withColumn("power_db", db)
    floor = F.median("power_db").over(Window.partitionBy(*keys))
    return rows.withColumn("noise_floor_db", floor).withColumn("threshold_db", F.col("noise_floor_db") + margin_db)


def local_peaks(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Bins above their left and not below their right neighbour, at or over the threshold;
    edge bins have no two neighbours and are no peaks."""
    w = Window.partitionBy(*keys).orderBy("bin")
    left, right = F.lag("power_db").over(w), F.lead("power_db").over(w)
    rows = psd.withColumns({"_l": left, "_r": right})
    x = F.col("power_db")
    return rows.where((x > F.col("_l")) & (x >= F.col("_r")) & (x >= F.col("threshold_db"))).drop("_l", "_r")


LONG_CHAIN = 4096  # candidates of a chain that one row may hold


def suppress_neighbours(
    candidates: DataFrame, scope: list[str], pos: str, score: str, min_distance: float, max_count: int | None = None,
    width: float = WIDTH, long_chain: int = LONG_CHAIN,
) -> DataFrame:
    """Greedy choice by falling ``score`` (earlier position first on a tie), skipping any
    candidate closer than ``min_distance`` to one already chosen.

    Candidates at least that far apart cannot touch each other, so the choice is made
    inside each chain of close ones; the optional cap is then a rank over what was chosen.
    A chain of more than ``long_chain`` candidates is settled in rounds over blocks of it
    (``settle_in_rounds``), with the same choice.
    """
    scope = list(scope)
    rows = scan(candidates, scope, pos, [before("_prev", "max", F.col(pos))], width)
    opens = F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") >= min_distance)
    rows = settle(rows.withColumn("_opens", opens).drop("_prev"))
    rows = scan(rows, scope, pos, [upto("_chain", "max", F.when(F.col("_opens"), F.col(pos)))], width)
    rows = settle(rows.select(*scope, F.col(pos), F.col(score), "_chain"))
    chain = [*scope, "_chain"]
    long = settle(rows.groupBy(*chain).count().where(F.col("count") > long_chain).drop("count"))
    known = long.withColumnsRenamed({c: f"_k_{c}" for c in chain})
    in_long = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in chain]
    any_long = bool(long.head(1))
    item = F.struct((-F.col(score)).alias("s"), F.col(pos).alias("p"))
    chosen = (
        (rows.join(known, in_long, "left_anti") if any_long else rows)
        .groupBy(*chain)
        .agg(F.sort_array(F.collect_list(item)).alias("_c"))
        .select(*scope, F.explode(greedy_positions(F.col("_c"), min_distance)).alias(pos))
    )
    if any_long:
        rest = rows.join(known, in_long, "left_semi").drop("_chain")
        chosen = chosen.unionByName(settle_in_rounds(rest, scope, pos, score, min_distance, long_chain))
    out = candidates.join(chosen, [*scope, pos], "left_semi")
    if max_count is None:
        return out
    w = Window.partitionBy(*scope).orderBy(F.col(score).desc(), pos)
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_count).drop("_rn")


def settle_in_rounds(
    candidates: DataFrame, scope: list[str], pos: str, score: str, min_distance: float, block_rows: int = LONG_CHAIN
) -> DataFrame:
    """(scope, pos) of the greedy choice, block by block at the same time.

    Each round looks at a block of positions with the candidates that can touch it on either
    side.  A candidate better than all open ones close to it is chosen, one close to a chosen one
    goes, and both hold for good; what hangs on an open candidate outside the block waits for
    the next round.  Only open candidates are written again, with what was chosen last.
    Every round settles at least the best open candidate of each chain, and a run of ever
    better candidates costs one round for each block that it crosses.  A block is at least two
    distances wide, so what lies closer together than that is looked at in one piece.  Rows with
    a null in scope or position are left out; a null score is the best.
    """
    scope = list(scope)
    cell = F.floor(F.col(pos) / float(min_distance))
    held = candidates.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(cell).alias("cells")).first()
    # about block_rows candidates in a block
    size = float(min_distance) * max(2, block_rows * held["cells"] // max(1, held["rows"]))
    value = F.coalesce(F.col(score).cast("double"), F.lit(math.inf))
    todo = candidates.dropna(subset=[*scope, pos]).select(
        *scope, F.col(pos).alias("_p"), value.alias("_s"), F.lit(OPEN).alias("_state")
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in todo.schema])

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["_own"] == pdf["_block"]).to_numpy()
        state = _settle_block(pdf["_p"].to_numpy(), pdf["_s"].to_numpy(), pdf["_state"].to_numpy(), own, min_distance)
        return pdf.assign(_state=state).loc[own, schema.names]

    found = candidates.select(*scope, pos).limit(0)
    while True:
        block_at = [F.floor((F.col("_p") + d) / size).cast("bigint") for d in (0, -min_distance, min_distance)]
        seen = todo.withColumn("_own", block_at[0]).withColumn("_block", F.explode(F.array_distinct(F.array(*block_at))))
        after = settle(seen.groupBy(*scope, "_block").applyInPandas(look, schema))
        found = found.unionByName(after.where(F.col("_state") == CHOSEN).select(*scope, F.col("_p").alias(pos)))
        # a chosen candidate is shown once more, to those close to it in other blocks
        known = F.when(F.col("_state") == CHOSEN, KNOWN).otherwise(OPEN)
        todo = after.where(F.col("_state").isin(OPEN, CHOSEN)).withColumn("_state", known)
        if not after.where(F.col("_state") == OPEN).head(1):
            return found


OPEN, CHOSEN, GONE, KNOWN = range(4)


def _settle_block(pos, score, state, own, distance):
    """States after one look at a block (rows marked ``own``) and what can touch it."""
    state = state.copy()
    chosen = sorted(pos[state == KNOWN].tolist())
    waiting: list = []

    def close(places, p):
        k = bisect_left(places, p)
        return any(abs(places[j] - p) < distance for j in (k - 1, k) if 0 <= j < len(places))

    for j in np.lexsort((pos, -score)):
        if state[j] == OPEN:
            p = pos[j].item()
            if close(chosen, p):
                state[j] = GONE
            elif own[j] and not close(waiting, p):
                state[j] = CHOSEN
                insort(chosen, p)
            else:
                insort(waiting, p)
    return state


def greedy_positions(ranked: Column, min_distance: float) -> Column:
    """Positions ``p`` of a ranked array that survive neighbour suppression."""
    return F.aggregate(
        F.transform(ranked, lambda x: x["p"]),
        F.slice(F.transform(ranked, lambda x: x["p"]), 1, 0),
        lambda acc, p: F.when(
            F.exists(acc, lambda a: F.abs(a - p) < min_distance), acc
        ).otherwise(F.concat(acc, F.array(p))),
    )


def blind_search(
    psd: DataFrame, keys: list[str], bin_hz: float, margin_db: float = 15.0, smoothing_hz: float = 4800.0,
    spacing_hz: float = 12500.0, max_candidates: int | None = None,
) -> DataFrame:
    """Carriers standing out of a spectrum: smooth, find peaks over the median level, keep
    the strongest of close ones."""
    bins = max(3, int(smoothing_hz / bin_hz + 0.5))
    distance = max(1, int(spacing_hz / bin_hz + 0.5))
    rows = local_peaks(with_threshold(smooth_bins(psd, keys, bins), keys, margin_db), keys)
    # the candidates of one spectrum fit in a row
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("power_db")).alias("s"), F.col("bin").alias("p"))))
    peaks = settle(rows)
    kept = (
        peaks.groupBy(*keys)
        .agg(ranked.alias("_c"))
        .select(*keys, F.posexplode(greedy_positions(F.col("_c"), distance)).alias("_n", "bin"))
    )
    if max_candidates is not None:
        kept = kept.where(F.col("_n") < max_candidates)
    return peaks.join(kept.drop("_n"), [*keys, "bin"], "left_semi")


def refine_carriers(
    psd: DataFrame, hints: DataFrame, keys: list[str], bin_hz: float, bandwidth_hz: float = 12500.0,
    radius_hz: float | None = None,
) -> DataFrame:
    """Sharpen clicked frequencies (``hint_id``, ``hint_hz``): the strongest smoothed bin
    within the search radius, then the centre of gravity of what stands over the local noise."""
    radius = max(50000.0, 2 * bandwidth_hz) if radius_hz is None else radius_hz
    k = max(3, int(bandwidth_hz / abs(bin_hz) + 0.5))
    half = max(1, k // 2)
    # a moving mean of even length reaches one bin further down than up
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-(k // 2), (k - 1) // 2)
    rows = psd.withColumn("_smooth", F.avg("power").over(w))
    pairs = interval_join(
        rows, hints.withColumns({"_lo": F.col("hint_hz") - radius, "_hi": F.col("hint_hz") + radius}), keys,
        "freq_hz", "_lo", "_hi", 2 * radius, closed_end=True,
    )
    by = [*keys, "hint_id", "hint_hz"]
    best = pairs.groupBy(*by).agg(
        F.max_by(F.struct("bin", "freq_hz", "power"), F.struct(F.col("_smooth"), -F.col("bin"))).alias("_peak"),
        F.median("power").alias("noise_power"),
    )
    around = best.withColumns({"_b0": F.col("_peak.bin") - half, "_b1": F.col("_peak.bin") + half})
    near = interval_join(
        rows.select(*keys, "bin", "freq_hz", "power"), around, keys, "bin", "_b0", "_b1", 4 * half + 1, closed_end=True
    )
    weight = F.greatest(F.lit(0.0), F.col("power") - F.col("noise_power"))
    return (
        near.groupBy(*by)
        .agg(
            F.sum(F.col("freq_hz") * weight).alias("_fw"),
            F.sum(weight).alias("_w"),
            F.first("_peak").alias("_peak"),
            F.first("noise_power").alias("noise_power"),
        )
        .select(
            *by,
            F.when(F.col("_w") > 0, F.col("_fw") / F.col("_w")).otherwise(F.col("_peak.freq_hz")).alias("refined_hz"),
            F.col("_peak.freq_hz").alias("peak_bin_hz"),
            F.col("_peak.power").alias("peak_power"),
            "noise_power",
        )
    )


def active_bins(
    bins: DataFrame, keys: list[str], held: DataFrame | None = None, on_db: float = 10.0, off_db: float = 6.0,
    min_db: float = -160.0,
) -> DataFrame:
    """Coarse bins over the on threshold, plus bins of running tracks (``held``: keys and
    bin) still over the off threshold."""
    db = F.lit(10.0) * F.log10(F.col("power") + 1e-12)
    rows = bins.withColumn("power_db", db)
    rows = rows.withColumn("noise_floor_db", F.median("power_db").over(Window.partitionBy(*keys)))

    def over(margin: float) -> Column:
        return F.col("power_db") >= F.greatest(F.lit(min_db), F.col("noise_floor_db") + margin)

    if held is None:
        return rows.where(over(on_db))
    marked = rows.join(held.select(*keys, "bin").distinct().withColumn("_held", F.lit(True)), [*keys, "bin"], "left")
    return marked.where(over(on_db) | (F.col("_held").isNotNull() & over(off_db))).drop("_held")


def fine_candidates(
    active: DataFrame, fine: DataFrame, keys: list[str], bin_hz: float, margin_db: float = 8.0,
    smoothing_hz: float = 4800.0, spacing_hz: float = 5000.0,
) -> DataFrame:
    """Carriers inside active coarse bins.

    ``active`` carries keys, coarse_bin, coarse_center_offset_hz, center_hz, power_db and
    noise_floor_db; ``fine`` the spectrum of each coarse bin (keys, coarse_bin, bin,
    freq_hz, power).  A bin without a peak yields its strongest frequency.
    """
    by = [*keys, "coarse_bin"]
    fine = fine.join(active.select(*by), by, "left_semi")
    peaks = blind_search(fine, by, bin_hz, margin_db, smoothing_hz, spacing_hz).select(*by, "freq_hz")
    top = fine.groupBy(*by).agg(
        F.max_by("freq_hz", F.struct(F.col("power"), -F.col("bin"))).alias("_top")
    )
    found = top.join(peaks, by, "left").select(*by, F.coalesce("freq_hz", "_top").alias("residual_offset_hz"))
    offset = F.col("coarse_center_offset_hz") + F.col("residual_offset_hz")
    return active.join(found, by).withColumns(
        {
            "frequency_offset_hz": offset,
            "center_frequency_hz": F.col("center_hz") + offset,
            "snr_db": F.col("power_db") - F.col("noise_floor_db"),
        }
    )


def strongest(detections: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` strongest detections of each batch, numbered by frequency."""
    by_snr = Window.partitionBy(*keys).orderBy(F.col("snr_db").desc(), "frequency_offset_hz", "seq")
    kept = detections.withColumn("_rn", F.row_number().over(by_snr)).where(F.col("_rn") <= limit).drop("_rn")
    by_freq = Window.partitionBy(*keys).orderBy("frequency_offset_hz", "seq")
    return kept.withColumn("position", F.row_number().over(by_freq))


# ------------------------------------------------------------ modulation family

PHASE_OUT = (
    "samples long, phase_center double, q75 double, q90 double, tail_fraction double, fourth_moment double, pair_count long"
)

# What a family's features must be, and how margins raise the confidence above 0.90:
# (feature, limit, direction), weight and cap of the margin
GATE_RULES = (
    (
        "pi4dqpsk",
        "strong_pi4dqpsk_differential_phase_evidence",
        (("q75", 0.16, 1, 0.30, 0.25), ("tail_fraction", 0.18, 1, 0.15, 0.30), ("fourth_moment", 0.35, 1, 0.0, 0.0)),
    ),
    (
        "fsk4",
        "strong_4fsk_differential_phase_evidence",
        (("q75", 0.13, -1, 0.30, 0.13), ("tail_fraction", 0.08, -1, 0.20, 0.08), ("fourth_moment", 0.70, 1, 0.0, 0.0)),
    ),
)
GATE_MIN_SEC, GATE_STABLE_SEC, GATE_MIN_SAMPLES = 0.08, 0.18, 128
GATE_PROTOCOLS = {"pi4dqpsk": ("TETRA",), "fsk4": ("DMR", "P25", "dPMR", "NXDN")}


def _nearest_rank(ranked: np.ndarray, p: float) -> float:
    return float(ranked[max(1, math.ceil(p * len(ranked))) - 1])


def phase_features(snapshots: DataFrame, keys: list[str], look_back_sec: float = 0.25) -> DataFrame:
    """Spread of the sample-to-sample phase of the strong samples in the last ``look_back_sec``
    of each snapshot (i, q, sample_rate_hz); spread is in units of 125 kHz."""
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in snapshots.schema.fields if f.name in keys)
    names = [*keys, "sample_rate_hz", *[p.split()[0] for p in PHASE_OUT.split(", ")]]

    def features(i, q, rate: float) -> tuple:
        whole = np.asarray(i, float) + 1j * np.asarray(q, float)
        x = whole[-max(GATE_MIN_SAMPLES, round(GATE_MIN_SEC * rate), round(look_back_sec * rate)) :]
        if len(x) < 2:
            return (len(whole), *(None,) * 5, 0)
        size = np.abs(x)
        strong = size >= _nearest_rank(np.sort(size), 0.60)
        turn = (x[1:] * x[:-1].conj())[strong[1:] & strong[:-1]]
        if not len(turn):
            return (len(whole), *(None,) * 5, 0)
        unit = np.exp(1j * np.angle(turn))
        center = np.angle(unit.mean())
        spread_ = np.sort(np.abs(np.angle(unit * np.exp(-1j * center))) * rate / 125000)
        quarter, tenth = _nearest_rank(spread_, 0.75), _nearest_rank(spread_, 0.90)
        fourth = abs(np.exp(4j * spread_).mean())
        return len(whole), float(center), quarter, tenth, float((spread_ > 0.20).mean()), float(fourth), len(spread_)

    def run(batches):
        for pdf in batches:
            out = [
                (*[getattr(r, k) for k in keys], r.sample_rate_hz, *features(r.i, r.q, float(r.sample_rate_hz)))
                for r in pdf.itertuples(index=False)
            ]
            yield pd.DataFrame(out, columns=names).astype({"samples": "int64", "pair_count": "int64"})

    rows = snapshots.select(*keys, "i", "q", F.col("sample_rate_hz").cast("double").alias("sample_rate_hz"))
    return spread(rows, *keys).mapInPandas(run, f"{head}, sample_rate_hz double, {PHASE_OUT}")


def modulation_gate(snapshots: DataFrame, keys: list[str], look_back_sec: float = 0.25) -> DataFrame:
    """Decide per snapshot whether it is 4-level FSK or phase keyed, from its phase features.

    ``candidates`` lists the protocols that stay: those of the family, or all while the family
    is uncertain; ``excluded`` lists the others.
    """
    rows = phase_features(snapshots, keys, look_back_sec)
    rate, samples = F.col("sample_rate_hz"), F.col("samples")
    least = F.greatest(F.lit(GATE_MIN_SAMPLES), F.bround(GATE_MIN_SEC * rate))
    looked = F.least(samples, F.greatest(least, F.bround(look_back_sec * rate)))
    short = samples < least
    few = F.col("pair_count") < F.greatest(F.lit(GATE_MIN_SAMPLES), F.bround(0.01 * looked))
    early = samples / rate + 1 / rate < GATE_STABLE_SEC
    none = F.struct(F.lit("uncertain").alias("family"), F.lit(0.0).alias("confidence"))

    def with_reason(text: str) -> Column:
        return none.withField("reason", F.lit(text))

    verdict = F.when(short, with_reason("awaiting_modulation_analysis_window"))
    verdict = verdict.when(few, with_reason("too_few_active_differential_phase_samples"))
    verdict = verdict.when(early, with_reason("awaiting_stable_modulation_decision_window"))
    for family, reason, rules in GATE_RULES:
        holds, gain = F.lit(True), F.lit(0.90)
        for name, limit, way, weight, cap in rules:
            margin = way * (F.col(name) - limit)
            holds = holds & (F.col(name) >= limit if way > 0 else F.col(name) <= limit)
            gain = gain + weight * F.least(F.lit(cap), margin)
        found = F.struct(
            F.lit(family).alias("family"), F.least(F.lit(0.995), gain).alias("confidence"), F.lit(reason).alias("reason")
        )
        verdict = verdict.when(holds, found)
    verdict = verdict.otherwise(with_reason("insufficient_or_ambiguous_modulation_evidence"))
    every = [p for names in GATE_PROTOCOLS.values() for p in names]
    stays = F.array(*map(F.lit, every))
    for family, protocols in GATE_PROTOCOLS.items():
        stays = F.when(F.col("_v.family") == family, F.array(*map(F.lit, protocols))).otherwise(stays)
    blank = short | few  # nothing was measured that a decision could rest on
    measured = [
        F.when(~blank, F.col(c)).alias(c)
        for c in ("phase_center", "q75", "q90", "tail_fraction", "fourth_moment", "pair_count")
    ]
    return rows.withColumn("_v", verdict).select(
        *keys, "_v.family", "_v.confidence", "_v.reason", *measured, stays.alias("candidates"),
        F.array_except(F.array(*map(F.lit, every)), stays).alias("excluded"),
    )


def stable_family(decisions: DataFrame, scope: list[str], needed: int = 2, width: float = WIDTH) -> DataFrame:
    """First decision of each scope at which the same family was named ``needed`` times in
    a row (``seq`` order)."""
    rows = with_lags(decisions, list(scope), "seq", ["family"], needed - 1, width) if needed > 1 else decisions
    ok = F.col("family") != "uncertain"
    for k in range(1, needed):
        ok = ok & (F.col(f"lag{k}.family") == F.col("family"))
    return rows.where(ok).groupBy(*scope).agg(F.min(F.struct("seq", "family")).alias("_f")).select(
        *scope, F.col("_f.seq").alias("accepted_seq"), F.col("_f.family").alias("family")
    )


# ------------------------------------------------------------ tuning to narrowband


def lowpass_taps(cutoff_hz: float, rate_hz: float, count: int = 129) -> np.ndarray:
    """Windowed-sinc low-pass of unit gain."""
    n = np.arange(count) - (count - 1) / 2
    h = 2 * cutoff_hz / rate_hz * np.sinc(2 * cutoff_hz / rate_hz * n) * _hamming(count)
    return h / h.sum()


def tune(
    chunks: DataFrame, keys: list[str], offsets_hz: list[float], decimation: int, cutoff_hz: float, taps: int = 129
) -> DataFrame:
    """Shift each offset to zero, filter, and keep every ``decimation``-th sample.

    The mixer phase follows from the absolute sample number and filtering is linear, so
    chunks are independent: each yields the outputs its samples decide alone and its share
    of the outputs around its edges.  The shares of neighbouring chunks are added up
    afterwards; only they are shuffled.  ``generation`` separates stretches that must not
    mix.  Output rows hold consecutive baseband samples from ``start_sample`` on.
    """
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    if "generation" not in fields:
        chunks = chunks.withColumn("generation", F.lit(0).cast("bigint"))
    keys = [*keys, "generation"]
    fields["generation"] = "bigint"
    head = ", ".join(f"{k} {fields[k]}" for k in keys)
    schema = f"{head}, offset_hz double, start_sample long, edge boolean, re array<double>, im array<double>"
    names = [*keys, "offset_hz", "start_sample", "edge", "re", "im"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.i, float) + 1j * np.asarray(r.q, float)
                if not len(x):
                    continue
                a, rate = int(r.start_sample), float(r.sample_rate_hz)
                h = lowpass_taps(cutoff_hz, rate, taps)
                n = a + np.arange(len(x))
                first = -(-a // decimation)
                last = (a + len(x) + taps - 2) // decimation  # last output any sample reaches
                for f in offsets_hz:
                    full = np.convolve(x * np.exp(-2j * np.pi * f * n / rate), h)
                    m = np.arange(first, last + 1)
                    y = full[m * decimation - a]
                    body = (m * decimation - taps + 1 >= a) & (m * decimation < a + len(x))
                    key = tuple(getattr(r, k) for k in keys)
                    if body.any():
                        s = int(m[body][0])
                        out.append((*key, f, s, False, y[body].real, y[body].imag))
                    for mm, yy in zip(m[~body], y[~body], strict=True):
                        out.append((*key, f, int(mm), True, [yy.real], [yy.imag]))
            yield pd.DataFrame(out, columns=names)

    need = [*keys, "start_sample", "sample_rate_hz", "i", "q"]
    parts = settle(spread(chunks.select(*need), *keys, "start_sample").mapInPandas(run, schema))
    body = parts.where("NOT edge").drop("edge")
    ends = chunks.groupBy(*keys).agg(F.max("end_sample").alias("_end"))
    edge = (
        parts.where("edge")
        .groupBy(*keys, "offset_hz", "start_sample")
        .agg(F.sum(F.col("re")[0]).alias("r"), F.sum(F.col("im")[0]).alias("m"))
        .join(ends, keys)
        .where(F.col("start_sample") * decimation < F.col("_end"))
        .select(*keys, "offset_hz", "start_sample", F.array("r").alias("re"), F.array("m").alias("im"))
    )
    return body.unionByName(edge).select(
        *keys, "offset_hz", "start_sample",
        (F.col("start_sample") + F.size("re")).alias("end_sample"),
        (F.col("start_sample") * decimation).alias("wideband_sample"), "re", "im",
    )


# ------------------------------------------------------------ bit templates

# Training sequences, first bit first
TRAINING = {
    "normal_1": "1101000011101001110100",
    "normal_2": "0111101001000011011110",
    "normal_3": "1011011100000110101101",
    "extended": "100111010000111010011101000011",
    "sync": "11000001100111001110100111000001100111",
}
MAX_ERROR_FRACTION, GOOD_ERROR_FRACTION = 0.25, 0.18
HIT_SPACING = 32


CANDIDATE_OUT = (
    "name string, length int, best_errors int, best_offset int, candidates array<struct<s:int,p:int>>"
)


def _template_errors(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Differing bits of ``word`` at every offset of every row of the bit matrix ``x``."""
    count = x.shape[1] - len(word) + 1
    out = np.zeros((x.shape[0], count), np.uint8)
    for j, bit in enumerate(word):
        out += x[:, j : j + count] ^ bit
    return out


def training_candidates(
    df: DataFrame, keys: list[str], bits: str = "bits", keep_bits: bool = False, dealt: bool = False
) -> DataFrame:
    """Offsets where a sequence matches within a quarter of its bits and no neighbour
    matches better, per text and sequence; ranked by errors (s), then offset (p).

    ``keep_bits`` adds the text as ``bits``, so that what reads it later needs no join back.
    ``dealt`` says that the rows are spread over the tasks already."""
    words = {n: np.frombuffer(w.encode(), np.uint8) - 48 for n, w in TRAINING.items()}
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def of_length(part: pd.DataFrame, size: int):
        """Results of the texts of one length, compared all at once."""
        x = (np.frombuffer("".join(part["_bits"]).encode(), np.uint8) - 48).reshape(len(part), size)
        for name, word in words.items():
            out = part[keys].assign(name=name, length=len(word))
            if keep_bits:
                out["bits"] = part["_bits"]
            if size < len(word):
                yield out.assign(best_errors=len(word), best_offset=None, candidates=[[]] * len(part))
                continue
            e = _template_errors(x, word)
            wall = np.pad(e, ((0, 0), (1, 1)), constant_values=255)
            low = (e <= wall[:, :-2]) & (e <= wall[:, 2:]) & (e <= int(MAX_ERROR_FRACTION * len(word) + 1e-9))
            row, at = np.nonzero(low)
            order = np.lexsort((at, e[row, at], row))
            found = [{"s": int(s), "p": int(p) + 1} for s, p in zip(e[row, at][order], at[order], strict=True)]
            ends = np.cumsum(np.bincount(row, minlength=len(part)))
            lists = [found[i:j] for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
            yield out.assign(best_errors=e.min(axis=1), best_offset=e.argmin(axis=1) + 1, candidates=lists)

    def run(batches):
        for pdf in batches:
            for size, part in pdf.groupby(pdf["_bits"].str.len()):
                yield from of_length(part.reset_index(drop=True), int(size))

    rows = df.select(*keys, F.col(bits).alias("_bits"))
    out = f"{head}, {CANDIDATE_OUT}" + (", bits string" if keep_bits else "")
    return (rows if dealt else spread(rows, *keys)).mapInPandas(run, out)


def training_hits(df: DataFrame, keys: list[str], bits: str = "bits", most: int | None = None) -> DataFrame:
    """Training sequence hits at least 32 bits apart, best first.

    ``most`` keeps the best hits of each text and sequence; ``n_dropped`` tells how many
    others there were.
    """
    rows = training_candidates(df, keys, bits)
    rows = rows.withColumn("_all", greedy_positions(F.col("candidates"), HIT_SPACING))
    kept = F.col("_all") if most is None else F.slice("_all", 1, most)
    rows = rows.withColumn("_kept", kept).withColumn("n_dropped", F.size("_all") - F.size("_kept"))
    hits = rows.select(
        *keys, "name", "length", "n_dropped", F.explode(F.filter("candidates", lambda c: F.array_contains("_kept", c["p"]))).alias("c")
    )
    frac = F.col("c.s") / F.col("length")
    return hits.select(
        *keys, "name", "length", F.col("c.p").alias("bit_offset"), F.col("c.s").alias("errors"), frac.alias("error_fraction"),
        (frac <= MAX_ERROR_FRACTION).alias("is_candidate"), (frac <= GOOD_ERROR_FRACTION).alias("is_good"), "n_dropped",
    )


def training_score(df: DataFrame, keys: list[str], bits: str = "bits") -> DataFrame:
    """Per text: how well sequences match overall, and how many match well."""
    rows = training_candidates(df, keys, bits)
    frac = F.col("best_errors") / F.col("length")
    ok = frac <= MAX_ERROR_FRACTION
    return rows.groupBy(*keys).agg(
        F.sum(F.when(ok, (1 - frac) * F.col("length")).otherwise(0.0)).alias("score"),
        F.count_if(frac <= GOOD_ERROR_FRACTION).alias("good_count"),
        F.count_if(ok).alias("candidate_count"),
    )


# ------------------------------------------------------------ symbols

LEVELS = (-3.0, -1.0, 1.0, 3.0)


def symbol_phase(samples: DataFrame, keys: list[str], sps: int) -> DataFrame:
    """Sampling phase whose samples lie closest to the four levels (first on a tie).

    ``samples`` has keys, n (sample number) and y."""
    err = F.least(*[F.abs(F.col("y") - level) for level in LEVELS])
    by = [*keys, "phase"]
    rows = samples.select(*keys, (F.col("n") % sps).alias("phase"), err.alias("err"))
    q = grouped_quantiles(rows, by, "err", {"median_error": ("linear", 0.5)}, cell=0.05)
    return q.groupBy(*keys).agg(
        F.min_by("phase", F.struct("median_error", "phase")).alias("phase"), F.min("median_error").alias("median_error")
    )


def level_histogram(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples per decision interval of [-4, -2, 0, 2, 4]."""
    y = F.col("y")
    level = F.when(y == 4, 3).otherwise(F.floor((y + 4) / 2))
    return (
        samples.where((y >= -4) & (y <= 4)).groupBy(*keys, level.cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("samples"))
    )


def interp_linear(values: Column, pos: Column) -> Column:
    """Value at a fractional 0-based position; beyond the ends the last two points extend."""
    i = F.greatest(F.lit(0), F.least(F.size(values) - 2, F.floor(pos).cast("int")))
    frac = pos - F.floor(pos)
    return F.get(values, i) * (1 - frac) + F.get(values, i + 1) * frac


def frequency_error_stats(errors: DataFrame, keys: list[str], burst: str, cell: float = 1.0) -> DataFrame:
    """Median and largest |error_hz| per burst and, with a null burst, overall."""
    rows = errors.where(F.col("error_hz").isNotNull() & ~F.isnan("error_hz")).withColumn("_a", F.abs("error_hz"))
    per = grouped_quantiles(rows, [*keys, burst], "_a", {"median_abs_hz": ("linear", 0.5)}, cell)
    overall = grouped_quantiles(rows, keys, "_a", {"median_abs_hz": ("linear", 0.5)}, cell)
    largest = rows.groupBy(*keys, burst).agg(F.max("_a").alias("max_abs_hz"))
    top = rows.groupBy(*keys).agg(F.max("_a").alias("max_abs_hz"))
    return per.join(largest, [*keys, burst]).unionByName(overall.join(top, keys), allowMissingColumns=True)


def check_carriers(
    psd: DataFrame, manifest: DataFrame, keys: list[str], radius_hz: float = 120e3, guard_hz: float = 70e3,
    cell_db: float = 0.5,
) -> DataFrame:
    """Compare a spectrum with the carriers it should hold (``carrier_id``, ``offset_hz``):
    strongest bin near each, and its margin over the noise away from all of them."""
    near = interval_join(
        psd, manifest.withColumns({"_lo": F.col("offset_hz") - radius_hz, "_hi": F.col("offset_hz") + radius_hz}),
        keys, "freq_hz", "_lo", "_hi", 2 * radius_hz, closed_end=True,
    )
    peaks = near.groupBy(*keys, "carrier_id", "offset_hz").agg(
        F.max("power").alias("peak_power"),
        F.max_by("freq_hz", F.struct(F.col("power"), -F.col("freq_hz"))).alias("peak_hz"),
    )
    guarded = interval_join(
        psd.select(*keys, "bin", "freq_hz"),
        manifest.select(*keys, (F.col("offset_hz") - guard_hz).alias("_lo"), (F.col("offset_hz") + guard_hz).alias("_hi")),
        keys, "freq_hz", "_lo", "_hi", 2 * guard_hz, closed_end=True,
    ).select(*keys, "bin").distinct()
    noise = psd.join(guarded, [*keys, "bin"], "left_anti").groupBy(*keys).agg(F.median("power").alias("noise_power"))
    tiny = F.lit(2.2250738585072014e-308)
    return peaks.join(noise, keys).withColumn(
        "margin_db",
        F.lit(10.0) * F.log10(F.greatest("peak_power", tiny) / F.greatest("noise_power", tiny)),
    )
