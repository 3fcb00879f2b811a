"""Near-duplicate groups by b-bit MinHash.

Texts with equal shingle sets form one class from the start.  Each class has 128 minima: bands of
five full minima give candidates, and of every minimum only the low bits are kept, as bit planes
packed in 64-bit integers.  Two signatures are compared by counting the bits in which no plane
differs, corrected for minima that agree in their low bits by chance.

Links are found in three steps, each of which looks only where classes are still apart: every
class against the likeliest of the representatives (smallest keys) of its buckets; then against the
best one in each other group; then, in buckets that still hold several groups, all pairs across groups in
bounded blocks.  Pairs whose estimate is far below the threshold are left out, all others are
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.chunks import split_at
from radiolake.llm.components import connected
from radiolake.llm.words import slabs
from radiolake.session import persist_table

HASHES = 128
ROWS = 5  # minima in a band
BANDS = HASHES // ROWS
BITS = 4
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NO_BREAKS = np.zeros((256, 256), dtype=bool)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, flat, and their number by text.

    Words are runs between white space, A-Z in lower case; with fewer words than ``words``, but
    not none, all of them are one shingle.
    """
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    tokens, counts = split_at(texts, _NO_BREAKS, drop=_SPACE)
    if not len(tokens):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    coded = tokens.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    hashed = own[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    place = np.arange(len(hashed))
    left = np.repeat(ends, counts) - place  # words from here to the end of the text
    keep = (left >= words) | (np.repeat(ends - counts, counts) == place)
    row, at, left = np.repeat(np.arange(len(counts)), counts)[keep], place[keep], left[keep]
    value = np.minimum(left, words).astype(np.uint64)
    padded = np.r_[hashed, np.zeros(words, dtype=np.uint64)]
    for k in range(words):
        value = np.where(left > k, _mixed(value * _MIX + padded[at + k]), value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.bincount(row[fresh], minlength=len(counts))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    draw = lambda: rng.integers(0, 1 << 63, size=HASHES, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, HASHES) smallest hashes of consecutive non-empty sets, 32 bits each."""
    factor, offset = _factors()
    out = np.empty((len(starts), HASHES), dtype=np.uint64)
    scratch = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, factor[k], out=scratch)
        scratch += offset[k]
        scratch >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(scratch, starts)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Bit planes of the low ``BITS`` bits of minima: (sets, BITS * HASHES / 64) integers."""
    planes = [np.packbits((low >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(BITS)]
    return np.concatenate(planes, axis=1)


def corrected(agree):
    """Similarity from the number of minima whose low bits agree: works on numbers, arrays and columns."""
    chance = 2.0**-BITS
    return (agree * (1.0 / HASHES) - chance) * (1.0 / (1 - chance))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the number of agreeing minima between two tables of packed signatures."""
    half = HASHES // 64
    agree = np.full((len(a), len(b)), HASHES, dtype=np.int64)
    for w in range(half):
        differ = np.zeros((len(a), len(b)), dtype=np.uint64)
        for plane in range(BITS):
            differ |= a[:, None, plane * half + w] ^ b[None, :, plane * half + w]
        agree -= np.bitwise_count(differ)
    return agree


def _agreement_column(a: str, b: str):
    half = HASHES // 64
    differ = [
        "bit_count(" + " | ".join(f"({a}[{p * half + w}] ^ {b}[{p * half + w}])" for p in range(BITS)) + ")"
        for w in range(half)
    ]
    return F.expr(f"{HASHES} - ({' + '.join(differ)})")


_SIGNED = "doc_id bigint, th bigint, key binary, n int, bands array<bigint>, planes array<bigint>"
_SIGNED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.binary()), ("n", pa.int32())]
    + [(c, pa.list_(pa.int64())) for c in ("bands", "planes")]
)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    flat = np.ascontiguousarray(rows).ravel().view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column("text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                values, counts = shingles(part.column("text"), words)
                full = np.flatnonzero(counts)
                bounds = np.r_[0, np.cumsum(counts)]
                bands = np.zeros((len(counts), BANDS), dtype=np.uint64)
                planes = np.zeros((len(counts), BITS * HASHES // 64), dtype=np.uint64)
                if len(full):
                    low = minima(values, bounds[:-1][full])
                    planes[full] = pack(low)
                    for band in range(BANDS):
                        h = np.full(len(full), np.uint64(band + 1))
                        for k in range(band * ROWS, (band + 1) * ROWS):
                            h = _mixed(h * _MIX + low[:, k])
                        bands[full, band] = h
                keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("th"),
                        pa.array(keys, pa.binary()),
                        pa.array(counts.astype(np.int32)),
                        _lists(bands),
                        _lists(planes),
                    ],
                    schema=_SIGNED_ARROW,
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column("text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                values, counts = shingles(part.column("text"), words)
                ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), sets], names=["key", "shingles"])

    return run


def _near(threshold: int, cut: float):
    """Classes of one unit that have a likely partner in another group (and, in a unit of two
    blocks, in the other block)."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.take(pa.array(order)), bucket[order]
        group = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        n = rows.column("n").to_numpy().astype(np.int64)
        block = rows.column("block").to_numpy()
        planes = rows.column("planes").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        cross = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
        keep = np.zeros(len(rows), dtype=bool)
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            likely = corrected(agreement(planes[a:b], planes[a:b])) >= cut
            likely &= group[a:b, None] != group[None, a:b]
            likely &= 100 * np.minimum(n[a:b, None], n[None, a:b]) >= threshold * np.maximum(n[a:b, None], n[None, a:b])
            if cross:
                likely &= block[a:b, None] != block[None, a:b]
            keep[a:b] = likely.any(axis=1)
        at = pa.array(np.flatnonzero(keep))
        return rows.select(["bucket", "key", "component", "block", "lo", "hi", "n"]).take(at)

    return run


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _confirm(threshold: int):
    """Spanning links of one unit: pairs of different groups confirmed on their full sets."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket").to_pylist()
        order = np.argsort(np.array(bucket, dtype=np.int64), kind="stable")
        rows = rows.take(pa.array(order))
        bucket = rows.column("bucket").to_numpy()
        keys, group = rows.column("key").to_pylist(), rows.column("component").to_pylist()
        block = rows.column("block").to_numpy()
        cross = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
        lists = rows.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(rows.column("n").to_numpy().astype(np.int64))]
        out: list[tuple[bytes, bytes]] = []
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            root = {g: g for g in group[a:b]}

            def find(g, root=root):
                while root[g] != g:
                    root[g] = root[root[g]]
                    g = root[g]
                return g

            # the rows that hold each shingle, by shingle
            values = flat[ends[a] : ends[b]]
            owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            by = np.argsort(values, kind="stable")
            values, owner = values[by], owner[by]
            sizes = np.diff(ends[a : b + 1])
            firsts = np.searchsorted(values, values, side="left")
            lasts = np.searchsorted(values, values, side="right")
            place = np.argsort(owner, kind="stable")
            at = np.r_[0, np.cumsum(sizes)]
            for i in range(b - a):
                own = place[at[i] : at[i + 1]]
                spans = lasts[own] - firsts[own]
                pick = np.repeat(firsts[own] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
                both = np.bincount(owner[pick], minlength=b - a)
                linked = 100 * both >= threshold * (sizes[i] + sizes - both)
                for j in np.flatnonzero(linked).tolist():
                    if j == i or (cross and block[a + i] == block[a + j]):
                        continue
                    x, y = find(group[a + i]), find(group[a + j])
                    if x != y:
                        root[y] = x
                        out.append((keys[a + i], keys[a + j]))
        return pa.table([[x for x, _ in out], [y for _, y in out]], schema=_EDGES)

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    percent: int = 85,
    margin: float = 0.2,
    block_sets: int = 512,
    block_shingles: int = 500_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two texts are linked if 100 times the shingles they share is at least ``percent`` times those of
    either; component_id is the smallest doc_id that links reach, kept marks doc_id =
    component_id.  A text without words (or null) has no shingles and is linked with nothing.
    Null ids are not compared: such a row has the smallest other id of its group (null if there is
    none).  Rows that share an id are separate texts.

    A pair right at 85 % shares no band with chance 4e-7, and its estimate is ``margin`` too low
    (five standard deviations) with chance 1e-6 or less.  A bucket of thousands of different
    texts that are not linked costs a comparison of 64-byte signatures for each of its pairs, in
    blocks of ``block_sets``; only texts with a likely partner outside their group are read again there.
    """
    cut = percent / 100 - margin
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text")
    )
    signed = persist_table(texts.mapInArrow(_sign(words), _SIGNED), "signed")
    classes = persist_table(
        signed.where("n > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct("doc_id", "th")).alias("first"),
            F.min("doc_id").alias("least"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
            F.first("planes").alias("planes"),
        ),
        "classes",
    )
    banded = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    shared = (
        banded.groupBy("band", "hash").agg(F.min("key").alias("rep"), F.max("key").alias("last")).where("rep <> last")
    )
    members = persist_table(banded.join(shared.drop("last"), ["band", "hash"]), "members")
    stars = members.where("key <> rep").groupBy("key", "rep").agg(F.count("*").alias("n_bands"))
    side = lambda x: classes.select(F.col("key").alias(x), F.col("planes").alias(f"{x}_planes"), F.col("n").alias(f"{x}_n"))
    likely = (
        stars.join(side("key"), "key")
        .join(side("rep"), "rep")
        .withColumn("likeness", corrected(_agreement_column("key_planes", "rep_planes")))
        .where(F.col("likeness") >= cut)
        .where(100 * F.least("key_n", "rep_n") >= percent * F.greatest("key_n", "rep_n"))
        .select("key", "rep", "likeness")
    )
    likely = persist_table(likely, "likely")
    # full sets of the classes that share a bucket, and of no others
    involved = members.select("key").distinct().join(classes.select("key", "first"), "key").select(
        "key", F.col("first.doc_id").alias("__doc"), F.col("first.th").alias("__th")
    )
    read = texts.join(involved, texts["doc_id"].eqNullSafe(F.col("__doc")) & (texts["th"] == F.col("__th")))
    sets = read.select("key", "text").mapInArrow(_full_sets(words), "key binary, shingles array<bigint>")
    sets = persist_table(sets.dropDuplicates(["key"]), "full-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        own = sets.select("key", F.col("shingles").alias("own"))
        other = sets.select(F.col("key").alias("rep"), F.col("shingles").alias("other"))
        both = F.size(F.array_intersect("own", "other"))
        linked = 100 * both >= percent * (F.size("own") + F.size("other") - both)
        return pairs.join(own, "key").join(other, "rep").where(linked).select(F.col("key").alias("a"), F.col("rep").alias("b"))

    def best(pairs: DataFrame, *by: str) -> DataFrame:
        return pairs.groupBy(*by).agg(F.max_by("rep", F.struct("likeness", "rep")).alias("rep")).select("key", "rep")

    links = persist_table(confirmed(best(likely, "key")), "links")
    groups = connected(links)
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_group"))
    grouped = lambda df, x: df.join(of(x), x, "left").withColumn(f"{x}_group", F.coalesce(f"{x}_group", x))
    apart = grouped(grouped(likely, "key"), "rep").where("key_group <> rep_group")
    more = persist_table(confirmed(best(apart, "key", "rep_group")), "links")
    if more.head(1):
        links = links.union(more)
        groups = connected(links)

    # buckets that still hold several groups; equal buckets of several bands count once
    placed = grouped(members, "key").withColumnRenamed("key_group", "component")
    placed = persist_table(placed.join(classes.select("key", "n", "planes"), "key"), "placed")
    split = (
        placed.groupBy("band", "hash")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("sets"),
            F.sum(F.col("n").cast("bigint")).alias("mass"),
            F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("content"),
            F.bit_xor(F.xxhash64("key", F.lit(7))).alias("content2"),
        )
        .where("low <> high")
        .groupBy("content", "content2", "sets", "mass")
        .agg(F.min(F.struct("band", "hash")).alias("at"))
    )
    blocks = F.greatest(F.ceil(F.col("sets") / F.lit(block_sets)), F.ceil(F.col("mass") / F.lit(block_shingles)))
    split = persist_table(
        split.select(
            "at.band", "at.hash", "mass", blocks.alias("blocks"), F.xxhash64("at.band", "at.hash").alias("bucket")
        ),
        "split-buckets",
    )
    small = split.where("blocks = 1").agg(F.sum("mass")).first()[0] or 0
    bins = F.lit(1 + small // (2 * block_shingles))
    units = (
        placed.join(split, ["band", "hash"])
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "bucket", "key", "component", "n", "planes", "block",
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), bins)).otherwise(F.col("bucket")).alias("unit"),
            F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        )
    )
    near_schema = "bucket bigint, key binary, component binary, block bigint, lo bigint, hi bigint, n int"
    near = persist_table(units.groupBy("unit", "lo", "hi").applyInArrow(_near(percent, cut), near_schema), "near")
    bin_of = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(1 + (near.agg(F.sum("n")).first()[0] or 0) // (2 * block_shingles)))
    rest = (
        near.join(sets, "key")
        .withColumn("bin", bin_of)
        .groupBy("bin", F.expr("CASE WHEN lo <> hi THEN bucket END").alias("own"), "lo", "hi")
        .applyInArrow(_confirm(percent), "a binary, b binary")
    )
    rest = persist_table(rest, "links")
    if rest.head(1):
        links = links.union(rest)
        groups = connected(links)

    placed = classes.select("key", "least").join(groups.withColumnRenamed("node", "key"), "key", "left")
    placed = persist_table(placed.withColumn("component", F.coalesce("component", "key")), "grouped")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").select("key", "component_id")
    rows = signed.select("doc_id", "key", F.col("n").cast("bigint").alias("n_shingles"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    full = rows.where("n_shingles > 0").join(placed, "key").select("doc_id", "n_shingles", "component_id", kept)
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return full.union(empty)


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id, min(other) = d.doc_id AS kept
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN sized ON sized.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""
