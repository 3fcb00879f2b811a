"""Comparing PDU sets: signatures, multiset differences, verdicts per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.fields import field, has_path
from radiolake.functions.keys import CCH_FIELDS

# Fields of ``extra`` that identify a PDU, numbers and texts
SIGNATURE_NUMBERS = [
    "nac", "duid", "tgid", "hdu_mfid", "algid", "kid", "hdu_tgid", "lco", "mfid", "svc", "lc_info", "es_algid", "es_kid",
    "color_code", "stable_color_code", "stable_color_repeats", "communication_mode", "comms_format", "emergency_priority",
    "slot_number", "frame_number",
]
SIGNATURE_TEXTS = [
    "duid_name", "pdu_type", "frame_category", "call_type", "sync_type", "superframe_part", "closed_by",
]


def signature(df: DataFrame) -> Column:
    """JSON text of what makes a PDU the same PDU; absent and null fields are left out."""
    num = lambda p: field(df, p, "bigint")
    txt = lambda p: field(df, p, "string")

    def ident(name: str) -> Column:
        return F.coalesce(num(f"{name}_num").cast("string"), txt(name), F.lit("0"))

    extra = [num(f"extra.{n}").alias(n) for n in SIGNATURE_NUMBERS] + [txt(f"extra.{n}").alias(n) for n in SIGNATURE_TEXTS]
    if has_path(df.schema, "extra.cch"):
        one = F.transform("extra.cch", lambda r: F.struct(*[r[f].cast("bigint").alias(f) for f in CCH_FIELDS]))
        extra.append(F.when(F.size("extra.cch") > 0, one).alias("cch_signature"))
    present = [c for c, n in zip(extra, [*SIGNATURE_NUMBERS, *SIGNATURE_TEXTS], strict=False) if has_path(df.schema, f"extra.{n}")]
    if len(extra) > len(SIGNATURE_NUMBERS) + len(SIGNATURE_TEXTS):
        present.append(extra[-1])
    return F.to_json(
        F.struct(
            F.coalesce(txt("protocol"), F.lit("DMR")).alias("protocol"), F.coalesce(txt("type"), F.lit("")).alias("type"),
            ident("src").alias("src"), ident("dst").alias("dst"), num("ts").alias("ts"),
            F.coalesce(txt("flco"), F.lit("")).alias("flco"), F.coalesce(txt("fid"), F.lit("")).alias("fid"),
            *([F.struct(*present).alias("extra")] if present else []),
        )
    )


def multiset_diff(expected: DataFrame, actual: DataFrame, by: list[str], sig: str = "signature") -> DataFrame:
    """Per signature how often it is missing from ``actual`` and how often unexpected.

    Both sides are counted in one pass; equal counts cancel and yield no row."""
    side = lambda df, one: df.select(*by, sig, F.lit(one).alias("_d"))
    both = side(expected, 1).unionByName(side(actual, -1))
    d = both.groupBy(*by, sig).agg(F.sum("_d").alias("_d")).where(F.col("_d") != 0)
    zero = F.lit(0).cast("bigint")
    return d.select(
        *by, sig, F.greatest(zero, F.col("_d")).alias("missing"), F.greatest(zero, -F.col("_d")).alias("unexpected")
    )


def differing_rows(diff: DataFrame, by: list[str], sig: str = "signature") -> DataFrame:
    """One row per missing or unexpected PDU."""

    def repeat(col: str, kind: str) -> DataFrame:
        rows = diff.where(F.col(col) > 0).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(col))))
        return rows.select(*by, sig, F.lit(kind).alias("kind"))

    return repeat("missing", "missing").unionByName(repeat("unexpected", "unexpected"))


def sample_verdicts(
    samples: DataFrame, expected: DataFrame, actual: DataFrame, by: list[str] = ("sample",), examples: int = 5
) -> DataFrame:
    """Verdict per sample: counts, the first few differing signatures, and samples skipped.

    ``samples`` lists every sample with has_golden and has_input.
    """
    by = list(by)
    diff = multiset_diff(expected, actual, by)
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    totals = diff.groupBy(*by).agg(F.sum("missing").alias("missing_count"), F.sum("unexpected").alias("unexpected_count"))
    out = samples.join(count(expected, "expected_count"), by, "left").join(count(actual, "actual_count"), by, "left")
    out = out.join(totals, by, "left")
    none = F.array().cast("array<string>")
    for col in ("missing", "unexpected"):
        w = Window.partitionBy(*by).orderBy("signature")
        top = diff.where(F.col(col) > 0).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= examples)
        listed = top.groupBy(*by).agg(
            F.slice(
                F.flatten(
                    F.transform(
                        F.sort_array(F.collect_list(F.struct("signature", F.least(F.lit(examples), col).cast("int").alias("n")))),
                        lambda s: F.array_repeat(s["signature"], s["n"]),
                    )
                ),
                1,
                examples,
            ).alias(f"{col}_examples")
        )
        out = out.join(listed, by, "left").withColumn(f"{col}_examples", F.coalesce(f"{col}_examples", none))
    out = out.fillna(0, ["expected_count", "actual_count", "missing_count", "unexpected_count"])
    reason = F.when(~F.col("has_golden"), "missing golden JSON").when(~F.col("has_input"), "missing sample file").otherwise("")
    ok = (F.col("missing_count") == 0) & (F.col("unexpected_count") == 0) & (reason == "")
    return out.withColumns({"reason": reason, "skipped": reason != "", "ok": ok})


def overall(verdicts: DataFrame) -> DataFrame:
    bad = ~F.col("ok") & ~F.col("skipped")
    return verdicts.agg(
        F.min(F.col("ok") | F.col("skipped")).alias("ok"),
        F.count_if(bad).alias("mismatch_count"),
        F.count_if("skipped").alias("skipped_count"),
    )


def schedule_parity(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows two schedules of the same input disagree on; empty when they are equivalent."""
    pack = lambda df: df.select(F.to_json(F.struct(*columns)).alias("signature"))
    return differing_rows(multiset_diff(pack(a), pack(b), []), [])


def parity_report(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Every distinct row of two schedules of the same input: how often each has it (``n_first``,
    ``n_second``), and whether they agree.  Rows are compared with nulls equal."""
    first = a.select(*columns, F.lit(1).alias("_1"), F.lit(0).alias("_2"))
    second = b.select(*columns, F.lit(0).alias("_1"), F.lit(1).alias("_2"))
    out = first.unionByName(second).groupBy(*columns).agg(F.sum("_1").alias("n_first"), F.sum("_2").alias("n_second"))
    return out.withColumn("agrees", F.col("n_first") == F.col("n_second"))
