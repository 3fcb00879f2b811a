"""Named queries of the subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import (
    bbit,
    contamination,
    divergence,
    forest,
    htmltext,
    interaction,
    licenses,
    pieces,
    quality,
    quotes,
    repeats,
    tokens,
    toxicity,
)
from radiolake.llm.checks import license_sql, quality_sql, reply_sql
from radiolake.llm.tables import small_batches, table
from radiolake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


END_ID = 2


@query("op1_token_blocks")
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as coded blocks and read back."""
    path = scratch_path(spark, "token-blocks")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_pieces")
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document by the merge agenda, and the text they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, path, decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


@query("op3_license_scan", license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that each document, or a line of it, is by canonical digest."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.known_digests(spark), small=True).select(
        "doc_id", "whole_license", F.array_join("license_ids", ",").alias("license_ids"), "n_lines"
    )


_OP4_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_OP4_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_OP4_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in ten-word windows of benchmark items."""
    index = contamination.build_index(table(spark, sf_dir, "documents"))
    matches = contamination.phrase_matches(index, table(spark, sf_dir, "benchmark"), size=10)
    return contamination.contamination(index, matches).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by tag-path ratios."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the sentences that earlier documents hold in runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs)


@query("op7_reply_order", reply_sql())
def op7_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with its parent and its place in reply order."""
    messages = table(spark, sf_dir, "conversations")
    return quotes.reply_order(messages).withColumn("reply_path", F.array_join(F.col("reply_path").cast("array<string>"), "/"))


@query("op8_quality_rules", quality_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of each document by distribution divergence."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("char_distance", 9).alias("char_distance"),
        F.round("word_distance", 9).alias("word_distance"),
    )


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document at Jaccard similarity 0.8 of word 5-grams."""
    return forest.similarity_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "n_texts", "kept"
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document by the clause grammar, fitted on the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op11_bbit_dedup", bbit.NEAR_SQL)
def op11_bbit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of each document at Jaccard similarity 0.85 of word 3-grams."""
    return bbit.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_source_divergence", divergence.DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source differs from the others of its language, and in which terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op13_filter_interaction", interaction.FILTER_SQL)
def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in all 120 orders."""
    cells = interaction.failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction.order_steps(cells)
