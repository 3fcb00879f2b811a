"""Quality rules by distribution divergence, in DataFrame functions only.

Each text has a histogram of character classes and one of the common words of its language.  Both
are compared by Jensen-Shannon distance (base 2, from 0 to 1) with the histograms of the whole
language: the sums over all its texts that pass the base rules and are not far from the sums
over all.  Texts too short for a histogram to mean anything are not judged by it, nor are texts of
no language or of one with too few texts for a reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.session import persist_table

# fixed values: common words by language; other languages are compared by characters alone
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are with as be by at from or this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo".split(),
}
# fixed values: patterns of the character classes; "other" is the rest
CLASSES = {
    "lower": "[a-z]+",
    "space": r"[\x20\x09-\x0D]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "stop": "[.,;:!?'\"()-]+",
    "symbol": "[#*$%&|<>@^~_=+/\\\\\\[\\]{}`]+",
}
CHARS = [*CLASSES, "other"]
N_WORDS = 21
WORD_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), "")


def window_hashes(words: Column, size: int = 5) -> Column:
    """Hash of every window of ``size`` consecutive words, in order."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))
        )

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column, size: int = 5) -> Column:
    """Number of words that lie in windows of ``size`` words found twice or more.

    Each window's hash is shifted to make room for its place; after sorting, equal windows are
    neighbours.  The places of those are sorted again and their stretches added up.  Texts in
    which no window repeats, most of them, are told by their distinct windows alone.
    """

    def repeats(keys: Column, bits: Column) -> Column:
        """Keys that share their hash with a neighbour."""
        head = F.transform(keys, lambda x: F.call_function("shiftright", x, bits))
        return let(
            head,
            lambda g: F.filter(
                keys,
                lambda x, j: F.coalesce(F.get(g, j) == F.get(g, j - 1), F.lit(False))
                | F.coalesce(F.get(g, j) == F.get(g, j + 1), F.lit(False)),
            ),
        )

    def covered(bits: Column) -> Column:
        keys = F.transform(
            windows, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("bigint"))
        )
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        places = let(
            F.sort_array(keys), lambda k: let(low, lambda m: F.transform(repeats(k, bits), lambda x: x.bitwiseAND(m)))
        )
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + size - F.greatest(acc["end"], p)).alias("n"), (p + size).alias("end")
            ),
            lambda acc: acc["n"],
        )

    counted = let(F.length(F.bin(F.size(windows).cast("bigint"))), covered)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base figures, and both histograms (arrays chars and common)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.select("*", F.inline(F.array(F.struct(words_of(F.col("text")).alias("words")))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    listed = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    common = let(
        F.filter("words", lambda w: w.isin(every)),
        lambda found: F.transform(listed, lambda r: F.size(F.filter(found, lambda w: w == r)).cast("bigint")),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("windows"),
        common.alias("common"),
        F.col("text").alias("left"),
    )
    # the classes are taken out one after the other, so that later ones see what is left
    figures = ["doc_id", "lang", "n_words", "n_chars", "n_dup_lines", "windows", "common"]
    for name, pattern in CLASSES.items():
        bare = F.regexp_replace("left", pattern, "")
        rows = rows.select(*figures, F.col("left"), bare.alias("bare"))
        count = (F.length("left") - F.length("bare")).cast("bigint").alias(name)
        extra = []
        if name == "symbol":
            symbols = F.length("left") - F.length(F.regexp_replace("left", "[#*$%&|<>]+", ""))
            extra = [symbols.cast("bigint").alias("n_symbols")]
        rows = rows.select(*figures, count, *extra, F.col("bare").alias("left"))
        figures += [name, *(["n_symbols"] if extra else [])]
    rest = F.col("n_words") - F.aggregate("common", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = rows.select(
        "doc_id",
        "lang",
        "n_words",
        "n_chars",
        (F.col("n_chars") - F.col("space")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.array(*CLASSES, F.length("left").cast("bigint")).alias("chars"),
        F.concat("common", F.array(rest)).alias("common"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def distance(p: Column, q: Column, n: int) -> Column:
    """Jensen-Shannon distance of two histograms of ``n`` counts; null where one is null or empty."""

    def total(h: Column) -> Column:
        return sum((h[i] for i in range(1, n)), h[0])

    def terms(x: Column, y: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

        return sum((part(x[i], y[i]) + part(y[i], x[i]) for i in range(n)), F.lit(0.0))

    def shares(h: Column) -> Column:
        return let(F.nullif(total(h), F.lit(0)), lambda t: F.transform(h, lambda v: v / t))

    apart = let(F.struct(shares(p).alias("p"), shares(q).alias("q")), lambda s: terms(s["p"], s["q"]) / 2)
    both = (total(p) > 0) & (total(q) > 0)
    return F.when(both, F.sqrt(F.greatest(F.lit(0.0), apart)))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_chars: float = 0.17,
    first_chars: float = 0.2,
    max_words: float = 0.6,
    min_chars: int = 400,
    min_words: int = 50,
    min_texts: int = 30,
    max_broadcast: int = 10_000,
) -> DataFrame:
    """A row for each row: the base figures, char_distance, word_distance and kept.

    A text is kept if it passes the base rules (10 words or more, at most a fifth of them in
    repeated windows) and neither distance that applies exceeds its limit: characters from
    ``min_chars`` on, common words from ``min_words`` on.  A null text is empty.  A null language
    or one without a list of words has no word_distance.  A null or empty language, or one without
    a list that has fewer than ``min_texts`` texts that pass the base rules, is compared with the
    sums over all texts; that char_distance is shown and rejects nothing.  Up to ``max_broadcast``
    languages are broadcast; more are joined by shuffle.
    """
    rows = persist_table(measures(docs, id_col, text_col, lang_col), "measures")

    def odd(by: Column, least: int, size: str, most: float) -> Column:
        return F.coalesce((F.col(size) >= least) & (by > most), F.lit(False))

    def odd_chars(most: float) -> Column:
        return F.col("own") & odd(F.col("char_distance"), min_chars, "n_chars", most)

    def compared(sums: DataFrame) -> DataFrame:
        sums = persist_table(sums, "references")
        own = sums.where((F.col("ref") != "") & (F.col("ref").isin(list(COMMON_WORDS)) | (F.col("n_texts") >= min_texts)))
        own = F.broadcast(own.drop("n_texts")) if own.count() <= max_broadcast else own.drop("n_texts")
        whole = sums.agg(_sums("ref_chars", len(CHARS)).alias("all_chars")).select(F.lit(False).alias("is_own"), "all_chars")
        joined = rows.join(own, F.col("lang") == F.col("ref"), "left").withColumn("own", F.col("ref").isNotNull())
        joined = joined.join(F.broadcast(whole), F.col("own") == F.col("is_own"), "left")
        by_chars = distance(F.col("chars"), F.coalesce("ref_chars", "all_chars"), len(CHARS))
        by_words = distance(F.col("common"), F.col("ref_common"), N_WORDS + 1)
        joined = joined.withColumn("char_distance", by_chars).withColumn("word_distance", by_words)
        return joined.drop("ref", "ref_chars", "ref_common", "is_own", "all_chars")

    # the second references leave out what is far from the first ones
    first = compared(_references(rows.where("NOT base_failed")))
    judged = compared(_references(first.where(~F.col("base_failed") & ~odd_chars(first_chars))))
    far = odd_chars(max_chars) | odd(F.col("word_distance"), min_words, "n_words", max_words)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("chars", "common", "own")


def _sums(name: str, n: int) -> Column:
    return F.array(*(F.coalesce(F.sum(F.col(name)[i]), F.lit(0)) for i in range(n)))


def _references(good: DataFrame) -> DataFrame:
    """(ref, ref_chars, ref_common, n_texts): a row for each language, "" for none."""
    return good.groupBy(F.coalesce("lang", F.lit("")).alias("ref")).agg(
        _sums("chars", len(CHARS)).alias("ref_chars"),
        _sums("common", N_WORDS + 1).alias("ref_common"),
        F.count(F.lit(1)).alias("n_texts"),
    )
