"""Conversations in reply order by quotation linking, in DataFrame functions only.

Lines that start with quote marks are parsed into levels; consecutive lines of one level are a
passage.  Passages, their paragraphs and their lines are normalised, hashed and joined to the
earlier messages of the conversation that hold the same text of their own: as a whole, a
paragraph or a line.  The message that shares most quoted words at the lowest level is the
parent.  Paths from the root are built by doubling, and sort the messages of a conversation in
reply order.

Texts that few messages hold are joined to all their holders.  For frequent ones, messages that
quote the same set of them share one list of scored holders, and the best holder before a
message is a running maximum over that list; a holder that a rare text names looks up its score
there.  The result is that of scoring every holder.  No window or list goes over a conversation:
the running maximum is a blockwise scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.ordered import before, scan
from radiolake.session import persist_table

_MARKS = r"^\s{0,3}(?:>\s?)+"
_QUOTED = r"(?m)^\s{0,3}>"
_ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)\b.{0,60}:\s*$"


def quote_level(line: Column) -> Column:
    """Number of quote marks in front of a line."""
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def unquoted_line(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def normal(text: Column) -> Column:
    """Lower-case words with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _n_words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("bigint")


def own_text(text: Column) -> Column:
    """The message without quoted lines and the attribution lines in front of them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def own(line: Column, i: Column) -> Column:
        after = F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(_QUOTED)
        return ~line.rlike(_QUOTED) & ~(after & line.rlike(_ATTRIBUTION))

    bare = F.btrim(F.array_join(F.filter(lines, own), "\n"), F.lit(" \t\r\n"))
    return F.when(F.coalesce(text, F.lit("")).rlike(_QUOTED), bare).otherwise(F.coalesce(text, F.lit("")))


def _hashed(rows: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """(keys, h1, h2, words) of the non-empty normalised parts of each row."""
    return (
        rows.select(*keys, F.explode(parts).alias("_part"))
        .select(*keys, normal(F.col("_part")).alias("_part"))
        .where("_part <> ''")
        .select(*keys, F.sha2("_part", 256).alias("h"), _n_words(F.col("_part")).alias("words"))
    )


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, th, level, passage, text) of each run of lines of one quote level.

    ``messages`` has conv_id, turn, th and text.
    """
    message = ["conv_id", "turn", "th"]
    lines = (
        messages.where(F.col("text").rlike(_QUOTED))
        .dropDuplicates(message)
        .select(*message, F.posexplode(F.split("text", "\n")).alias("i", "line"))
        .select(*message, "i", quote_level(F.col("line")).alias("level"), unquoted_line(F.col("line")).alias("line"))
        .where("level > 0")
    )
    # within a run of one level, line numbers and ranks grow alike
    rank = F.row_number().over(Window.partitionBy(*message, "level").orderBy("i"))
    return (
        lines.withColumn("run", F.col("i") - rank)
        .groupBy(*message, "level", "run")
        .agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("lines"))
        .select(*message, "level", F.col("lines.i")[0].alias("passage"), F.array_join(F.col("lines.line"), "\n").alias("text"))
    )


def _parts(text: Column) -> Column:
    """The whole text, its paragraphs and its lines."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n")))


def quote_links(messages: DataFrame, often: int = 32) -> DataFrame:
    """(conv_id, turn, th, level, parent_turn, words, first_words): earlier messages a message quotes.

    words counts the quoted words that parent_turn holds, first_words those that no message
    before it holds.  Every holder of a text that at most ``often`` messages hold is listed, and the
    best one of all (words, first_words, later turn) always is; ``often`` changes the work alone.
    """
    body = messages.select("conv_id", "turn", own_text(F.col("text")).alias("text"))
    units = _hashed(body.where("turn IS NOT NULL"), ["conv_id", "turn"], _parts(F.col("text")))
    units = persist_table(units.select("conv_id", "turn", "h").distinct(), "units")
    held = units.withColumnRenamed("turn", "parent_turn")
    holders = units.groupBy("conv_id", "h").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n"))
    level = ["conv_id", "turn", "th", "level"]
    quoted = _hashed(quoted_passages(messages), level, _parts(F.col("text")))
    quoted = quoted.groupBy(*level, "h").agg(F.sum("words").alias("words"))
    matched = quoted.join(holders, ["conv_id", "h"]).where(F.col("first") < F.col("turn"))
    matched = persist_table(matched.withColumn("hot", F.col("n") > often).drop("n"), "matched")
    scores = [
        F.sum("words").alias("words"),
        F.sum(F.when(F.col("parent_turn") == F.col("first"), F.col("words")).otherwise(0)).alias("first_words"),
    ]

    rare = matched.where("NOT hot").join(held, ["conv_id", "h"]).where(F.col("parent_turn") < F.col("turn"))
    named = rare.groupBy(*level, "parent_turn").agg(*scores)
    frequent = matched.where("hot")
    if not frequent.head(1):
        return named

    # messages with the same frequent texts share the scores of all that hold any of them
    texts = F.sort_array(F.collect_list(F.struct("h", "words", "first")))
    sets = frequent.groupBy(*level).agg(texts.alias("texts"))
    sets = persist_table(sets.withColumn("set_id", F.sha2(F.to_json("texts"), 256)), "quoted-sets")
    each = sets.groupBy("conv_id", "set_id").agg(F.any_value("texts").alias("texts"))
    each = each.select("conv_id", "set_id", F.inline("texts"))
    scored = each.join(held, ["conv_id", "h"]).groupBy("conv_id", "set_id", "parent_turn").agg(*scores)
    scored = persist_table(scored, "set-scores")
    sets = sets.drop("texts")

    more = scored.withColumnsRenamed({"words": "_words", "first_words": "_first"})
    both = named.join(sets, level, "left").join(more, ["conv_id", "set_id", "parent_turn"], "left")
    both = both.select(
        *level,
        "parent_turn",
        (F.col("words") + F.coalesce("_words", F.lit(0))).alias("words"),
        (F.col("first_words") + F.coalesce("_first", F.lit(0))).alias("first_words"),
    )

    item = F.struct("words", "first_words", "parent_turn")
    asked = sets.select("conv_id", "set_id", F.col("turn").alias("at")).distinct()
    line = scored.select("conv_id", "set_id", F.col("parent_turn").alias("at"), F.lit(1).alias("holds"), item.alias("item"))
    line = line.unionByName(asked.withColumn("holds", F.lit(0)), allowMissingColumns=True)
    line = scan(line, ["conv_id", "set_id"], ["at", "holds"], [before("best", "max", F.col("item"))])
    line = line.where((F.col("holds") == 0) & F.col("best").isNotNull()).select("conv_id", "set_id", F.col("at").alias("turn"), "best")
    top = sets.join(line, ["conv_id", "set_id", "turn"])
    return both.unionByName(top.select(*level, "best.parent_turn", "best.words", "best.first_words"))


def reply_paths(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, path) for (conv_id, turn, parent_turn) with parent_turn < turn;
    the path lists the turns from the root's to the message's own.  Rounds double its length."""
    one = replies.select(
        "conv_id", "turn", F.col("parent_turn").alias("top"), F.array("parent_turn", "turn").alias("path")
    )
    state = persist_table(one, "reply-paths")
    while True:
        above = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("up"), F.col("path").alias("above"))
        step = state.join(above, ["conv_id", "top"], "left").select(
            "conv_id",
            "turn",
            F.coalesce("up", "top").alias("top"),
            F.when(
                F.col("up").isNotNull(), F.concat("above", F.slice("path", F.lit(2), F.size("path")))
            ).otherwise(F.col("path")).alias("path"),
            F.col("up").isNotNull().alias("grown"),
        )
        step = persist_table(step, "reply-paths")
        state = step.drop("grown")
        if not step.where("grown").head(1):
            return state.select("conv_id", "turn", F.col("top").alias("root_turn"), "path")


def reply_order(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, body, parent_turn, root_turn, depth, reply_path) of every message.

    Sorting a conversation by reply_path puts every message after its parent, roots by turn.  A
    message that quotes nothing known is a root.  Of equal matches the message that held more of
    the words first is the parent, then the later one.  A null text has an empty body; a null conversation or turn has no parent, and a
    null turn an empty path.  Messages that share conversation and turn share their parent: the
    one that shares most words with any of them.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("int").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("th"),
    )
    links = quote_links(rows.select("conv_id", "turn", "th", "text"))
    best = links.groupBy("conv_id", "turn").agg(
        F.min_by("parent_turn", F.struct("level", -F.col("words"), -F.col("first_words"), -F.col("parent_turn"))).alias("parent_turn")
    )
    best = persist_table(best, "replies")
    paths = reply_paths(best).join(best, ["conv_id", "turn"])
    alone = F.when(F.col("turn").isNull(), F.array().cast("array<int>")).otherwise(F.array("turn"))
    path = F.coalesce("path", alone)
    return rows.join(paths, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        own_text(F.col("text")).alias("body"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.greatest(F.size(path) - 1, F.lit(0)).alias("depth"),
        path.alias("reply_path"),
    )
