import random

import pytest
from pyspark.sql import functions as F

from radiolake.llm import quotes

SCHEMA = "conv_id bigint, turn int, role string, text string"
MAIL = [
    (1, 0, "a", "Shall we meet on Monday?\nI am free at noon."),
    (1, 1, "b", "Monday is fine with me.\n\nBut where?"),
    (1, 2, "c", "On Tue, b wrote:\n> Monday is fine with me.\nNot with me, sorry."),
    (1, 3, "a", "> shall we meet, on MONDAY?\n> I am free at noon.\nI meant this Monday."),
    (1, 4, "d", "> On Tue, b wrote:\n>> Monday is fine with me.\n> Not with me, sorry.\nOh well."),
    (1, 5, "e", "> never said by anybody\nHm."),
    (1, 6, "f", "> I will say this later.\nA prophecy."),
    (1, 7, "g", "I will say this later."),
    (2, 0, "a", "> Monday is fine with me.\nWrong conversation."),
    (None, 1, "a", "Shall we meet on Monday?"),
    (None, 2, "a", "> Shall we meet on Monday?"),
    (3, None, "a", "> hello there"),
    (3, 1, None, None),
    (3, 2, "", ""),
]


def ordered(spark, rows):
    return {(r.conv_id, r.turn, r.role): r for r in quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_replies_bodies_and_order(spark):
    got = ordered(spark, MAIL)
    parents = {k[1]: r.parent_turn for k, r in got.items() if k[0] == 1}
    assert parents == {0: None, 1: None, 2: 1, 3: 0, 4: 2, 5: None, 6: None, 7: None}
    assert got[1, 4, "d"].reply_path == [1, 2, 4] and got[1, 4, "d"].depth == 2 and got[1, 4, "d"].root_turn == 1
    order = sorted((r.reply_path for k, r in got.items() if k[0] == 1))
    assert order == [[0], [0, 3], [1], [1, 2], [1, 2, 4], [5], [6], [7]]
    assert got[1, 2, "c"].body == "Not with me, sorry."
    assert got[1, 4, "d"].body == "Oh well."
    assert got[1, 0, "a"].body == MAIL[0][3]
    assert got[2, 0, "a"].parent_turn is None and got[2, 0, "a"].body == "Wrong conversation."


def test_nulls(spark):
    got = ordered(spark, MAIL)
    assert got[None, 2, "a"].parent_turn is None and got[None, 2, "a"].body == ""
    assert got[3, None, "a"].reply_path == [] and got[3, None, "a"].depth == 0
    assert got[3, 1, None].body == "" and got[3, 2, ""].body == ""
    assert len(got) == len(MAIL)


def test_passages_by_level(spark):
    text = "a\n> b\n> c\n>> d\n> e\nf\n>>>g"
    rows = spark.createDataFrame([(1, 0, 5, text)], "conv_id bigint, turn int, th bigint, text string")
    got = sorted((r.passage, r.level, r.text) for r in quotes.quoted_passages(rows).collect())
    assert got == [(1, 1, "b\nc"), (3, 2, "d"), (4, 1, "e"), (6, 3, "g")]


def test_long_chain_hot_line_and_repeated_rows(spark):
    rows = [(1, 0, "u", "message number 0")]
    rows += [(1, i, "u", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 20)]
    rows += [(2, i, "u", "yes indeed\n> yes indeed") for i in range(40)] + [(2, 3, "u", "yes indeed\n> yes indeed")]
    got = quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    chain = {r.turn: r for r in got if r.conv_id == 1}
    assert all(chain[i].reply_path == list(range(i + 1)) for i in range(20))
    assert all(r.parent_turn == (0 if r.turn else None) for r in got if r.conv_id == 2)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(MAIL, SCHEMA)
    assert quotes.reply_order(df.where("turn > 100")).count() == 0
    clash = df.withColumn("th", F.lit("x")).withColumn("level", F.lit(1)).withColumn("path", F.lit(1))
    assert quotes.reply_order(clash).count() == len(MAIL)


def by_sql(rows):
    import duckdb
    import pandas as pd

    from radiolake.llm.checks import reply_sql

    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    conversations["turn"] = conversations["turn"].astype("Int32")
    return sorted(map(str, duckdb.sql(reply_sql()).fetchall()))


def by_spark(spark, rows):
    got = quotes.reply_order(spark.createDataFrame(rows, SCHEMA))
    got = got.withColumn("reply_path", F.array_join(F.col("reply_path").cast("array<string>"), "/"))
    return sorted(str(tuple(r)) for r in got.collect())


def test_sql_check_agrees_on_mail(spark):
    rows = [r for r in MAIL if r[1] is None or r[0] is not None]
    assert by_spark(spark, rows) == by_sql(rows)


SIGNATURE = "Control room north, all calls are recorded"


def test_paragraphs_wrapped_anew_are_linked(spark):
    parts = ["The first paragraph is short.", "The second one has\nquite a few more words in it.", "The third ends it all."]
    quote = "> The second one has quite a few\n> more words in it.\n>\n> The third ends\n> it all.\nAgreed."
    got = ordered(spark, [(1, 0, "a", "Hello."), (1, 1, "b", "\n\n".join(parts)), (1, 2, "c", quote)])
    assert got[1, 2, "c"].parent_turn == 1


def test_repeated_lines_count_for_the_message_quoted(spark):
    rows = [(1, i, "u", f"Report number {i} is in.\n{SIGNATURE}") for i in range(5)]
    rows += [(1, 5, "u", f"No answer yet.\nTry channel nine.\n{SIGNATURE}")]
    rows += [(1, 6, "u", f"> Try channel nine.\n> {SIGNATURE}\nI will.")]
    assert ordered(spark, rows)[1, 6, "u"].parent_turn == 5


def test_very_frequent_lines(spark):
    rows = [(1, i, "u", f"Report number {i} is in.\n{SIGNATURE}") for i in range(50)]
    rows += [(1, 50, "u", f"> Report number 45 is in.\n> {SIGNATURE}\nGood."), (1, 51, "u", f"> {SIGNATURE}\nWho?")]
    # two messages hold the short line; the frequent one decides between them
    rows += [(1, 52, "u", "Never mind."), (1, 53, "u", f"Never mind.\n{SIGNATURE}"), (1, 54, "u", f"> Never mind.\n> {SIGNATURE}")]
    got = ordered(spark, rows)
    assert [got[1, i, "u"].parent_turn for i in (50, 51, 54)] == [45, 0, 53]


def chatter(seed, n=140):
    """Messages of frequent and rare lines that quote lines, paragraphs and whole messages at some levels."""
    rng = random.Random(seed)
    lines = [f"Line {'very ' * (k % 4)}much heard {k}" for k in range(6)]
    rows = []
    for conv in (1, 2):
        said = []
        for turn in range(n):
            own = rng.sample(lines, rng.randint(1, 3)) + [f"Only {turn % 50} says so."] * (turn % 3 == 0)
            quoted = []
            for depth in range(1, 1 + rng.randint(0, 2)):
                pick = rng.sample(lines, rng.randint(1, 3)) if rng.random() < 0.6 or not said else rng.choice(said).split("\n")
                quoted += [">" * depth + " " + x for x in pick]
            said.append("\n".join(own) if turn % 4 else "\n\n".join(own))
            rows.append((conv, turn, "u", "\n".join(quoted + [said[-1]])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_frequent_texts_are_scored_like_rare_ones(spark, seed):
    rows = chatter(seed)
    assert by_spark(spark, rows) == by_sql(rows)
    messages = spark.createDataFrame(rows, SCHEMA).withColumn("th", F.xxhash64("text"))
    best = {}
    for often in (0, 3, 10**6):
        links = quotes.quote_links(messages.drop("role"), often)
        order = F.struct("level", -F.col("words"), -F.col("first_words"), -F.col("parent_turn"))
        best[often] = sorted(map(tuple, links.groupBy("conv_id", "turn").agg(F.min(order)).collect()))
    assert best[0] == best[3] == best[10**6] and len(best[0]) > 80


def test_two_frequent_lines_that_one_message_holds_together(spark):
    one, other = "All stations stand by", "This is the control room of the north speaking"
    rows = [(1, i, "u", one if i % 2 else other) for i in range(90)]
    rows[60] = (1, 60, "u", f"{one}\nnow.\n{other}")
    rows += [(1, 90, "u", f"> {one}\nYes?\n> {other}\nReady."), (1, 91, "u", f"> {one}\nYes?")]
    got = ordered(spark, rows)
    assert (got[1, 90, "u"].parent_turn, got[1, 91, "u"].parent_turn) == (60, 1)


def test_very_long_message(spark):
    text = "\n".join(f"> line {k}" for k in range(30000)) + "\nok"
    got = ordered(spark, [(1, 0, "u", "line 29999"), (1, 1, "u", text), (1, 1, "u", text)])
    assert got[1, 1, "u"].parent_turn == 0 and got[1, 1, "u"].body == "ok"
