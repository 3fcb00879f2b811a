import math
import random
import re

import pytest
from pyspark.sql import functions as F

from radiolake.llm import quality
from tests.llm.helpers import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    out = [prose(rng, rng.randint(1, 12)) for _ in range(25)]
    out += ["a b c d e " * 4, "a a a a a a a a", "x y\n x y\nx y\n\n \nx y", "#$% && \x0b | \x85 é <b>", None, "", " \n\t"]
    out += [prose(rng, 3) * 3, "a\x1cb c d e f g a\x1cb c d e f g", "1 2 3 4 5 6 1 2 3 4 5"]
    return out


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")


def test_base_figures_equal_brute_force(spark, texts):
    rows = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text), text
        n, repeat = base(text)[0], base(text)[4]
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.kept and r.base_failed)


def test_distance(spark):
    rows = [([1, 1], [1, 1]), ([1, 0], [0, 1]), ([3, 1], [1, 1]), ([0, 0], [1, 1]), (None, [1, 1])]
    out = spark.createDataFrame(rows, "p array<bigint>, q array<bigint>")
    got = [r.d for r in out.select(quality.distance(F.col("p"), F.col("q"), 2).alias("d")).collect()]
    m = (0.625, 0.375)
    js = 0.5 * sum(a * math.log2(a / b) for a, b in zip((0.75, 0.25), m)) + 0.5 * sum(0.5 * math.log2(0.5 / b) for b in m)
    assert got[:3] == pytest.approx([0.0, 1.0, math.sqrt(js)])
    assert got[3:] == [None, None]


def test_odd_texts_go_and_short_ones_are_not_judged(spark):
    rng = random.Random(1)
    good = [prose(rng, 12) for _ in range(30)]
    odd = " ".join(w + "&%$*" for w in prose(rng, 12).split())
    short = " ".join(w + "&%$*" for w in prose(rng, 2).split())
    rows = {r.doc_id: r.kept for r in quality.judge(frame(spark, [*good, odd, short])).collect()}
    assert all(rows[i] for i in range(30)) and not rows[30] and rows[31]


def test_languages_nulls_ties_and_empty_tables(spark, texts):
    docs = frame(spark, texts).unionByName(frame(spark, texts, None)).unionByName(frame(spark, texts, "xx"))
    rows = quality.judge(docs).collect()
    assert len(rows) == 3 * len(texts)
    assert all(r.word_distance is None for r in rows if r.lang != "en")
    clash = frame(spark, texts).withColumn("left", F.lit(1)).withColumn("kept", F.lit("x"))
    assert quality.judge(clash).count() == len(texts)
    assert quality.judge(docs.where("doc_id > 1000")).count() == 0


def test_other_scripts_have_references_of_their_own(spark):
    rng = random.Random(4)
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπρσςτυωχζύθ")
    english = [prose(rng, 12) for _ in range(60)]
    texts = [prose(rng, 12).lower().translate(greek) for _ in range(45)]
    odd = " ".join(w + "&%$*" for w in prose(rng, 12).lower().translate(greek).split())
    docs = [(i, t, "en") for i, t in enumerate(english)]
    docs += [(100 + i, t, "el") for i, t in enumerate(texts[:35])] + [(200, odd, "el")]
    docs += [(300 + i, t, "rare") for i, t in enumerate(texts[35:40])]
    docs += [(400 + i, t, None) for i, t in enumerate(texts[40:])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    for most in (10_000, 0):
        rows = {r.doc_id: r for r in quality.judge(df, max_broadcast=most).collect()}
        assert len(rows) == len(docs)
        assert all(r.n_chars >= 400 for r in rows.values())
        assert [i for i, r in rows.items() if not r.kept] == [200]
        assert max(rows[100 + i].char_distance for i in range(35)) < 0.1 < min(rows[300].char_distance, rows[400].char_distance)
