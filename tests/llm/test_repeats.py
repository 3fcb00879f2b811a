import random

from radiolake.llm import repeats
from tests.llm.helpers import docs_table, prose


def brute(rows, min_words=20, min_sentences=2, long_sentence=40):
    """Covered sentences of each (id, text), by looking at every earlier run."""
    runs = {}
    split = [repeats.split_sentences(t or "")[0] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    covered = [set() for _ in rows]
    for i in order:
        plain = [tuple(s.lower().split()) for s in split[i]]
        n = len(plain)
        own = set()
        for a in range(n):
            for b in range(a + 1, n + 1):
                w = sum(map(len, plain[a:b]))
                enough = w >= min_words and b - a >= min_sentences
                less_front = sum(map(len, plain[a + 1 : b])) >= min_words and b - a - 1 >= min_sentences
                less_back = sum(map(len, plain[a : b - 1])) >= min_words and b - a - 1 >= min_sentences
                if (enough and not (less_front and less_back)) or (b - a == 1 and w >= long_sentence):
                    own.add((a, b))
        for a, b in sorted(own):
            key = tuple(plain[a:b])
            if key in runs:
                covered[i].update(range(a, b))
            else:
                runs[key] = i
    return covered


def test_every_minimal_run_is_used():
    assert repeats.sentence_runs([5, 5, 5, 5, 30, 2], 12, 2, 25) == {(0, 3), (1, 4), (2, 5), (3, 5), (4, 6), (4, 5)}
    assert repeats.sentence_runs([], 12, 2, 25) == set()
    assert repeats.sentence_runs([30], 12, 2, 25) == {(0, 1)}


def test_long_white_space_takes_linear_time():
    blank = " \t" * 500_000
    sentences, spaces = repeats.split_sentences(f"a{blank}b.{blank}\n{blank}c{blank}\n{blank}\nd")
    assert sentences == [f"a{blank}b.", "c", "d"]
    assert spaces == [f"{blank}\n{blank}", f"{blank}\n{blank}\n", ""]


def test_equals_brute_force_and_catches_passages(spark):
    rng = random.Random(5)
    passage = prose(rng, 6)
    texts = [prose(rng, 5)] + [prose(rng, rng.randint(1, 8)) for _ in range(11)]
    texts += [prose(rng, 2) + " " + passage + "\n" + prose(rng, 3), passage.upper() + "  " + prose(rng, 2), None, "", " \n "]
    texts += [texts[0], prose(rng, 1, 45) + " " + prose(rng, 1), "A b c. " * 40]
    texts += [texts[-2].split(". ")[0] + ". " + prose(rng, 2)]
    rows = list(enumerate(texts))
    expected = brute(rows)
    found = {r.doc_id: r for r in repeats.remove_repeats(docs_table(spark, texts)).collect()}
    for i, text in rows:
        assert found[i].n_removed == len(expected[i]), i
        if not expected[i]:
            assert found[i].text == text
    assert passage in found[12].text
    assert all(s.lower() not in found[13].text.lower() for s in passage.split(". ")[:5])
    assert found[13].removed and len(found[13].removed) == 1
    assert found[17].text == ""


def test_ties_and_clashing_columns(spark):
    text = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, text + " More.", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, removed string")
    out = {(r.doc_id, r.text) for r in repeats.remove_repeats(docs).collect()}
    assert out == {(None, text), (1, ""), (2, "More.")}
    assert repeats.remove_repeats(docs.where("doc_id > 5")).count() == 0


def test_line_breaks_survive_a_removal():
    text = "A b.\nC d. E f.\nG h."
    assert repeats.without(text, {1}) == ("A b.\nE f.\nG h.", 1, ["C d."])
    assert repeats.without(text, {1, 2}) == ("A b.\nG h.", 2, ["C d. E f."])
    assert repeats.without(text, {0, 1, 2, 3})[0] == ""
