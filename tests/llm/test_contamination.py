import random

import pytest

from radiolake.llm import contamination
from tests.llm.helpers import WORD, docs_table, prose


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, size=10):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for k in range(max(1, len(q) - size + 1) if q else 0):
                window = q[k : k + size]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    items = [(i, prose(rng, 3)) for i in range(6)] + [(6, "Kurz ÜBER alles"), (7, None), (8, "..."), (9, prose(rng, 1, 4))]
    items.append((10, items[0][1]))  # the same text again
    texts = [prose(rng, 6) for _ in range(20)]
    for k in range(8):
        q = words(items[k % 6][1])
        cut = rng.randint(0, len(q) - 12)
        texts.append(prose(rng, 2) + " " + ", ".join(q[cut : cut + 9 + k % 5]).upper() + "! " + prose(rng, 2))
    texts += [None, "", "kurz\nÜBER alles", "kurz über alles", items[9][1] * 3, items[0][1], items[0][1]]
    return texts, items


def run(spark, texts, items, **options):
    index = contamination.build_index(docs_table(spark, texts))
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.contamination(index, contamination.phrase_matches(index, tests, **options))
    rows = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found.collect()}
    return [rows[i] for i in range(len(texts))]


def test_equals_brute_force(spark, case):
    assert run(spark, *case) == brute(*case)


def test_blocks_of_tests_give_the_same(spark, case):
    assert run(spark, *case, block_words=40) == brute(*case)


def test_empty_tables(spark, case):
    assert run(spark, case[0], []) == brute(case[0], [])
    assert run(spark, [], case[1]) == []


def test_null_ids_repeated_rows_and_other_columns(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text, "x"), (1, text, "y"), (1, text, "z")], "doc_id bigint, text string, term string")
    tests = spark.createDataFrame([("a", text)], "item_id string, text string")
    index = contamination.build_index(docs)
    rows = contamination.contamination(index, contamination.phrase_matches(index, tests)).collect()
    assert sorted((r.doc_id is None, r.n_hit) for r in rows) == [(False, 10), (False, 10), (True, 10)]


def test_proximity_lets_words_change_places(spark):
    texts = ["red x x blue y green", "green red blue", "red x x x x x x x blue green", "red blue"]
    index = contamination.build_index(docs_table(spark, texts))
    tests = spark.createDataFrame([("a", "red blue green")], "item_id string, text string")
    near = contamination.proximity_matches(index, tests, span=6).select("doc_id", "start").collect()
    assert sorted(map(tuple, near)) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        contamination.proximity_matches(index, tests, span=1000)
