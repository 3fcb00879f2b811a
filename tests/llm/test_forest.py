import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from radiolake.llm import forest
from radiolake.llm.components import connected
from tests.llm.helpers import WORD, docs_table, prose


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    links, parent = defaultdict(int), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * union:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(root(i), links[i]) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = prose(rng, 20)
    out = [edited(rng, base, rng.randint(0, 6)) for _ in range(40)]
    out += [prose(rng, 8) for _ in range(15)]
    out += [edited(rng, out[45], 1), out[46], out[46].upper() + "!", None, "", "...", "one two", "one TWO", "one two three"]
    return out


@pytest.mark.parametrize("block_sets", [256, 8])
def test_equals_brute_force(spark, texts, block_sets):
    docs = docs_table(spark, texts)
    rows = {r.doc_id: r for r in forest.similarity_classes(docs, recall=0.9999, block_sets=block_sets).collect()}
    expected = brute(texts)
    assert [(rows[i].class_id, rows[i].n_links) for i in range(len(texts))] == expected
    assert all(rows[i].kept == (expected[i][0] == i) for i in range(len(texts)))


def test_depth_is_shortened_until_the_recall_is_reached():
    assert forest.prefix_depth(20, 0.8, 0.995, 12) == 6
    assert forest.expected_recall(6, 20, 0.8) >= 0.995 > forest.expected_recall(7, 20, 0.8)
    assert forest.prefix_depth(1, 0.8, 0.999, 5) == 1


def test_shingles_do_not_depend_on_the_batch(texts):
    whole, counts = forest.shingle_sets(pa.array(texts))
    ends = np.cumsum(counts)
    for i, text in enumerate(texts):
        alone, n = forest.shingle_sets(pa.array([text], pa.string()))
        assert n[0] == counts[i] == len(shingles(text))
        assert (alone == whole[ends[i] - counts[i] : ends[i]]).all()


def test_null_ids_ties_and_empty_tables(spark):
    text = "a b c d e f g"
    docs = docs_table(spark, [text, text, text + " ", None], [7, 7, None, None])
    rows = forest.similarity_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, True), (0, True), (7, False)]
    assert forest.similarity_classes(docs.where("doc_id = 1")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    found = dict(map(tuple, connected(edges).collect()))
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
