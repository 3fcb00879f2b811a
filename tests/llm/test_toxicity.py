import random

import numpy as np
import pytest

from radiolake.llm import toxicity
from radiolake.llm.toxicity import FEATURES, Model, clause_features
from tests.llm.helpers import docs_table, prose


def features(text, **arcs):
    model = Model(arcs={k + "$": v for k, v in (arcs or {"idiot": 2.0}).items()})
    return dict(zip(FEATURES, clause_features(text, model), strict=True))


def test_clauses_by_kind():
    plain = features("What an idiot.")
    assert plain["plain"] > 0 and plain["aimed"] == plain["negated"] == plain["reported"] == 0
    assert features("You are an idiot.")["aimed"] > 0
    assert features("you went home. What an idiot")["aimed"] == 0  # another clause
    negated = features("He is not an idiot.")
    assert negated["negated"] > 0 and negated["plain"] == 0
    assert features("not that it matters at all, idiot")["plain"] > 0  # out of the negation's reach
    reported = features("She said he was an idiot.")
    assert reported["reported"] > 0 and reported["plain"] == 0
    assert features("I will kill you")["threat"] > 0 and features("I will kill time")["threat"] == 0
    assert features("") == dict.fromkeys(FEATURES, 0.0)


def test_prefix_arcs_take_any_ending():
    model = Model(arcs={"blor": 2.0, "zog$": 3.0})
    assert model.weight("blorish") == 2.0 and model.weight("zog") == 3.0 and model.weight("zogs") == 0.0


def test_composition_runs_both_transducers():
    table = toxicity.compose(toxicity.negation_transducer(), toxicity.report_transducer())
    state, outs = (0, 0), []
    for symbol in "RNWI":
        state, out = table[state, symbol]
        outs.append(out)
    assert outs == ["R", "N", "W", 'I-"']


def test_copies_do_not_bring_their_other_words():
    arcs = ["bad$", "copy$", "other$"]
    texts = [np.array([0, 1])] * 5 + [np.array([0]), np.array([2, 0])] * 3
    assert toxicity.select_arcs(arcs, np.array([1.0, 1.0, 1.0]), texts, 3.0) == [0]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(150):
        text = prose(rng, 4)
        toxic = i % 3 == 0
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "grumf" + rng.choice(["a", "ori", "en"]))
            text = " ".join(words)
        texts.append(text)
        labels.append((i, int(toxic)))
    docs = docs_table(spark, [*texts, None, ""])
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int"), dict(labels)


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    assert any(a.startswith("grumf") for a in model.arcs)
    held = toxicity.score(docs, model).where(toxicity.held_out("doc_id")).where("doc_id < 150").collect()
    assert len(held) > 15
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)


def test_labels_and_held_out_rows_do_not_enter(corpus):
    docs, labels, _ = corpus
    train = labels.where(~toxicity.held_out("doc_id"))
    a = toxicity.fit(docs, train)
    b = toxicity.fit(docs.withColumnRenamed("lang", "toxic"), train)
    assert a == b
    scores = {r.doc_id: r.score for r in toxicity.score(docs, a, keep=["doc_id", "lang"]).collect()}
    assert 0 < scores[150] < 0.5 and scores[150] == scores[151]


def test_without_labels_the_fixed_words_remain(spark, corpus):
    docs, labels, _ = corpus
    assert toxicity.fit(docs, labels.where("doc_id < 0")) == Model()
    assert toxicity.fit(docs, labels.where("toxic = 0")) == Model()
    assert toxicity.score(docs.where("doc_id < 0"), Model()).count() == 0
