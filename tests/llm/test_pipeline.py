import random

import pytest

import corpus_pipeline
from radiolake.session import scratch_path
from tests.llm.helpers import DOCS, prose
from tests.llm.test_forest import brute as near_brute

BENCH = "b one b two b three b four b five b six"


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(8)
    passage = prose(rng, 7)
    texts = [prose(rng, 6) for _ in range(40)]
    for i in range(0, 40, 2):
        texts[i] += " What an idiot, you stupid moron. You pathetic loser, you worthless trash."
    texts += [texts[1], texts[3] + " Extra.", prose(rng, 2) + " " + passage, passage + " " + prose(rng, 3)]
    texts += [prose(rng, 2) + " " + BENCH + ". " + prose(rng, 1), None, "", "short"]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    out = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(i % 2 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, BENCH)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, texts, passage


def test_stages_keep_what_they_should(spark, folder):
    out, texts, passage = folder
    docs, columns = spark.read.parquet(f"{out}/documents.parquet"), DOCS.replace(",", "").split()[::2]
    kept = [i for i in range(len(texts)) if not (i < 40 and i % 2 == 0)]
    states = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, out).write.parquet(path)
        docs = spark.read.parquet(path)
        states.append({r.doc_id: r for r in docs.collect()})
        if name != "pieces":
            assert docs.columns == columns
    assert sorted(states[0]) == kept
    classes = near_brute([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if classes[k][0] == k or not texts[i]]
    assert sorted(states[1]) == kept and 40 not in kept and 41 not in kept
    assert sorted(states[2]) == kept
    assert passage in states[2][42].text and passage[:60] not in states[2][43].text
    assert states[2][43].n_chars == len(states[2][43].text)
    assert states[2][1].text == texts[1] and states[2][45].text is None
    kept.remove(44)
    assert sorted(states[3]) == sorted(states[4]) == kept
    assert all(r.agrees for r in states[4].values())


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0])
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "agrees"]
    assert rows.count() > 15


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
    assert docs.count() == 0
