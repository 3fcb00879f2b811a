"""Small document tables for the tests of the subpackage."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SYLLABLES = "ta ri mo ken lu vas dor pi ne gra".split()


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def prose(rng: random.Random, sentences: int, words: int = 9) -> str:
    return " ".join(sentence(rng, words) for _ in range(sentences))


def docs_table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)
