import random
import re
from itertools import permutations

import numpy as np

from radiolake.llm import interaction

DOCS = "doc_id bigint, text string, source string, part string, mask int"
LABELS = "doc_id bigint, quality int, toxic int"


def fails(i, text, firsts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bad = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": i is not None and i > firsts[text],
    }
    return {k for k, v in bad.items() if v}


def brute(rows, labels):
    """Every filter run over every row, for each order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    parts = {}
    for i, text, source in rows:
        parts.setdefault(source or "", []).append((i, fails(i, text or "", firsts)))
    out = {}
    for part, docs in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_by[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(x in f for _, f in docs) - len(gone),
                    sum(f == {x} for _, f in docs),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def corpus():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "A b #", "x " * 250, "été x y\x0bz"]
    for _ in range(40):
        n = rng.choice([5, 150, 199, 200, 400])
        words = [f"w{rng.randint(0, n)}" for _ in range(n)]
        if rng.random() < 0.4:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words[0] += rng.choice("#$%&*|")
        texts.append(" ".join(words))
    texts.append("long text " * 60_000)
    rows = [(i, t, rng.choice(["s", "t", None, ""])) for i, t in enumerate(texts)]
    rows += [(rng.randint(-5, 60), rng.choice(texts), rng.choice(["s", "u"])) for _ in range(60)]
    rows += rows[:5] + [(None, texts[9], "s"), (None, texts[9], "s")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(-5, 60)] + [(3, 1, None), (None, 1, 1), (4, None, 1)]
    return rows, labels


def test_equals_every_filter_in_every_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, s, "clash", 7) for i, t, s in rows], DOCS)
    cells = interaction.failure_cells(docs, spark.createDataFrame(labels, LABELS))
    got = {
        (r.part, r.filter_order, r.step): [
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        ]
        for r in interaction.order_steps(cells).collect()
    }
    assert got == brute(rows, labels)


def test_walk_of_other_sizes():
    rng = np.random.default_rng(1)
    for n in (1, 3, 6):
        cells = rng.integers(0, 9, size=(2, 1 << n, 3))
        states = interaction.walk_subsets(cells, n)
        for subset in range(1 << n):
            free = [m for m in range(1 << n) if not m & subset]
            assert (states[:, subset] == cells[:, free].sum(axis=1)).all()


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert interaction.order_steps(interaction.failure_cells(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "x", None, "p", 1)], DOCS)
    out = interaction.order_steps(interaction.failure_cells(one, labels)).collect()
    assert len(out) == 600 and {r.part for r in out} == {""}
