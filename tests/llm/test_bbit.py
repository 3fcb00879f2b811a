import random
import re

import numpy as np
import pyarrow as pa

from radiolake.llm import bbit
from tests.llm.helpers import docs_table

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=repr)


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = [None, "", " \n\t", "One", "one", "one two", "ONE two", "a b c", "a b c d"]
    for size in (30, 60, 200):
        base = [word() for _ in range(size)]
        for _ in range(28):  # from exact copies to pairs near and below the threshold
            copy = list(base)
            for _ in range(rng.randint(0, max(2, size // 16))):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
        chain = list(base)
        for _ in range(12):  # each linked with the next one, the ends far apart
            chain[rng.randrange(size)] = word()
            texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    long = [word() for _ in range(60_000)]
    texts += [" ".join(long), " ".join(long[:-500])]
    rng.shuffle(texts)
    return texts


def found(docs, **options):
    return sorted((tuple(r) for r in bbit.near_duplicates(docs, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    texts = corpus()
    ids = [i - 7 for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    rows += rows[:6] + [(5, texts[40]), (None, texts[41]), (None, "nothing like it at all")]
    docs = docs_table(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnRenamed("lang", "key")
    assert found(docs) == brute(rows)
    assert found(docs, block_sets=4, block_shingles=150) == brute(rows)


def test_groups_that_representatives_do_not_join(spark):
    # every pair of the first two groups is likely, few are links: the blocks have to find them
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(40):
        copy = list(base)
        for k in rng.sample(range(0, 120, 6), 4):
            copy[k] = f"x{i}-{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    for percent in (70, 80, 85):
        assert found(docs_table(spark, texts), percent=percent, block_sets=8) == brute(rows, percent)


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.85, 1.0):
        n = 4000
        common = rng.integers(0, 1 << 63, size=round(2 * n * share / (1 + share)), dtype=np.uint64)
        own = lambda common=common: np.r_[common, rng.integers(0, 1 << 63, size=n - len(common), dtype=np.uint64)]
        values = np.r_[own(), own()]
        low = bbit.minima(values, np.array([0, n]))
        planes = bbit.pack(low)
        assert planes.shape == (2, bbit.BITS * bbit.HASHES // 64)
        estimate = bbit.corrected(bbit.agreement(planes[:1], planes[1:])[0, 0])
        assert abs(estimate - share) < 0.16
        assert (bbit.agreement(planes, planes).diagonal() == bbit.HASHES).all()


def test_shingles_of_short_texts():
    values, counts = bbit.shingles(pa.array(["a", None, "a b", "A  B c", "a b c d a b c"]), 3)
    assert counts.tolist() == [1, 0, 1, 1, 4] and len(values) == 7


def test_empty_table(spark):
    assert bbit.near_duplicates(docs_table(spark, ["x"]).where("doc_id > 5")).count() == 0
