import random
import re
from collections import Counter, defaultdict

from radiolake.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, chunk string, n bigint"
FIXED = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms_of(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(FIXED))


def brute(rows, min_docs=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for k, s in groups if k == lang]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found, 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def corpus():
    rng = random.Random(2)
    stems = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] + ["été", "Éa", "ñ", "日本", "𝒳y"]
    rows = []
    for _ in range(260):
        words = []
        for _ in range(rng.randint(0, 25)):
            stem = stems[min(int(rng.expovariate(0.06)), len(stems) - 1)]
            # one term in many spellings of its chunk
            words.append(rng.choice(["", "(", "9", "_"]) + rng.choice([stem, stem.upper(), stem + "-" + stem]) + rng.choice(["", ",", ".", "!7", "/"]))
        rows.append((rng.choice([" ", "\n", "\t\x0b"]).join(words), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "B", None, "ü"])))
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("only few", "xx", "two"), ("12 34", "yy", None), ("waa " * 40_000 + "wab" * 50_000, "en", "a")]
    return rows + rows[:15]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i % 50, *r, "clash", 1) for i, r in enumerate(rows)], DOCS)
    got = {tuple(r) for r in divergence.divergence(docs).collect()}
    assert got == brute(rows)
    few = {tuple(r) for r in divergence.divergence(docs, min_docs=3, top=2, block_cells=40).collect()}
    assert few == brute(rows, 3, 2)


def test_terms_spread_over_chunks_are_counted_by_document(spark):
    # each chunk is in few documents, their sum passes the threshold, distinct documents decide
    rows = [("few, few. few!", "en", "s")] * 9 + [("many1", "en", "s")] * 5 + [("many2", "en", "s")] * 5
    docs = spark.createDataFrame([(None, *r, None, None) for r in rows], DOCS)
    for bits in (8, 1 << 16):
        got = {(r.term, r.n) for r in divergence.term_counts(docs, slab_bytes=30, filter_bits=bits).collect()}
        assert got == {("many", 10)}


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
