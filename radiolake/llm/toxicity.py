"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps each word to a symbol (insult, threat, target, negation, report, other)
and a weight.  Its insult arcs are a few fixed words and the word beginnings that separate the
labelled texts (prefix arcs, so that endings do not matter).  Negation and reported-speech
transducers, composed into one table, rewrite the insults and threats of a clause to negated or
reported ones; a target transducer tells whether the clause is aimed at somebody.  A text's
features are the weights of its matched clauses by kind; a small logistic model turns them into
a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.llm.words import slabs, split_words
from radiolake.session import persist_table

# word classes of the grammar, in English, German, French and Spanish
INSULTS = (
    "idiot idiots moron morons stupid pathetic worthless loser losers scum trash disgusting clown bastard "
    "dumbass imbecile cretin vermin trottel dummkopf arschloch abschaum imbécile connard crétin ordure "
    "imbécil estúpido idiota escoria"
).split()
THREATS = "kill killing hurt destroy shoot stab strangle töten umbringen erschießen tuer frapper matar golpear".split()
TARGETS = (
    "you your yours u he she they him her them these those du dich dir ihr euch sie dein eure tu te toi vous "
    "votre vos ils elles tú ti usted ustedes vosotros ellos ellas tus"
).split()
NEGATIONS = "not never no cannot nobody nicht kein keine keiner nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = (
    "said says say told wrote writes called quoted claimed alleged reportedly sagte sagt schrieb behauptete "
    "nannte dit écrit appelé prétend dijo dice escribió llamó afirmó"
).split()

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W_]+")
FEATURES = ("plain", "negated", "reported", "threat", "aimed", "dense")  # dense: weight by length

Table = dict[tuple, tuple]  # (state, symbol) -> (state, symbol)


def negation_transducer(reach: int = 3) -> Table:
    """Marks an insult or threat at most ``reach`` words after a negation."""
    table: Table = {}
    for state in range(reach + 1):
        for symbol in "WITHR":  # other, insult, target, threat, report
            marked = symbol + "-" if symbol in "IH" and state else symbol
            table[state, symbol] = (max(0, state - 1), marked)
        table[state, "N"] = (reach, "N")
    return table


def report_transducer() -> Table:
    """Marks insults and threats that follow a verb of speech in the clause."""
    table: Table = {}
    for state in (0, 1):
        for symbol in ("W", "I", "T", "H", "N", "I-", "H-"):
            table[state, symbol] = (state, symbol + '"' if state and symbol[0] in "IH" else symbol)
        table[state, "R"] = (1, "R")
    return table


def target_transducer() -> Table:
    """State 1 once a target has been named."""
    return {(s, x): (int(s or x == "T"), x) for s in (0, 1) for x in "WITHNR"}


def compose(first: Table, second: Table, start: tuple = (0, 0)) -> Table:
    """One table that feeds the output of ``first`` into ``second``; reachable states only."""
    table: Table = {}
    todo, seen = [start], {start}
    symbols = {x for _, x in first}
    while todo:
        a, b = state = todo.pop()
        for x in symbols:
            a2, mid = first[a, x]
            b2, out = second[b, mid]
            table[state, x] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return table


_GRAMMAR = compose(negation_transducer(), report_transducer())
_TARGET = target_transducer()
_CLASSES = {w: s for s, ws in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}


@dataclass
class Model:
    """Insult arcs by word beginning (``word$`` is a whole word), and the logistic weights."""

    arcs: dict[str, float] = field(default_factory=lambda: {w + "$": 3.0 for w in INSULTS})
    weights: tuple[float, ...] = (-4.0, 2.5, 0.3, 0.6, 1.5, 0.8, 0.5)
    longest: int = 8
    shortest: int = 3

    def weight(self, word: str) -> float:
        """Weight of the heaviest insult arc that accepts the word, 0 where none does."""
        arcs = self.arcs
        best = arcs.get(word + "$", 0.0)
        for n in range(self.shortest, min(self.longest, len(word)) + 1):
            best = max(best, arcs.get(word[:n], 0.0))
        return best

    def symbol(self, word: str) -> tuple[str, float]:
        w = self.weight(word)
        return ("I", w) if w > 0 else (_CLASSES.get(word, "W"), 1.0)


def clause_features(text: str, model: Model) -> list[float]:
    """Sums of the weights of matched clauses by kind, in the order of FEATURES."""
    sums = dict.fromkeys(FEATURES, 0.0)
    n_words = 0
    for clause in _CLAUSE.split(text.lower()):
        state, aim, hits = (0, 0), 0, []
        for word in _TOKEN.findall(clause):
            n_words += 1
            symbol, weight = model.symbol(word)
            state, out = _GRAMMAR[state, symbol]
            aim, _ = _TARGET[aim, symbol]
            if out[0] in "IH":
                hits.append((out, weight))
        for out, weight in hits:
            if out[-1] == '"':
                sums["reported"] += weight
            elif out[-1] == "-":
                sums["negated"] += weight
            elif out == "I":
                sums["plain"] += weight
                sums["aimed"] += weight * aim
            elif aim:  # a threat counts where it is aimed at somebody
                sums["threat"] += weight
    sums["dense"] = 50 * (sums["plain"] + sums["threat"]) / max(1, n_words)
    return [math.log1p(sums[f]) for f in FEATURES]


def held_out(id_col: str) -> Column:
    """crc32 of the id's text is divisible by 5; a null id counts as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


_COUNTS = "arc string, pos bigint, neg bigint, docs bigint"
_COUNTS_ARROW = pa.schema([("arc", pa.string()), ("pos", pa.int64()), ("neg", pa.int64()), ("docs", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of a task, of which no more than a MB of text is turned to Python at a time."""
    for batch in batches:
        for lo, hi in slabs(batch.column(names[0]), 1 << 20):
            yield from zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in names), strict=True)


def _count_arcs(shortest: int, longest: int, often: int, held: int = 100_000):
    """Occurrences (at most ``often`` a text) of every word and word beginning by label; the row
    without an arc counts all words.  Counts are passed on whenever ``held`` arcs have piled up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, docs = Counter(), Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            arcs = list(pos.keys() | neg.keys())
            for k in range(0, len(arcs), 50_000):
                part = arcs[k : k + 50_000]
                counts = [pa.array([c[a] for a in part], pa.int64()) for c in (pos, neg, docs)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], schema=_COUNTS_ARROW)
            for c in (pos, neg, docs):
                c.clear()

        for text, toxic in _rows(batches, "text", "toxic"):
            words = Counter(_TOKEN.findall((text or "").lower()))
            own: Counter = Counter()
            for word, n in words.items():
                for arc in _arcs_of(word, shortest, longest):
                    own[arc] += n
            into = pos if toxic else neg
            for arc, n in own.items():
                into[arc] += min(n, often)
            into[None] += sum(words.values())
            if toxic:
                docs.update(own.keys())
            if len(pos) + len(neg) > held:
                yield from out()
        yield from out()

    return run


def _arcs_of(word: str, shortest: int, longest: int) -> list[str]:
    return [word + "$", *(word[:k] for k in range(shortest, min(longest, len(word)) + 1))]


def _candidates_in(arcs: dict[str, int], shortest: int, longest: int):
    """For each toxic text the numbers of the candidate arcs it has, as little-endian int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = set(_TOKEN.findall((text or "").lower()))
                found = {arcs[a] for w in words for a in _arcs_of(w, shortest, longest) if a in arcs}
                out.append(np.array(sorted(found), dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["found"])

    return run


def select_arcs(arcs: list[str], precision: np.ndarray, texts: list[np.ndarray], least: float) -> list[int]:
    """Greedy cover: take the arc that explains most texts (times its precision),
    halve the weight of those, go on until an arc explains fewer than ``least``.

    Of arcs that explain the same the longest is taken, and no arc that is the beginning of a
    taken one or the other way round.  Words that only come along in copies of a toxic text have
    no weight left once its insults are taken.
    """
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    column = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int32)
    weight = np.ones(len(texts))
    open_ = np.ones(len(arcs), dtype=bool)
    length = np.array([len(a) for a in arcs])
    taken: list[int] = []
    while len(column) and open_.any():
        texts_of = np.bincount(column, weights=weight[row], minlength=len(arcs))
        gain = np.where(open_, texts_of * precision, -1.0)
        top = np.flatnonzero(gain >= gain.max() - 1e-9)
        best = int(top[np.argmax(length[top])])
        if gain[best] < least:
            break
        taken.append(best)
        weight[row[column == best]] *= 0.5
        stem = arcs[best].rstrip("$")
        for i in np.flatnonzero(open_):
            other = arcs[i].rstrip("$")
            if other.startswith(stem) or stem.startswith(other):
                open_[i] = False
    return taken


def _features(model: Model, known_words: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            for lo, hi in slabs(batch.column("__text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                texts = part.column("__text")
                words, counts = split_words(texts, "unicode")
                # only texts with a word that an insult or threat arc accepts need the grammar
                coded = words.dictionary_encode()
                if len(known) > known_words:
                    known.clear()
                hot = np.zeros(len(coded.dictionary), dtype=bool)
                for i, word in enumerate(coded.dictionary.to_pylist()):
                    flag = known.get(word)
                    if flag is None:
                        flag = known[word] = any(model.symbol(w)[0] in "IH" for w in _TOKEN.findall(word))
                    hot[i] = flag
                token = hot[coded.indices.to_numpy()] if len(words) else np.zeros(0, dtype=bool)
                row = np.repeat(np.arange(len(counts)), counts)[token]
                values = np.zeros((len(counts), len(FEATURES)))
                for i in np.unique(row):
                    values[i] = clause_features(texts[int(i)].as_py(), model)
                names = [c for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *(pa.array(values[:, k]) for k in range(len(FEATURES)))],
                    names=[*names, *FEATURES],
                )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a ridge-regularised logistic regression with an intercept, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
    max_arcs: int = 5_000,
    evidence: float = 30.0,
    min_docs: int = 2,
    min_share: float = 0.01,
    min_precision: float = 0.25,
    seed_weight: float = 3.0,
) -> Model:
    """Learn insult arcs and the logistic weights from labelled texts.

    ``max_rows`` bounds the sample: the labelled rows with the smallest hashed ids.  An arc is a
    word or a word beginning of 3 to 8 letters in at least ``min_docs`` and ``min_share`` of the
    toxic texts whose log-likelihood ratio against the other texts is at least ``evidence`` and
    whose share of toxic occurrences is at least ``min_precision``; its weight is the smoothed log of the ratio of rates.  The ``max_arcs`` candidates of strongest
    evidence go through ``select_arcs``.  Rows with a null label or id are left out; without rows of both labels the fixed
    words and default weights remain.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().distinct()
    rows = rows.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")
    texts = texts.select("text", "toxic")
    model = Model()
    counted = (
        texts.mapInArrow(_count_arcs(model.shortest, model.longest, 5), _COUNTS)
        .groupBy("arc")
        .agg(*(F.sum(c).cast("double").alias(c) for c in ("pos", "neg", "docs")))
    )
    counted = persist_table(counted, "arcs")
    totals = counted.where(F.col("arc").isNull()).agg(F.sum("pos"), F.sum("neg")).first()
    if not totals[0] or not totals[1]:
        return model
    all_pos, all_neg = F.lit(float(totals[0])), F.lit(float(totals[1]))
    share = all_pos / (all_pos + all_neg)
    both = F.col("pos") + F.col("neg")

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    kept = (
        counted.where(F.col("arc").isNotNull() & (F.col("docs") >= min_docs))
        .select(
            "arc",
            (2 * (part(F.col("pos"), both * share) + part(F.col("neg"), both * (1 - share)))).alias("g2"),
            ((F.col("pos") + 0.5) / (both + 1)).alias("precision"),
            (F.log((F.col("pos") + 0.5) / all_pos) - F.log((F.col("neg") + 0.5) / all_neg)).alias("weight"),
        )
        .where((F.col("g2") >= evidence) & (F.col("precision") >= min_precision))
        .orderBy(F.desc("g2"), "arc")
        .limit(max_arcs)
        .collect()
    )
    numbers = {r.arc: i for i, r in enumerate(kept)}
    toxic = texts.where("toxic = 1").select("text")
    found = toxic.mapInArrow(_candidates_in(numbers, model.shortest, model.longest), "found binary").collect()
    least = max(min_docs, min_share * len(found))
    taken = select_arcs(list(numbers), np.array([r.precision for r in kept]), [np.frombuffer(r.found, dtype=np.int32) for r in found], least)
    learned = {kept[i].arc: float(kept[i].weight) for i in taken}
    model.arcs = {w + "$": seed_weight for w in INSULTS} | learned
    schema = "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)
    sample = np.array([list(r) for r in texts.select("toxic", F.col("text").alias("__text")).mapInArrow(_features(model), schema).collect()], dtype=float)
    if len(sample):
        model.weights = _logistic(sample[:, 1:], sample[:, 0])
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (the id by default) of every row, then the features and the score.

    A null or empty text has all features 0.  Columns in ``keep`` with the name of a feature or
    of the score are replaced.
    """
    names = [c for c in (keep or [id_col]) if c not in (*FEATURES, "score")]
    rows = docs.select(*names, F.col(text_col).alias("__text"))
    schema = docs.select(*names).schema
    for f in FEATURES:
        schema = schema.add(f, "double")
    line = F.lit(model.weights[0])
    for f, w in zip(FEATURES, model.weights[1:], strict=True):
        line = line + F.lit(w) * F.col(f)
    return rows.mapInArrow(_features(model), schema).withColumn("score", 1 / (1 + F.exp(-line)))
