"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

*Lexicon.* Learnt from labelled rows: words (and word beginnings) that stand in toxic documents far more often than
chance allows. A word's support is its number of distinct left neighbours, so copies of one document count once. A term
is taken if ``n * KL(share, base) >= ln(words) + MARGIN`` (a Chernoff bound on chance, corrected for the number of words).
All terms that pass are taken: as the sample is bounded, and each needs several neighbours of its own there, so are they.

*Automaton.* The lexicon's trie and the Levenshtein automaton of radius 1 (words of 5 to 7 letters) or 2 (8 or more) are
run together: a state is the set of (trie node, errors so far), made when first met and kept, so that a word costs a
table lookup per letter and most words leave the automaton after two or three letters.

*Context.* A hit counts as quoted if, within ``WINDOW`` tokens, it lies between quotation marks or a verb of reporting
stands before it; otherwise as abuse. A logistic regression on the exact, beginning and misspelled hits
(which count half), as abuse and as quotation, gives the score.

Edge cases: null and empty texts have no hits and score the regression's constant; without any term that stands out every
text scores the base rate, without labelled rows 0.047; repeated rows are scored each; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.quality import labelled_sample
from orbweave.storage import materialise

WINDOW = 6
TRAIN_ROWS = 12_000  # the bound of the labelled sample
MARGIN = 3.0
STEM = (4, 5, 6)
TOKEN = re.compile(r"\w+|[\"“”„«»‹›‘’]")
OPENING, CLOSING = frozenset('"“„«‹‘'), frozenset('"”“»›’')
# fixed values: verbs of reporting, in the corpus' four languages
REPORTING = frozenset("said says called calls wrote quoted quote sagte sagt nannte schrieb zitierte dit appelle écrit cité dijo dice llamó escribió citó".split())
BLOCK = 200_000  # tokens of one text that are held at once
HIT = np.array([1.0, 1.0, 0.5])  # what an exact, a beginning and a misspelled hit count


STATES = 250_000  # trie nodes in all states of an automaton (some 30 MB); beyond, they are made anew, which changes no result


class LexiconAutomaton:
    """The terms' trie run together with Levenshtein automata; states are made on demand.

    ``look(word)`` gives 0 (no hit), 1 (a term), 2 (begins with a stem) or 3 (a term within the allowed errors).
    """

    def __init__(self, terms: list[str], stems: list[str], known: frozenset[str] = frozenset()):
        self.known = known
        self.stems, self.terms = frozenset(stems), frozenset(terms)
        self.lengths = sorted({len(s) for s in stems})
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # errors that the term ending at a node allows, -1: no term ends
        for t in terms:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = 0 if len(t) < 5 else 1 if len(t) < 8 else 2
        # the most errors that any term below a node allows
        self.below = list(self.ends)
        for node in range(len(self.children) - 1, -1, -1):
            self.below[node] = max([self.ends[node], *(self.below[k] for k in self.children[node].values())])
        self.alphabet = frozenset(c for t in terms for c in t)
        self._forget()
        self.memo: dict[str, int] = {}

    def _forget(self) -> None:
        """Only the first two states are kept; others are made again when a word needs them."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accepts: list[bool] = []
        self.moves: list[dict[str, int]] = []
        self.held = 0
        self._state(frozenset())  # state 0: no way on
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, at: set) -> frozenset:
        """With what a missing letter adds: a step down the trie for one error. Of a node, the fewest errors are kept."""
        best: dict[int, int] = {}
        todo = list(at)
        while todo:
            node, errors = todo.pop()
            if errors > self.below[node] or best.get(node, 99) <= errors:
                continue
            best[node] = errors
            todo += [(k, errors + 1) for k in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, at: frozenset) -> int:
        if at not in self.ids:
            self.ids[at] = len(self.states)
            self.held += len(at) + 8
            self.states.append(at)
            self.accepts.append(any(0 <= e <= self.ends[n] for n, e in at))
            self.moves.append({})
        return self.ids[at]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, errors in self.states[state]:
            after.add((node, errors + 1))  # a letter too many
            for letter, k in self.children[node].items():
                after.add((k, errors + (letter != c)))
        self.moves[state][c] = found = self._state(self._closed(after))
        return found

    def look(self, word: str) -> int:
        if word in self.terms:
            return 1
        if self.lengths and any(word[:n] in self.stems for n in self.lengths):
            return 2
        if self.held > STATES:
            self._forget()
        state = self.start
        for c in word:
            if c not in self.alphabet:
                c = ""
            state = self.moves[state].get(c, -1) if self.moves[state].get(c, -1) >= 0 else self._move(state, c)
            if state == 0:
                return 0
        return 3 if self.accepts[state] and word not in self.known else 0

    def of(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[word] = self.look(word)
        return found


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    stems: tuple[str, ...]
    known: frozenset[str]
    weights: tuple[float, ...]


def _runs(text: str):
    """(tokens, first, stop): all tokens of a text in runs; the hits to look at are first <= i < stop, with their context."""
    tokens, carry = (m.group() for m in TOKEN.finditer(text.lower())), []
    while True:
        block = list(islice(tokens, BLOCK))
        run, first = carry + block, min(WINDOW, len(carry)) if carry else 0
        last = len(block) < BLOCK
        stop = len(run) if last else len(run) - WINDOW
        yield run, first, stop
        if last:
            return
        carry = run[max(0, stop - WINDOW) :]


def _hits(automaton: LexiconAutomaton, text: str) -> np.ndarray:
    """Counts of exact, beginning and misspelled hits, as abuse and (the last three) as quotation."""
    counts = np.zeros(6)
    runs = _runs(text) if len(text) > 4 * BLOCK else [(t := TOKEN.findall(text.lower()), 0, len(t))]
    for tokens, first, stop in runs:
        found = {w: k for w in set(tokens) if (k := automaton.of(w))}
        if not found:
            continue
        for i in range(first, stop):
            w = tokens[i]
            if w in found:
                before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
                quoted = any(t in OPENING for t in before) and any(t in CLOSING for t in after) or any(t in REPORTING for t in before)
                counts[found[w] - 1 + 3 * quoted] += 1
    return counts


def _row(counts: np.ndarray) -> np.ndarray:
    """What the regression sees: a constant, and the weight of abuse and of quotation, each damped and as far as 1."""
    abuse, quoted = counts[:3] @ HIT, counts[3:] @ HIT
    return np.array([1.0, np.log1p(abuse), min(abuse, 1.0), np.log1p(quoted), min(quoted, 1.0)])


def _word_stats(sample: DataFrame) -> DataFrame:
    """(key, stem, toxic, clean): distinct left neighbours of each word and word beginning, by label."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}_]+)"))
    pairs = sample.select("label", tokens.alias("t")).select("label", F.explode(F.arrays_zip(F.col("t").alias("word"), F.concat(F.array(F.lit("")), F.col("t")).alias("before"))).alias("p"))
    pairs = pairs.select("label", "p.word", "p.before").where("word is not null").distinct()
    own = pairs.select(F.col("word").alias("key"), F.lit(0).alias("stem"), "label")
    stems = pairs.where(F.length("word") > min(STEM)).select("label", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM])).alias("key")).where("key is not null")
    both = own.union(stems.select("key", F.lit(1).alias("stem"), "label"))
    return both.groupBy("key", "stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def _lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    stats = materialise(_word_stats(sample), "word-stats")
    total = stats.where("stem = 0").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count("*").alias("n")).first()
    if not total.t or not total.c:
        return [], []
    base = total.t / (total.t + total.c)
    n = F.col("toxic") + F.col("clean")
    share = (F.col("toxic") - 0.001) / n
    kl = share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base))
    good = stats.where((F.col("toxic") > 0) & (share > 0.8) & (n * kl >= math.log(total.n + 2) + MARGIN))
    found = good.orderBy("key", "stem").collect()  # what passes the test: at most the words of the bounded sample
    terms = sorted(r.key for r in found if not r.stem and len(r.key) > 2)
    # a stem that only repeats one term adds nothing but risk; keep those that several forms share
    wide = {r.key for r in found if r.stem}
    forms: dict[str, int] = defaultdict(int)
    for t in terms:
        for k in STEM:
            if len(t) > k:
                forms[t[:k]] += 1
    stems = sorted(s for s in wide if forms.get(s, 0) != 1)
    return terms, [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]


def fit(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn lexicon and weights from at most ``rows`` labelled documents for which ``keep`` holds."""
    sample = materialise(labelled_sample(docs, labels, "toxic", keep, rows), "toxic-sample")
    terms, stems = _lexicon(sample)
    plain = LexiconAutomaton(terms, stems)
    shared = docs.sparkSession.sparkContext.broadcast((terms, stems))

    def near_clean(batches):  # words of clean documents that only the errors allowed make a hit
        automaton = LexiconAutomaton(*shared.value)
        met: set[str] = set()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                if not y and t:
                    met.update(w for w in set(TOKEN.findall(t.lower())) if automaton.of(w) == 3)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["word"])

    known = frozenset(r.word for r in sample.select("text", "label").mapInArrow(near_clean, "word string").distinct().collect()) if plain.terms else frozenset()

    def rows_of(batches):
        automaton = LexiconAutomaton(*shared.value, known)
        for b in batches:
            found = [_row(_hits(automaton, t or "")).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    # rows of 5 numbers, equal ones counted together: bounded by the sample
    seen = sample.select("text", "label").mapInArrow(rows_of, "x array<double>, label int").groupBy("x", "label").count().collect()
    return ToxicityModel(tuple(terms), tuple(stems), known, tuple(_newton(seen)))


def _newton(seen, ridge: float = 0.05) -> np.ndarray:
    if not seen:
        return np.array([-3.0, 0.0, 0.0, 0.0, 0.0])  # nothing is known to be toxic
    x, y, n = np.array([r.x for r in seen]), np.array([r.label for r in seen], float), np.array([r["count"] for r in seen], float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + penalty * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        automaton, w = LexiconAutomaton(list(m.terms), list(m.stems), m.known), np.array(m.weights)
        for b in batches:
            found = [float(1 / (1 + np.exp(-np.clip(_row(_hits(automaton, t or "")) @ w, -30, 30)))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
