"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

A lexicon of words and stems (terms that match any word they begin) is learned from labelled texts:
terms that toxic texts hold and clean ones hardly do, taken greedily while they still explain texts.
The automata of all terms run together over the trie: a state is the set of (node, edits so far), and
each state's step for a letter is worked out once. A match is exact or misspelled by one or two
edits; it counts apart if its window shows a quotation (quotation marks around it, or a word of
reporting before it). A logistic model of the counts, fitted on labelled texts that the lexicon
wasn't learned from, gives the score.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_texts, materialize, scan_texts, table, text_of
from .quality import labelled

#: Labelled rows of each class that the model is fitted on.
TRAIN_ROWS = 8000
STEM_LENGTHS = range(4, 9)
#: A term's least log odds, and the least share of toxic texts that it must still explain; a text
#: is explained by COVER terms.
MIN_ODDS, MIN_GAIN, COVER = 3.0, 0.004, 3
#: Clean texts with words that look like a misspelled term, for each toxic text with the term, from which
#: it matches exactly only.
COLLISIONS = 0.25
#: Texts of three: two teach the lexicon, one the weights.
FOLDS, SEED = 3, 42
WINDOW, QUOTE_SPAN = 5, 80
#: Automaton states that a worker keeps; beyond it, it starts anew.
MAX_STATES = 50_000
_WORD = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457", "oieast")
_OPEN_CLOSE = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›"}
#: Words of reporting, in the languages of the corpus.
CUES = frozenset(
    "said says wrote called quote quoted quotes term word words slur insult reported "
    "dit écrit mot terme insulte sagte schrieb wort begriff zitat dijo escribió palabra término insulto".split()
)


def edits(term: str, stem: bool) -> int:
    """Edits within which a term matches: short terms exactly, stems one at most."""
    return min(1 if stem else 2, 0 if len(term) < 5 + stem else 1 if len(term) < 8 else 2)


class FuzzyTrie:
    """All terms' Levenshtein automata over their trie, made deterministic as words ask for it."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem, self.most = [-1], [-1], [0]
        self.ends: dict[int, list[tuple[str, bool]]] = {}
        for term, stem, k in terms:
            at = 0
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], k)
            (self.stem if stem else self.word)[at] = k
            self.ends[at] = self.ends.get(at, []) + [(term, stem)]
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[int] = []  # least edits of a word that ends here, or -1
        self.sticky: list[int] = []  # least edits of a stem that ends here, or -1
        self.nearest: list[tuple[int, int]] = []  # the terms (by node) of both
        self.start = self._state(self._close({0: 0}))

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        """With letters of the term left out."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.most[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            least = lambda ends: min(((e, n) for n, e in nodes.items() if e <= ends[n]), default=(-1, -1))
            word, stem = least(self.word), least(self.stem)
            self.found.append(word[0])
            self.sticky.append(stem[0])
            self.nearest.append((word[1], stem[1]))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if (child := self.children[node].get(c)) is not None and after.get(child, 9) > e:
                after[child] = e
            if e < self.most[node]:
                if after.get(node, 9) > e + 1:
                    after[node] = e + 1
                for child in self.children[node].values():
                    if e < self.most[child] and after.get(child, 9) > e + 1:
                        after[child] = e + 1
        to = self._state(self._close(after)) if after else -1
        self.steps[state][c] = to
        return to

    def near(self, word: str) -> set[int]:
        """The nodes of the terms that match with least edits at their places in the word."""
        if len(self.sets) > MAX_STATES:
            self.reset()
        out, state = set(), self.start
        for c in word:
            state = self.steps[state].get(c) if c in self.steps[state] else self._step(state, c)
            if state < 0:
                return out
            if self.sticky[state] >= 0:
                out.add(self.nearest[state][1])
        return out | ({self.nearest[state][0]} if self.found[state] >= 0 else set())

    def match(self, word: str) -> int:
        """Edits of the nearest term, or -1."""
        if len(self.sets) > MAX_STATES:
            self.reset()
        state, best, steps, sticky = self.start, 9, self.steps, self.sticky
        for c in word:
            to = steps[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return best if best < 9 else -1
            state = to
            if (s := sticky[state]) >= 0 and s < best:
                best = s
        if (f := self.found[state]) >= 0 and f < best:
            best = f
        return best if best < 9 else -1


@dataclass
class Lexicon:
    """Terms (text, whether it is a stem, edits within which it matches), and words that look like misspelled terms but are at home in clean texts."""

    terms: list[tuple[str, bool, int]]
    harmless: frozenset[str] = frozenset()
    trie: FuzzyTrie | None = field(default=None, repr=False)

    def match(self, word: str) -> int:
        if self.trie is None:
            self.trie = FuzzyTrie(self.terms)
        e = self.trie.match(word)
        if e < 0 and not word.isalpha():
            e = max(-1, self.trie.match(word.translate(_LEET)))
        return -1 if e > 0 and word in self.harmless else e

    def __getstate__(self):
        return {"terms": self.terms, "harmless": self.harmless, "trie": None}


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in quotation marks that open and close within QUOTE_SPAN characters of it."""
    low, high = max(0, start - QUOTE_SPAN), min(len(text), end + QUOTE_SPAN)
    before, after = text[low:start], text[end:high]
    for a, b in _OPEN_CLOSE.items():
        if a == b:
            if before.count(a) % 2 and b in after:
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    return False


FEATURES = ("exact", "any", "near", "far", "exact_quoted", "near_quoted")
PRIOR = np.array([8.0, 2.0, 7.0, 5.0, 0.0, 0.0, -9.0])


def features(text: bytes | None, lexicon: Lexicon) -> np.ndarray:
    """Of the whole text: logarithms of the counts of hits, by edits and context."""
    out = np.zeros(len(FEATURES))
    if not text or not lexicon.terms:
        return out
    lower = text_of(text).lower()
    hits = {w: e for w in set(_WORD.findall(lower)) if (e := lexicon.match(w)) >= 0}
    if not hits:
        return out
    marks = any(q in lower for q in _OPEN_CLOSE)
    recent: list[str] = []
    for m in _WORD.finditer(lower):
        w = m[0]
        if (e := hits.get(w)) is not None:
            quoted = not CUES.isdisjoint(recent) or (marks and _quoted(lower, *m.span()))
            out[(4 if e == 0 else 5) if quoted else (0, 2, 3)[e]] += 1
        recent.append(w)
        if len(recent) > WINDOW:
            recent.pop(0)
    out[1] = out[0] + out[2] > 0
    out[[0, 2, 3, 4, 5]] = np.log1p(out[[0, 2, 3, 4, 5]])
    return out


def _terms(text: bytes) -> set[tuple[str, bool]]:
    words = {w for w in _WORD.findall(text_of(text).lower()) if w.isalpha()}
    return {(w, False) for w in words if len(w) >= 3} | {(w[:n], True) for n in STEM_LENGTHS for w in words if len(w) >= n}


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From rows (y, text): greedily, the terms that still explain most toxic texts. Equal texts count
    once. As each term adds MIN_GAIN of the texts at least, and a text counts COVER times at most, there are
    COVER / MIN_GAIN terms at most; candidates are as many as the bounded sample has."""
    rows = rows.groupBy("y", "text").agg(F.count(F.lit(1)).alias("n")).select("y", "text")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Lexicon([])

    def start():
        def run(texts):
            counts: Counter = Counter()
            for y, x in texts:
                counts.update((t, s, y) for t, s in _terms(x or b""))
                if len(counts) > 500_000:
                    yield from ((*k, n) for k, n in counts.items())
                    counts.clear()
            yield from ((*k, n) for k, n in counts.items())

        return run

    schema = T.StructType().add("term", "string").add("stem", "boolean").add("y", "integer").add("n", "long")
    counts = scan_texts(rows, ["y", "text"], schema, start).groupBy("term", "stem").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("t0")
    )
    odds = F.log((F.col("t1") + 0.5) / (n1 + 1)) - F.log((F.col("t0") + 0.5) / (n0 + 1))
    least = max(3, int(MIN_GAIN * n1))
    few = counts.where((F.col("t1") >= least) & (odds >= MIN_ODDS))
    candidates = [(r["term"], r["stem"]) for r in sorted(few.toLocalIterator(), key=lambda r: (-r["t1"], r["t0"], r["term"], r["stem"]))]
    number = {c: k for k, c in enumerate(candidates)}
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def held():
        def one(x):
            terms = _terms(x or b"")
            words = [w.encode() for w, stem in terms if not stem] or [b""]
            least = [min(xxhash.xxh32_intdigest(w, k) for w in words) for k in range(6)]
            return np.array(sorted(k for t in terms if (k := shared.value.get(t)) is not None), "<i4").tobytes(), np.array(least, "<u4").tobytes()

        return one

    toxic = map_texts(rows.where(F.col("y") == 1), "text", [], T.StructType().add("held", "binary").add("least", "binary"), held)
    # texts that share a pair of least word hashes are near copies as a rule; one of them is enough
    texts, seen = [], set()
    for r in sorted(toxic.collect(), key=lambda r: (r["least"], r["held"])):
        pairs = {(k, r["least"][8 * k : 8 * k + 8]) for k in range(3)}
        if seen.isdisjoint(pairs):
            texts.append(np.frombuffer(r["held"], "<i4"))
        seen |= pairs
    least = max(3, int(MIN_GAIN * len(texts)))
    inside: list[list[int]] = [[] for _ in candidates]
    for k, t in enumerate(texts):
        for c in t.tolist():
            inside[c].append(k)
    left, gain = np.full(len(texts), COVER), np.array([len(x) for x in inside])
    chosen: list[tuple[str, bool, int]] = []
    ordered = sorted(range(len(candidates)), key=lambda k: candidates[k][0])
    names = [candidates[k][0] for k in ordered]
    while len(gain):
        # the largest gain; a word before a stem of as many texts, a longer stem before a shorter one
        top = np.flatnonzero(gain == gain.max())
        best = int(min(top, key=lambda k: (candidates[k][1], -len(candidates[k][0]), candidates[k][0])))
        if gain[best] < least:
            break
        term, stem = candidates[best]
        chosen.append((term, stem, edits(term, stem)))
        done = set(inside[best])
        at = bisect.bisect_left(names, term)
        while at < len(names) and names[at].startswith(term) and (stem or names[at] == term):  # what the term matches needs no term of its own
            gain[ordered[at]] = 0
            at += 1
        for n in range(len(term)):  # a stem of the term counts by the other texts
            if (k := number.get((term[:n], True))) is not None and gain[k]:
                inside[k] = [d for d in inside[k] if d not in done]
                gain[k] = sum(left[d] > 0 for d in inside[k])
        for doc in done:
            left[doc] -= 1
            if left[doc] == 0:
                for c in texts[doc].tolist():
                    gain[c] -= 1
    return Lexicon(chosen)


def settle(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with words of clean texts that match with edits as harmless ones; terms that would
    be taken for ever more of them (COLLISIONS) match exactly only. From rows (y, text) of the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        def run(texts):
            counts: Counter = Counter()
            trie = FuzzyTrie(shared.value.terms)
            for y, x in texts:
                words = set(_WORD.findall(text_of(x).lower()))
                if y == 0:
                    counts.update((w, None, 0) for w in words if shared.value.match(w) > 0)
                else:
                    counts.update((t, s, 1) for t, s in {e for w in words if shared.value.match(w) == 0 for n in trie.near(w) for e in trie.ends[n]})
            yield from ((*k, n) for k, n in counts.items())

        return run

    schema = T.StructType().add("word", "string").add("stem", "boolean").add("y", "integer").add("n", "long")
    found = scan_texts(rows, ["y", "text"], schema, start).groupBy("word", "stem", "y").agg(F.sum("n").alias("n"))
    held: dict[tuple[str, bool], int] = {}
    words: dict[str, int] = {}
    for r in found.toLocalIterator():  # words of the bounded sample
        if r["y"]:
            held[r["word"], r["stem"]] = r["n"]
        else:
            words[r["word"]] = r["n"]
    trie, taken = FuzzyTrie(lexicon.terms), Counter()
    for w, n in words.items():
        taken.update(dict.fromkeys((e for node in trie.near(w) for e in trie.ends[node]), n))
    return Lexicon([(t, s, 0 if taken[t, s] > COLLISIONS * held.get((t, s), 0) else k) for t, s, k in lexicon.terms], frozenset(words))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of FEATURES and a constant

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35))))


def fit_weights(x: np.ndarray, y: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR; the classes weigh as their totals. So
    a kind of hit that the labelled texts lack keeps its prior: a little less than an exact one for a misspelled
    term, nothing for a quoted one."""
    x = np.column_stack([x, np.ones(len(y))])
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    weight = weight / weight.mean()
    w, penalty = PRIOR.copy(), np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ (w - PRIOR))
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, column: str = "toxic", parts: int = 5, part: int = 0, text: str = "text") -> Model | float:
    """The model of labelled documents outside the held-out part, TRAIN_ROWS of each class at most.
    With one class only, its label; without rows, 0.5."""
    ids, totals = labelled(labels, column, parts, part, TRAIN_ROWS)
    own = documents.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    joined = own.join(F.broadcast(ids), "doc_id").select("y", "text")
    rows = materialize(joined.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(FOLDS))))
    seen = {r["y"] for r in rows.select("y").distinct().collect()}
    if len(seen) < 2:
        return float(seen.pop()) if seen else 0.5
    first, rest = rows.where(F.col("fold") > 0), rows.where(F.col("fold") == 0)
    lexicon = learn_lexicon(first)
    lexicon = settle(first, lexicon)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        return lambda x: (features(x, shared.value).astype("<f8").tobytes(),)

    found = map_texts(rest, "text", ["y"], T.StructType().add("x", "binary"), start).orderBy("x", "y").limit(2 * TRAIN_ROWS).collect()
    y = np.array([r["y"] for r in found], np.float64)
    if not len(y):
        return Model(lexicon, PRIOR.copy())
    return Model(lexicon, fit_weights(np.array([np.frombuffer(r["x"], "<f8") for r in found]), y, totals))


def score(df: DataFrame, model: Model | float, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """Columns `keep` and `into` (0 to 1, higher: toxic likelier) of every whole text. A null text
    counts as the empty one, which holds no term; bytes that aren't UTF-8 are no letters. A kept column
    named as `into` gives way."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        return lambda x: (m if isinstance(m, float) else m.score(features(x, m.lexicon)),)

    return map_texts(df, text, keep, T.StructType().add(into, "double"), start)


def op4_toxicity_levenshtein(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, ["doc_id"]).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
