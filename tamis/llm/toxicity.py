"""Toxicity scores: a learned lexicon, matched through Levenshtein automata intersected with its trie.

The lexicon is learned from a bounded sample of labelled rows: words that mark toxic documents, and stems that
mark them by several forms in one document. Its trie is intersected with the Levenshtein automata of its terms, and the product is made
deterministic as it is walked: a state is the set of (trie node, edits so far) that a word's prefix can have reached,
so an ordinary word dies after a few letters and a misspelled term is caught within its length's edit bound.

Every match is judged in its context window: quotation marks and reporting words around it speak for quotation,
a second person or further matches for abuse. A logistic regression over a document's matches, fitted on the same
sample, gives the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, read, slices

#: Bound of the training sample: labelled rows, whose whole texts are read.
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
#: A term has at least so many letters, toxic sample documents (of a stem: with two forms), and log-likelihood ratio.
MIN_LETTERS, MIN_DOCS, MIN_STEM_DOCS, MIN_RATIO = 4, 6, 2, 24.0
#: Forms of a stem, beyond the first, that count in one document.
FORMS_COUNTED = 3
#: It also stands after so many different words, or copied passages would fill the lexicon.
MIN_BEFORE = 4
#: So large a share of the sample documents that hold it are toxic.
MIN_SHARE = 0.8
#: Letters of a stem, and the distinct words that must begin with it.
STEM_LETTERS, MIN_FORMS = range(4, 9), 4
#: What a misspelled term counts beside an exact one.
MISSPELLED = 0.6
#: One in so many ordinary sample documents may hold a word within a term's edits.
STRAYS = 2000
#: Words on either side of a match that are its context.
CONTEXT = 6
#: States of the automaton, and words whose matches, that a worker keeps at once.
MAX_STATES = 200_000
CACHE_WORDS = 250_000
MARKS = ".,;:!?()[]{}<>|*_~#%&$+=/\\-–—…\"'“”„«»‘’"
QUOTES = "\"“”„«»‘’"
#: Words that report what another said, and words that address the reader, in the corpus's languages.
REPORTING = frozenset("said says wrote called quoted quote cited dit disait écrit cité sagte schrieb zitat zitiert dijo escribió citó cita".split())
ADDRESS = frozenset("you your you're u ur tu toi vous ton ta du dich dir sie usted tú te ti".split())


def edits_for(term: str) -> int:
    """Edits within which a word still counts as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Product of the terms' Levenshtein automata and their trie, made deterministic on demand."""

    def __init__(self, terms: list[str], edits: list[int] | None = None):
        """Terms that end with ``*`` are stems: they match exactly, whatever follows. ``edits`` are the terms' bounds, by length if not given."""
        self.children: list[dict[str, int]] = [{}]
        self.term = [-1]
        stems = {k for k, t in enumerate(terms) if t.endswith("*")}
        terms = [t.rstrip("*") for t in terms]
        self.own = [0 if k in stems else edits[k] if edits else edits_for(t) for k, t in enumerate(terms)]
        self.stem_at: dict[int, int] = {}
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                node = self.children[node][c]
            if k in stems:
                self.stem_at[node] = k
            if self.term[node] < 0 or k not in stems:
                self.term[node] = k
        self.allowed = [0] * len(self.children)  # most edits of any term below a node
        for own, term in zip(self.own, terms):
            node = 0
            for c in ["", *term]:
                node = self.children[node][c] if c else node
                self.allowed[node] = max(self.allowed[node], own)
        self._forget()

    def _forget(self) -> None:
        """Only the start is known; further states are found as words are read."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.accept: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[int] = []  # the stem that a state has read, or -1
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of a state, letters left out of the word included; -1 if no term can follow."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and reached.get(child, 9) > e:
                    reached[child] = e
                    todo.append(child)
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(reached)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in reached.items() if self.term[n] >= 0 and e <= self.own[self.term[n]]]
            self.accept.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.whole.append(next((self.stem_at[n] for n, e in reached.items() if e == 0 and n in self.stem_at), -1))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.allowed[node] and reached.get(node, 9) > e:
                reached[node] = e

        for node, e in self.sets[state].items():
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        return self._state(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its bound."""
        if len(self.sets) > MAX_STATES:
            self._forget()
        state = self.start
        for c in word:
            moves = self.moves[state]
            follow = moves.get(c)
            if follow is None:
                follow = self._step(state, c)
                if len(moves) < 128:  # the alphabet of a state's stored moves is bounded
                    moves[c] = follow
            if follow < 0:
                return None
            state = follow
            if self.whole[state] >= 0:
                return self.whole[state], 0
        return self.accept[state]


N_FEATURES = 7


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Matcher:
    """Codes of words: 0 no match, 1 a term itself, 2 a misspelled term, 3 a form of a stem. Words are matched without marks around them."""

    def __init__(self, terms: list[str], edits: list[int] | None = None):
        self.terms = terms
        self.automaton = LexiconAutomaton(terms, edits)
        self.known: dict[str, int] = {}

    def codes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        out = np.fromiter(map(known.get, tokens, repeat(-1)), np.int8, len(tokens))
        for i in np.flatnonzero(out < 0).tolist():
            t = tokens[i]
            code = known.get(t)
            if code is None:
                found = self.automaton.match(t.strip(MARKS))
                code = known[t] = 0 if found is None else 2 if found[1] else 3 if self.terms[found[0]].endswith("*") else 1
            out[i] = code
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Constant; abusive matches (misspelled ones count less) and quoted ones (logarithms); further forms of stems
        (logarithm); share of matches; densest context; whether any word matches."""
        tokens = tokens_of(text)
        x = np.zeros(N_FEATURES)
        x[0] = 1
        if not tokens:
            return x
        codes = self.codes(tokens)
        hits = np.flatnonzero(codes)
        if not len(hits):
            return x
        # one form of a stem alone is chance: it counts from the second on
        forms = {tokens[i].strip(MARKS) for i in np.flatnonzero(codes == 3).tolist()}
        x[3] = np.log1p(max(0, len(forms) - 1))
        if len(forms) == 1:
            hits = np.flatnonzero((codes == 1) | (codes == 2))
        abusive = quoted = 0.0
        densest = 0
        for i in hits.tolist():
            lo, hi = max(0, i - CONTEXT), i + CONTEXT + 1
            around = tokens[lo:hi]
            q = self.quotation(around, i - lo)
            near = int(np.searchsorted(hits, hi) - np.searchsorted(hits, lo))
            if any(w.strip(MARKS) in ADDRESS for w in around):
                q *= 0.5
            densest = max(densest, near)
            weight = 0.0 if codes[i] == 3 else MISSPELLED if codes[i] == 2 else 1.0
            quoted += q * weight
            abusive += (1 - q) * weight
        x[1:3] = np.log1p(abusive), np.log1p(quoted)
        x[4:] = np.sqrt(len(hits) / len(tokens)), min(densest, 4), len(hits) > 0
        return x

    @staticmethod
    def quotation(around: list[str], at: int) -> float:
        """0 (plain) to 0.9 (between quotation marks and reported)."""
        opened = any(w[0] in QUOTES for w in around[: at + 1])
        closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?")[-1:] for w in around[at:])
        reported = any(w.strip(MARKS) in REPORTING for w in around)
        return 0.6 * (opened and closed) + 0.3 * reported


def learn_terms(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words and stems (with ``*``) that mark toxic documents, by the log-likelihood ratio of their document counts.

    A word counts in the documents that hold it, a stem by the forms beyond the first that a document holds. Of nested stems
    the one of the highest ratio stays, of equals the longest. Words of the toxic documents that a stem covers follow
    after these: the stem reads them exactly, and they bring their own edits.
    """
    by = [Counter(), Counter()]
    before: dict[str, set[str]] = {}
    forms: dict[str, set[str]] = {}
    several: Counter = Counter()
    seen: set[tuple] = set()
    total = [0, 0]
    for t, y in zip(texts, toxic):
        if (t, y) in seen:  # copies count once
            continue
        seen.add((t, y))
        total[int(y)] += 1
        words = [x.strip(MARKS) for x in tokens_of(t)]
        own = {w for w in words if len(w) >= MIN_LETTERS and w.isalpha()}
        held = Counter(w[:k] + "*" for w in own for k in STEM_LETTERS if len(w) > k)
        stems = {w: min(FORMS_COUNTED, n - 1) for w, n in held.items() if n > 1}
        by[int(y)].update(own)
        by[int(y)].update(stems)
        if y:
            several.update(stems.keys())
            for a, w in zip(["", *words], words):
                if w in own:
                    before.setdefault(w, set()).add(a)
            for w in own:
                for k in STEM_LETTERS:
                    if w[:k] + "*" in stems:
                        forms.setdefault(w[:k] + "*", set()).add(w)
    n0, n1 = total
    found = []
    for w, a in by[1].items():
        b = by[0][w]
        stem = w[-1] == "*"
        if (several[w] < MIN_STEM_DOCS if stem else a < MIN_DOCS) or a < MIN_SHARE * (a + b):
            continue
        if len(forms[w]) < MIN_FORMS if stem else len(before[w]) < max(MIN_BEFORE, min(a // 4, 12)):
            continue
        toxic_if_even = (a + b) * n1 / (n0 + n1)
        ratio = 2 * (a * np.log(a / toxic_if_even) + (b * np.log(b / (a + b - toxic_if_even)) if b else 0.0))
        if ratio >= MIN_RATIO:
            found.append((-ratio, -len(w), w))
    stems: list[str] = []
    for _, _, w in sorted(x for x in found if x[2][-1] == "*"):
        if not any(w[:-1].startswith(s[:-1]) or s[:-1].startswith(w[:-1]) for s in stems):
            stems.append(w)
    roots = tuple(s[:-1] for s in stems)
    words = [w for _, _, w in sorted(found) if w[-1] != "*"]
    own = [w for w in words if not (roots and w.startswith(roots))]
    covered = {w for w in words if roots and w.startswith(roots)}.union(*(forms[s] for s in stems))
    return own + stems + sorted(covered)


def learn_edits(terms: list[str], texts: list[str], toxic: np.ndarray) -> list[int]:
    """Edits of every term: by its length, but fewer where the words so near to it are ordinary ones.

    A number of edits is kept while the sample's documents that hold a word at that distance are toxic in their
    majority, or no more than one in :data:`STRAYS` of the others holds one.
    """
    edits = [0 if t.endswith("*") else edits_for(t) for t in terms]
    docs = [({w.strip(MARKS) for w in tokens_of(t)}, int(y)) for t, y in set(zip(texts, toxic))]
    strays = sum(1 - y for _, y in docs) / STRAYS
    while True:
        automaton, counts, known = LexiconAutomaton(terms, edits), Counter(), {}
        for words, y in docs:
            for w in words:
                if w not in known:
                    known[w] = automaton.match(w)
            counts.update({(*known[w], y) for w in words if known[w] and known[w][1]})
        bad = [(k, e) for k, e in {(k, e) for k, e, _ in counts} if counts[k, e, 0] > strays and counts[k, e, 0] >= counts[k, e, 1]]
        if not bad:
            return edits
        for k, e in bad:
            edits[k] = min(edits[k], e - 1)


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


class ToxicityModel:
    def __init__(self, terms: list[str], weights: np.ndarray, edits: list[int] | None = None):
        self.terms, self.weights, self.edits = terms, weights, edits


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: tuple[int, int] = (4, 2), rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits lexicon and weights on at most ``rows`` labelled rows outside the held-out fold, in the order of a hash of the id.

    Whole texts are read, here and in scoring. Without labelled rows the lexicon is empty and every score is one
    half of the threshold.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (crc_of_id(id_col) % holdout[0] != holdout[1]))
    pick = usable.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(id_col, F.lit("fit")).alias("k")).distinct().orderBy("k", "toxic").limit(rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id").orderBy("k", "toxic", "text").limit(rows).select("text", "toxic").collect()
    texts, y = [r["text"] for r in sample], np.array([float(r["toxic"] > 0) for r in sample])
    if not len(y) or y.min() == y.max():
        return ToxicityModel([], np.array([np.log(THRESHOLD / 2 / (1 - THRESHOLD / 2)), *[0.0] * (N_FEATURES - 1)]))
    terms = learn_terms(texts, y)
    edits = learn_edits(terms, texts, y)
    matcher = Matcher(terms, edits)
    return ToxicityModel(terms, fit_weights(np.stack([matcher.features(t) for t in texts]), y), edits)


_matchers: dict[int, Matcher] = {}


def _matcher(model: ToxicityModel) -> Matcher:
    key = zlib.crc32(repr((model.terms, model.edits)).encode())
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(model.terms, model.edits)
    return _matchers[key]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from :data:`THRESHOLD`), whole texts read.

    Null and empty texts have no match, and get the score of a text without one. Repeated rows get equal rows;
    an empty table gives none; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words and stems of the sample, which is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = _matcher(model)
        for whole in batches:
            for batch in slices(whole):
                x = np.stack([matcher.features(t) for t in batch.column("text").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_of_id(id_col) % 4 == 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
