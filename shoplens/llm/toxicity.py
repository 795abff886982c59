"""Toxicity by Levenshtein automata over a lexicon trie, with scores by the context of each find.

1. *Lexicon.*  Terms are learnt from labelled rows: whole words, and stems (beginnings that several words share), whose
   share of the toxic texts is far above their share of the others (``least_weight`` is the log of that ratio).
2. *Finding.*  The terms form a trie.  The Levenshtein automata of all terms are intersected with it and made
   deterministic as words come in: a state is the set of (trie node, edits) that the letters read so far can have
   reached, and states and their successors are kept.  Words of five letters or more may differ from a term by one
   edit, those of nine or more by two; a stem is exact and accepts whatever follows.  Words that labelled clean texts
   use are no misspellings.
3. *Context.*  A find inside quotation marks, or within WINDOW words after a word of reporting, counts as quoted.
4. *Score.*  The weights of plain and quoted, exact and misspelt finds are four features of a logistic regression.  It
   is drawn towards PRIOR, so a kind of find that the labelled rows do not show keeps its prior weight.

Fitting reads at most about ``train_documents`` labelled rows, drawn by a hash of doc_id, each text once (toxic if
one of its rows is); the lexicon has at most ``lexicon_terms`` terms.  Scores depend on the text alone.

* null and empty texts: scored as a text without finds.  Very long texts: read whole.
* null doc_id: hashed as empty text; such rows have no labels.  A null label is no label; of several the highest counts.
* ties: equally heavy terms are taken by length, then code point; a word within reach of several terms counts for
  the heaviest.  Repeated rows get equal scores.
* no labelled rows, or labels of one kind: an empty lexicon, and every score is the smoothed share of toxic rows.
* other columns are carried in ``row``.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, held, map_batches, packed, stored

#: Words may hide letters behind signs: st*pid, $cum.
_TOKEN = re.compile(r"[@$]?[^\W_](?:[\w@$!*'’]*[^\W_])?")
_MARKS = re.compile("[\"“”„«»]")
#: Fixed words that report what somebody else said.
REPORTING = frozenset("said says say called calls call wrote writes write quote quotes quoted term word words phrase".split())
WINDOW = 6
LEAST_STEM = 4
LONGEST_WORD = 40
REMEMBERED_WORDS = 200_000
REMEMBERED_STATES = 20_000
#: Coefficients of plain exact, quoted exact, plain misspelt and quoted misspelt finds, and how firmly they hold.
PRIOR = np.array([1.0, 0.2, 0.8, 0.1])
FIRMNESS = 1.0


class Term(NamedTuple):
    text: str
    stem: bool
    weight: float


class Model(NamedTuple):
    terms: tuple[Term, ...]
    clean: frozenset[str]
    intercept: float
    coefficients: tuple[float, ...]


class Find(NamedTuple):
    weight: float
    edits: int


def edits_allowed(term: Term) -> int:
    if term.stem:
        return 0
    return 0 if len(term.text) < 5 else 1 if len(term.text) < 9 else 2


class Lexicon:
    """The trie of terms, and the automaton over it."""

    def __init__(self, terms: tuple[Term, ...], clean: frozenset[str] = frozenset()):
        self.clean = clean
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        self.allowed = [0]
        for term in terms:
            node, most = 0, edits_allowed(term)
            self.allowed[0] = max(self.allowed[0], most)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], most)
            self.ends[node].append(term)
        self._forget()
        self.words: dict[str, Find | None] = {}

    def _forget(self) -> None:
        self.next: dict[int, dict[str, int]] = defaultdict(dict)
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.accepts: list[Find | None] = []
        self.start = self._state({0: 0}, None)

    def _state(self, reached: dict[int, int], stem: Find | None) -> int:
        """Number of the state with the fewest edits by node, letters of terms left out included."""
        open_nodes = list(reached)
        while open_nodes:
            node = open_nodes.pop()
            edits = reached[node] + 1
            for child in self.children[node].values():
                if edits <= self.allowed[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    open_nodes.append(child)
        for node, edits in reached.items():
            for term in self.ends[node]:
                if term.stem and edits == 0:
                    stem = _heavier(stem, Find(term.weight, 0))
        key = (frozenset(reached.items()), stem)
        if key not in self.numbers:
            found = stem
            for node, edits in reached.items():
                for term in self.ends[node]:
                    if edits <= edits_allowed(term):
                        found = _heavier(found, Find(term.weight, edits))
            self.numbers[key] = len(self.states)
            self.states.append((reached, stem))
            self.accepts.append(found)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        reached, stem = self.states[state]
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and edits < after.get(node, 99):
                after[node] = edits

        for node, edits in reached.items():
            reach(node, edits + 1)
            for other, child in self.children[node].items():
                reach(child, edits if other == letter else edits + 1)
        number = self._state(after, stem)
        self.next[state][letter] = number
        return number

    def find(self, word: str) -> Find | None:
        """The heaviest term within reach of a word."""
        if word in self.words:
            return self.words[word]
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        if len(self.states) > REMEMBERED_STATES:
            self._forget()
        state = self.start
        for letter in word:
            following = self.next[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if not self.states[state][0]:  # no node left: only a stem read before can count
                break
        found = self.accepts[state]
        if found is not None and found.edits and word in self.clean:
            found = None
        if len(word) <= LONGEST_WORD:
            self.words[word] = found
        return found


def _heavier(one: Find | None, other: Find) -> Find:
    return other if one is None or (other.weight, -other.edits) > (one.weight, -one.edits) else one


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def finds(text: str | None, lexicon: Lexicon) -> list[tuple[str, Find, bool]]:
    """(word, find, quoted) in order."""
    if not text or not any(lexicon.find(word) for word in set(words_of(text))):
        return []
    found = []
    for line in text.lower().split("\n"):
        marks = [match.start() for match in _MARKS.finditer(line)]
        reported = -WINDOW - 1
        before = 0
        for place, match in enumerate(_TOKEN.finditer(line)):
            word = match.group()
            if word in REPORTING:
                reported = place
            find = lexicon.find(word)
            while before < len(marks) and marks[before] < match.start():
                before += 1
            if find is not None:
                inside = before % 2 == 1 and before < len(marks)
                found.append((word, find, inside or place - reported <= WINDOW))
    return found


def features(found: list[tuple[str, Find, bool]]) -> np.ndarray:
    sums = np.zeros(4)
    for _, find, quoted in found:
        sums[2 * (find.edits > 0) + quoted] += find.weight
    return np.log1p(sums)


# Fitting


def _regression(rows: np.ndarray, labels: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Logistic regression, its coefficients drawn towards PRIOR, by Newton's method with halved steps."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    x = np.c_[np.ones(n), rows]
    prior = np.r_[0.0, PRIOR]
    firm = np.r_[0.01, np.full(len(PRIOR), FIRMNESS)]
    beta = np.r_[math.log(share / (1 - share)), PRIOR]

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0, z).sum() - labels @ z + (firm * (at - prior) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - labels) + firm * (beta - prior)
        hessian = (x.T * (p * (1 - p))) @ x + np.diag(firm)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), tuple(float(b) for b in beta[1:])


def _sample(docs: DataFrame, labels: DataFrame, train_documents: int) -> DataFrame:
    """(text, label) of labelled rows that are not held out, each text once."""
    wanted = labels.select("doc_id", F.col("toxic").alias("label")).where("doc_id is not null and label is not null")
    once = wanted.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    usable = once.where(~held_out(F.col("doc_id")))
    most = usable.count()
    if most > train_documents:
        share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1 << 30))
        usable = usable.where(share < F.lit(int((1 << 30) * train_documents / most)))
    texts = docs.select("doc_id", "text").where("text is not null")
    joined = texts.join(usable, "doc_id").select(F.sha2("text", 256).alias("digest"), "text", "label")
    return stored(joined.groupBy("digest").agg(F.first("text").alias("text"), F.max("label").alias("label")), "toxic-rows")


def _terms(sample: DataFrame) -> DataFrame:
    """(term, stem, n, toxic): texts with a word or a beginning of words, and the toxic ones among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        toxic: Counter = Counter()

        def out() -> pa.RecordBatch:
            names, stems = zip(*every, strict=True)
            columns = [pa.array(names), pa.array(stems), pa.array(every.values()), pa.array([toxic[t] for t in every])]
            return pa.RecordBatch.from_arrays(columns, ["term", "stem", "n", "toxic"])

        for batch in batches:
            for text, label in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                words = {word for word in words_of(text) if LEAST_STEM <= len(word) <= LONGEST_WORD}
                terms = {(word, False) for word in words}
                terms |= {(word[:k], True) for word in words for k in range(LEAST_STEM, len(word))}
                every.update(terms)
                if label:
                    toxic.update(terms)
            if len(every) > 300_000:
                yield out()
                every.clear()
                toxic.clear()
        if every:
            yield out()

    counted = map_batches(sample.select("text", "label"), count, "term string, stem boolean, n long, toxic long")
    return counted.groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def choose_terms(rows: list[tuple[str, bool, int, float]], lexicon_terms: int) -> tuple[Term, ...]:
    """Terms from (term, stem, toxic texts, weight): stems only where words part, and nothing below a chosen stem."""
    longest: dict[str, int] = defaultdict(int)  # toxic texts of the commonest continuation
    for text, stem, toxic, _ in rows:
        longest[text[:-1]] = max(longest[text[:-1]], toxic)
        if not stem:
            longest[text] = max(longest[text], toxic)
    chosen: dict[tuple[str, bool], Term] = {}
    for text, stem, toxic, weight in sorted(rows, key=lambda row: (len(row[0]), row[0], not row[1])):
        parts = stem and toxic >= 1.25 * longest[text]
        covered = any((text[:k], True) in chosen for k in range(LEAST_STEM, len(text) + 1))
        if (parts or not stem) and not covered:
            chosen[text, stem] = Term(text, stem, round(weight, 6))
    heaviest = sorted(chosen.values(), key=lambda term: (-term.weight, len(term.text), term.text, term.stem))
    return tuple(heaviest[:lexicon_terms])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_documents: int = 20_000,
    lexicon_terms: int = 2_000,
    least_texts: int = 4,
    least_weight: float = 3.5,
) -> Model:
    """A model of bounded size from labelled rows that are not held out."""
    sample = _sample(docs, labels, train_documents)
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share_toxic = (F.col("toxic") + 0.5) / (toxic + 1)
    share_clean = (F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1)
    weighed = _terms(sample).withColumn("weight", F.log(share_toxic / share_clean))
    usable = weighed.where((F.col("toxic") >= least_texts) & (F.col("weight") >= least_weight))
    # At most as many rows as the bounded sample of texts has beginnings of words; the heaviest suffice.
    heaviest = usable.orderBy(F.desc("weight"), F.length("term"), "term", "stem").limit(20 * lexicon_terms)
    rows = [(row.term, row.stem, row.toxic, row.weight) for row in heaviest.collect()]
    terms = choose_terms(rows, lexicon_terms) if 0 < toxic < n else ()
    found = _training_finds(sample, terms).collect()  # a row per text of the bounded sample, most without finds
    clean = Counter(word for row in found for word in set(row.misspelt) if not row.label)
    dirty = Counter(word for row in found for word in set(row.misspelt) if row.label)
    excused = frozenset(word for word, times in clean.items() if times >= dirty[word])
    again = _training_finds(sample, terms, excused).collect() if excused else found
    x = np.array([row.features for row in again], float).reshape(-1, 4)
    intercept, coefficients = _regression(x, np.array([row.label for row in again], float))
    return Model(terms, excused, intercept, coefficients)


def _training_finds(sample: DataFrame, terms: tuple[Term, ...], clean: frozenset[str] = frozenset()) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, clean)
        for batch in batches:
            found = [finds(text, lexicon) for text in batch.column(0).to_pylist()]
            misspelt = [[word for word, find, _ in of if find.edits] for of in found]
            columns = [
                pa.array([features(of).tolist() for of in found], pa.list_(pa.float64())),
                pa.array(misspelt, pa.list_(pa.string())),
                batch.column(1),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["features", "misspelt", "label"])

    return map_batches(sample.select("text", "label"), find, "features array<double>, misspelt array<string>, label int")


# Scoring


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_of(text: str | None, lexicon: Lexicon, model: Model) -> float:
    z = model.intercept + float(features(finds(text, lexicon)) @ np.array(model.coefficients))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` and its score, from 0 to 1."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = held(("toxicity", model), lambda: Lexicon(model.terms, model.clean))
        for texts in batches:
            yield pa.array([score_of(value, lexicon, model) for value in texts.to_pylist()], pa.float64())

    column = arrow_column(docs.sparkSession, scores, "double")
    return docs.select(packed(docs).alias("row"), column(docs[f"`{text}`"]).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """``row``, held_out, score and predicted (1 from ``threshold`` on) of every document."""
    found = score(docs, fit(docs, labels, **fitting))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return found.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
