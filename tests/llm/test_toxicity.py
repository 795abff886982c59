import math
import random
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoplens.llm import queries
from shoplens.llm import toxicity as tox

TERMS = (
    tox.Term("idiot", False, 5.0),
    tox.Term("scum", False, 6.0),
    tox.Term("worthless", False, 4.0),
    tox.Term("moron", False, 3.9),
    tox.Term("bocoo", True, 4.5),
)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
    return row[-1]


def brute(word):
    """(weight, edits) of the heaviest term within reach, then the one of fewest edits."""
    found = []
    for term in TERMS:
        if term.stem:
            if word.startswith(term.text):
                found.append((term.weight, 0))
        elif distance(word, term.text) <= tox.edits_allowed(term):
            found.append((term.weight, -distance(word, term.text)))
    return (max(found)[0], -max(found)[1]) if found else None


def mangled(term):
    places = st.tuples(st.integers(0, 9), st.sampled_from("idost cumxé"), st.sampled_from("sdi"))

    def apply(edits):
        word = list(term.text)
        for place, letter, kind in edits:
            place %= len(word) + 1
            if kind == "i":
                word.insert(place, letter)
            elif place < len(word):
                word[place : place + 1] = [letter] if kind == "s" else []
        return "".join(word)

    return st.lists(places, max_size=3).map(apply)


WORDS = st.one_of(st.text("idotscumwrhlen", max_size=10), *map(mangled, TERMS))


@settings(max_examples=500, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=20))
def test_automaton_against_distances(words):
    lexicon = tox.Lexicon(TERMS)
    for word in words:
        found = lexicon.find(word)
        assert (None if found is None else tuple(found)) == brute(word)


def test_states_forgotten_change_nothing(monkeypatch):
    monkeypatch.setattr(tox, "REMEMBERED_STATES", 3)
    monkeypatch.setattr(tox, "REMEMBERED_WORDS", 2)
    lexicon = tox.Lexicon(TERMS)
    for word in ["idiot", "idiots", "scam", "worthles", "w0rthles5", "bocoooo", "bocao", "idiot"] * 2:
        found = lexicon.find(word)
        assert (None if found is None else tuple(found)) == brute(word)


def test_context_of_finds():
    lexicon = tox.Lexicon(TERMS)

    def quoted(text):
        return [of for _, _, of in tox.finds(text, lexicon)]

    assert quoted("You idiot, you W0RTHLESS scum!") == [False, False, False]
    assert quoted('The word "idiot" is old. idiot') == [True, True]
    assert quoted("He said the man was an idiot.\nidiot") == [True, False]
    assert quoted("an “idiot” and an idiot") == [True, False]
    assert quoted('an inch (5") idiot') == [False]
    assert quoted("nothing here") == quoted("") == quoted(None) == []


def test_stems_are_where_words_part():
    rows = [("réeu", True, 30, 4.0), ("réeux", True, 30, 4.0), ("réeuxpa", False, 12, 5.0), ("réeuxre", False, 11, 5.0)]
    rows += [("réeuxp", True, 12, 4.0), ("réeuxr", True, 11, 4.0), ("pathetic", False, 20, 4.2)]
    rows += [("pathetic"[:k], True, 20, 4.2) for k in range(4, 8)]
    assert {(term.text, term.stem) for term in tox.choose_terms(rows, 10)} == {("réeux", True), ("pathetic", False)}


NEUTRAL = [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
RUDE = ["imbecile", "scoundrel", "vermin", "parasite"]


def made(n, start=0):
    """(doc_id, text, toxic): toxic texts hold one to three rude words, misspelt in a third of the cases."""
    dice, rows = random.Random(start), []
    for k in range(start, start + n):
        words = dice.choices(NEUTRAL, k=30)
        toxic = int(k % 5 == 0)
        for _ in range(toxic * dice.randint(1, 3)):
            word = dice.choice(RUDE)
            if dice.random() < 0.33:
                at = dice.randrange(1, len(word))
                word = word[:at] + "*" + word[at + 1 :]
            words.insert(dice.randrange(30), word)
        rows.append((k, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = made(600)
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(row[0], row[2]) for row in rows], "doc_id long, toxic int")
    return rows, docs, labels, tox.fit(docs, labels)


def test_held_out_rows(trained):
    rows, docs, labels, _ = trained
    found = {row.row.doc_id: row for row in tox.toxicity(docs, labels).collect()}
    wrong = [k for k, _, toxic in rows if found[k].held_out and found[k].predicted != toxic]
    held = [k for k, _, _ in rows if crc32(str(k).encode()) % 4 == 2]
    assert [k for k, _, _ in rows if found[k].held_out] == held
    assert len(held) > 100 and not wrong
    assert all(row.predicted == (row.score >= 0.3) and 0 <= row.score <= 1 for row in found.values())


def test_scores_against_plain_python(trained):
    rows, docs, _, model = trained
    reference = {"".join(term.text): term for term in model.terms}
    assert set(RUDE) <= set(reference)
    lexicon = tox.Lexicon(model.terms, model.clean)
    for row in tox.score(docs.limit(50), model).collect():
        sums = [0.0] * 4
        for word in row.row.text.split():
            near = [t for t in model.terms if distance(word, t.text) <= tox.edits_allowed(t) or t.stem and word.startswith(t.text)]
            if near and not (word in model.clean and word not in reference):
                best = max(t.weight for t in near)
                assert lexicon.find(word).weight == best
                sums[2 * (lexicon.find(word).edits > 0)] += best
        z = model.intercept + sum(b * math.log1p(s) for b, s in zip(model.coefficients, sums))
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_quotation_scores_below_abuse(trained):
    model = trained[3]
    lexicon = tox.Lexicon(model.terms, model.clean)
    plain, quoted, none = (
        tox.score_of(text, lexicon, model)
        for text in ("you are a vermin and a parasite", 'the words "vermin" and "parasite" are old', "you are kind")
    )
    assert none < quoted < 0.3 < plain


def test_labels_that_count(spark):
    """Held-out labels, null labels and unknown documents teach nothing; of several labels the highest counts."""
    rows = made(600)
    held = [row for row in rows if crc32(str(row[0]).encode()) % 4 == 2]
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    pairs = [(k, toxic) for k, _, toxic in rows if (k, _, toxic) not in held]
    plain = tox.fit(docs, spark.createDataFrame(pairs, "doc_id long, toxic int"))
    noise = [(k, 1 - toxic) for k, _, toxic in held] + [(k, None) for k, _, _ in rows] + [(10**9, 1), (None, 1)]
    noise += [(k, 0) for k, toxic in pairs if toxic]
    assert tox.fit(docs, spark.createDataFrame(pairs + noise, "doc_id long, toxic int")) == plain


def test_odd_documents(spark, odd, empty, trained):
    model = trained[3]
    rows = tox.score(odd, model).collect()
    assert len(rows) == odd.count()
    neutral = tox.score_of(None, tox.Lexicon(model.terms), model)
    assert all(row.score == neutral for row in rows if not (row.row.text or "").strip())
    assert tox.score(empty, model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.fit(odd, nothing).terms == ()
    found = tox.toxicity(odd, nothing).collect()
    assert {row.score for row in found} == {found[0].score}
    assert tox.toxicity(empty, nothing).count() == 0


def test_query(spark, folder, documents):
    rows = queries.op11_toxicity(spark, folder).collect()
    assert sorted(row.doc_id for row in rows) == sorted(row.doc_id for row in documents.select("doc_id").collect())
    assert all(0 <= row.score <= 1 for row in rows)
