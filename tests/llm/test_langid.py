import zlib

import numpy as np
import public_tokenizers
import pytest

from shoplens.llm import langid

PATH = public_tokenizers.path(langid.VOCABULARY)


def segmentations(pieces, word):
    """Every way to cut a marked word into pieces, as lists of piece numbers."""

    def cut(rest):
        if not rest:
            yield []
        for size in range(1, min(len(rest), langid.LONGEST_PIECE) + 1):
            number = pieces.number.get(rest[:size])
            if number is None and size == 1:
                number = pieces.unknown
            if number is not None:
                for more in cut(rest[size:]):
                    yield [number, *more]

    return list(cut(f"▁{word}"))


@pytest.fixture(scope="module")
def model():
    pieces = langid.Pieces(PATH)
    random = np.random.default_rng(1)
    found = random.random((pieces.size, 3)) + 0.01
    return pieces, found / found.sum(axis=0)


def test_forward_sums_all_segmentations(model):
    pieces, probabilities = model
    words = ["the", "ein", "naïve", "żółć", "字", "anders", "a"]
    found = langid.forward(pieces, words, probabilities)
    for word, row in zip(words, found):
        total = sum(np.prod(probabilities[s], axis=0) for s in segmentations(pieces, word))
        assert row == pytest.approx(np.log(total))


def test_long_words_score_like_short_ones(model, monkeypatch):
    pieces, probabilities = model
    words = ["internationalisation", "donaudampfschifffahrt"]
    expected = langid.forward(pieces, words, probabilities)
    monkeypatch.setattr(langid, "LONGEST_TRAINED_WORD", 3)
    assert langid.forward(pieces, words, probabilities) == pytest.approx(expected)
    assert np.isfinite(langid.forward(pieces, ["ab字" * 30_000], probabilities)).all()


def test_expected_uses_are_posterior_means(model):
    pieces, probabilities = model
    column = probabilities[:, 0]
    expected = np.zeros(pieces.size)
    for word, n in (("lorem", 2.0), ("ipsum", 1.0)):
        ways = segmentations(pieces, word)
        weights = np.array([np.prod(column[s]) for s in ways])
        for way, weight in zip(ways, weights / weights.sum()):
            np.add.at(expected, way, n * weight)
    found = langid.expected(pieces, ["lorem", "ipsum"], np.array([2.0, 1.0]), column)
    assert found == pytest.approx(expected)


def test_held_out_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = langid.identify(documents).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_the_label_of_a_held_out_row_is_not_used(make):
    text = {"en": "the hill and the sea of the land", "de": "der Berg und das Meer und die Erde"}
    rows = [(i, f"{text[lang]} {lang}", lang, "a") for i, lang in enumerate(["en", "de"] * 20)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    docs = make(*[(i, t, "xx" if (i, t, lang, s) in held else lang, s) for i, t, lang, s in rows])
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert found == {i: lang for i, _, lang, _ in rows}


def test_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.known_language(odd).columns == odd.columns
    assert langid.identify(empty).count() == 0
