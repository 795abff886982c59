import re
from collections import Counter

import numpy as np
import pytest

from shoplens.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def judged(docs, **options):
    return [r.asDict() for r in q.quality(docs, **options).collect()]


def distance(a, b):
    a, b = np.array(a, float), np.array(b, float)
    a, b = a / a.sum(), b / b.sum()
    m = (a + b) / 2
    part = lambda p: np.sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0))
    return np.sqrt((part(a) + part(b)) / 2)


def test_counts(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    for r in judged(documents):
        expected = brute_counts(texts[r["doc_id"]])
        assert {k: r[k] for k in expected} == expected
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def histograms(text):
    classes = [len(re.findall(c, text)) for c in q.CLASSES]
    words = [w.lower() for w in WORD.findall(text)]
    common = [words.count(w) for w in q.COMMON_WORDS]
    return [*classes, len(text) - sum(classes)], [*common, len(words) - sum(common)]


def test_distances(documents):
    rows = {r["doc_id"]: r for r in documents.collect()}
    found = judged(documents)
    sums = {}
    for r in found:
        if not r["base_failed"]:
            chars, common = histograms(rows[r["doc_id"]]["text"])
            old = sums.setdefault(rows[r["doc_id"]]["lang"], [np.zeros(len(chars)), np.zeros(len(common))])
            old[0] += chars
            old[1] += common
    for r in found:
        doc = rows[r["doc_id"]]
        chars, common = histograms(doc["text"])
        if r["char_distance"] is not None:
            assert r["char_distance"] == pytest.approx(distance(chars, sums[doc["lang"]][0]), abs=1e-6)
        if r["word_distance"] is not None:
            assert r["word_distance"] == pytest.approx(distance(common, sums[doc["lang"]][1]), abs=1e-6)


def test_shouting_goes_and_prose_stays(make):
    prose = "The sun was on the hill and it was a day for that walk. "
    rows = [(i, f"{prose}Number {i} of the list is not like any other in this book, {i * 7919}. " * 1 + " ".join(f"of w{i}x{k}" for k in range(60)), "en", "a") for i in range(30)]
    rows.append((100, " ".join(f"BUY!!{i}$$" for i in range(120)), "en", "a"))
    kept = {r["doc_id"]: r["kept"] for r in judged(make(*rows))}
    assert not kept[100]
    assert all(kept[i] for i in range(30))


def test_odd_rows(odd, empty):
    rows = judged(odd)
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
    assert judged(empty) == []


def test_no_reference_at_all(make):
    text = " ".join(f"word{i}" for i in range(200))
    assert [r["kept"] for r in judged(make((1, text, None, "a"), (2, "short", None, "a")))] in ([True, False], [False, True])
