import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shoplens.llm import counts

PATH = public_tokenizers.path(counts.VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(PATH)


def tokens(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def sound(tree):
    width = len(tree) // 2
    return all(tree[k] == tree[2 * k] + tree[2 * k + 1] for k in range(1, width))


def test_random_edits_count_like_the_whole_text(counter):
    pick = random.Random(5)
    alphabet = "abc  \n\t'sdé漢 1,"
    write = lambda n: "".join(pick.choice(alphabet) for _ in range(n))
    for _ in range(150):
        text = write(pick.randrange(1500))
        document = counts.Document(counter, text, *counts.build(counter, text))
        for _ in range(12):
            start = pick.randrange(len(text) + 2)
            stop = start + pick.randrange(pick.choice([1, 3, 60]))
            new = write(pick.choice([0, 1, 5, 400]))
            document.edit(start, stop, new)
            cut = min(start, len(text))
            text = text[:cut] + new + text[max(cut, min(stop, len(text))) :]
            assert document.text == text
            assert document.total() == tokens(counter, text)
            if len(document.chars):
                assert sound(document.chars) and sound(document.tokens)
                assert document.chars[1] == len(text)


def test_only_the_region_of_an_edit_is_cut_anew(counter):
    text = " ".join(f"word{i}" for i in range(50_000))
    document = counts.Document(counter, text, *counts.build(counter, text))
    document.edit(150_000, 150_003, "xyz")
    assert document.total() == tokens(counter, document.text)
    assert document.reencoded < 1000


def test_table(documents, counter):
    for r in counts.recounted(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        text, n = r["text"], len(r["text"])
        assert r["n_chars"] == n and r["n_tokens"] == tokens(counter, text)
        end = text[-30:]
        text = text[: n // 2] + text[:40] + text[n // 2 :]
        text = text[: n // 3] + text[n // 3 + 25 :] + end
        assert r["edited_tokens"] == tokens(counter, text)
        assert r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_trees_are_kept_from_edit_to_edit(make, counter):
    docs = make((1, "a b c d e f g " * 100, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"))
    rows = docs.withColumn("tree", counts.trees(docs))
    one = F.array(F.struct(F.lit(10).alias("start"), F.lit(20).alias("stop"), F.lit("Hello there").alias("text")))
    first = rows.withColumn("e", one)
    first = first.withColumn("x", counts.edited(first, "text", "tree", "e")).select("doc_id", "x.*", "e")
    second = first.withColumn("y", counts.edited(first, "text", "tree", "e")).select("doc_id", "y.*")
    found = {r["doc_id"]: r for r in second.collect()}
    assert found[1]["n_tokens"] == tokens(counter, found[1]["text"])
    assert found[2]["text"] is None and found[2]["n_tokens"] == 0
    # The second edit replaces what lies beyond the tenth character of the first.
    assert found[3]["text"] == "Hello therHello there" and found[3]["n_tokens"] == tokens(counter, found[3]["text"])


def test_odd_rows(odd, empty, counter):
    rows = counts.recounted(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == tokens(counter, texts[r["doc_id"]] or "")
    assert counts.recounted(empty).count() == 0
    assert np.array_equal(counts.heap(np.array([3, 4, 5], np.int32)), [0, 12, 7, 5, 3, 4, 5, 0])
