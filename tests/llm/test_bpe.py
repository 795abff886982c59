import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoplens.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    encoder = bpe.Encoder(PATH)
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, (ids, words), right in zip(texts, encoder.encode_texts(texts), expected):
        found = np.frombuffer(b"".join(ids), "<u4").tolist()
        assert found == right.ids, text[:200]
        assert " ".join(words) == library.decode(right.ids, skip_special_tokens=False)
        assert encoder.decode(found) == library.decode(right.ids, skip_special_tokens=False)


def test_hard_texts(library):
    same(
        library,
        [
            "",
            " ",
            "aaaa aaaaaaa aaaaaaaaaaaaaa ababababab",
            "It's they'll we've I'd 'S 'LL don't''s",
            "naïve Straße İstanbul ŉ ΣΑΣ ﬁ Å é ẞ",
            "x y z\x85w\x1cv\x00u​t",
            "漢字かな 한국어 العربية עברית ไทย 😀👍🏽 ١٢٣ ½ ² Ⅷ",
            "<|startoftext|>hello<|endoftext|> <|endoftext|<|endoftext|>x <|ENDOFTEXT|>",
            "12345 3.14 a1b2 __init__ !!!??? ... -- $%&",
            "z" * 5000 + " " + "ab1" * 2000,
        ],
    )


def test_random_texts(library):
    pick = random.Random(3)
    alphabet = "aaabcdeeeiinnrrstt  '\n.,0é漢ß"
    same(library, ["".join(pick.choice(alphabet) for _ in range(pick.randrange(200))) for _ in range(500)])


def test_prefixes_are_shared():
    encoder = bpe.Encoder(PATH)
    words = ["international", "internationals", "internal", "inter", "x"]
    asked = []
    original = encoder._last
    encoder._last = lambda word, end, *rest: asked.append((word[:end], rest[-1])) or original(word, end, *rest)
    dict(encoder.encode_words(words))
    assert len(asked) == len(set(asked))


def test_whole_table(documents, library):
    found = {r["doc_id"]: r for r in bpe.encoded_digests(documents).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        row = found[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_and_decode_columns(odd, empty, library):
    coded = bpe.decode(bpe.encode(odd))
    assert coded.columns == [*odd.columns, "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == odd.count()
    for r in rows:
        right = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == right
        assert r["decoded"] == library.decode(right, skip_special_tokens=False)
    assert bpe.encoded_digests(empty).count() == 0


def test_only_lengths_of_tokens_with_that_end_are_tried():
    class Counting(dict):
        gets = 0

        def get(self, key, default=None):
            Counting.gets += 1
            return super().get(key, default)

    encoder = bpe.Encoder(PATH)
    encoder.token = Counting(encoder.token)
    words = ["qzxvkjwqpx" * 6, "internationalizations" * 3]
    found = dict(encoder.encode_words(words))
    assert Counting.gets <= 8 * sum(len(w) + 1 for w in words)
    for word in words:
        assert found[word] == encoder.library.encode(word, add_special_tokens=False).ids


def test_an_encoder_holds_neither_the_library_nor_words_not_asked_for(library):
    texts = ["plain words", "漢字 naïve", "<|endoftext|>x", "", None, "z" * 500 + " é漢" * 40]
    spelled, short = bpe.Encoder(PATH), bpe.Encoder(PATH, spelled=False)
    for _ in range(2):
        found, ids_only = list(spelled.encode_texts(texts)), list(short.encode_texts(texts))
        assert [ids for ids, _ in found] == [ids for ids, _ in ids_only]
        assert all(words == [] for _, words in ids_only)
        for text, (_, words) in zip(texts, found):
            right = library.encode(text or "", add_special_tokens=False).ids
            assert " ".join(words) == library.decode(right, skip_special_tokens=False)
    assert all(type(known) is bytes for known in [*short.plain.values(), *short.other.values()])
    for encoder in (spelled, short):
        assert "library" not in vars(encoder)
        assert encoder.rules.get_vocab_size() == 0
        assert all(len(w) <= bpe.REMEMBERED_LENGTH for w in [*encoder.plain, *encoder.other])
