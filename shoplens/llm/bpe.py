"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's encoding is known by the last token of each of its prefixes: the token that ends a prefix is the only one
whose pair with the last token before it is stable, that is, no merge joins the two.  Distinct words of a batch are
sorted, which is the depth-first order of their trie, and a stack holds the last token of every prefix on the
current path; a prefix that many words share is worked out once.  The last symbol of a word carries the mark of a
word's end, so it closes a path as an edge of its own.

Texts are normalised and cut into words as the public tokenizer file says.  Texts of plain Latin characters take
patterns of the standard library; others take the tokenizers library's own normaliser and splitter.

* null text and empty text: no ids.  Strings of special tokens inside a text become those tokens, as in the library.
* repeated rows get equal results.  An empty table gives an empty result.
* very long words are encoded like others, in time linear in their length, and not remembered.
* other columns pass through ``encode`` and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, held, packed

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
REMEMBERED_WORDS = 200_000
REMEMBERED_LENGTH = 64
REMEMBERED_PAIRS = 500_000
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_SYMBOLS = _byte_symbols()


def _latin(kind: str) -> str:
    """Characters of a kind of letter or number that plain texts may hold, for a character class."""
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)


#: Plain texts: no control characters, no spaces beyond ASCII, nothing that normalising or lowering could move.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x149), *range(0x14A, 0x17F)]
_NOT_PLAIN = re.compile("[^\t\n\r " + "".join(re.escape(chr(c)) for c in _PLAIN) + "]")
_PLAIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[^\s{_latin('L')}{_latin('N')}]+"
)


class Encoder:
    """Encodes and decodes texts with one tokenizer file; one per worker.

    Workers wait with what they hold beside those at work, so an encoder holds little: of the library only the
    normaliser and the splitter, and decoded words only if they are asked for (``spelled``).
    """

    def __init__(self, path: str, spelled: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.path, self.spelled = path, spelled
        rules = {part: data.get(part) for part in ("version", "normalizer", "pre_tokenizer")}
        self.rules = Tokenizer.from_str(
            json.dumps(rules | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        )
        self.token = dict(data["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.text = {i: t for t, i in [*self.token.items(), *self.special.items()]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (self.token[left], self.token[right]), self.token[left + right]
            self.merged[pair] = whole
            self.rank[whole] = rank
            self.parts[whole] = pair
        self.sizes = {END: self._sizes_by_end(END), "": self._sizes_by_end("")}
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.plain: dict[str, tuple[bytes, str] | bytes] = {}
        self.other: dict[str, tuple[bytes, str] | bytes] = {}

    @cached_property
    def library(self):
        """The library's own tokenizer, to compare with; nothing here takes it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _sizes_by_end(self, mark: str) -> dict[str, tuple[int, ...]]:
        """The lengths of the tokens of four symbols and more, longest first, by their last four symbols."""
        sizes: dict[str, set[int]] = {}
        for token in self.token:
            if token.endswith(END) == bool(mark):
                body = token.removesuffix(END)
                if len(body) > 3:
                    sizes.setdefault(body[-4:], set()).add(len(body))
        return {end: tuple(sorted(found, reverse=True)) for end, found in sizes.items()}

    @classmethod
    def load(cls, path: str, spelled: bool = True) -> Encoder:
        return held(("bpe", path, spelled), lambda: cls(path, spelled))

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their symbols are merged as one string.

        The tokens at the border are taken apart from the latest merge back.  While two of them face each other,
        their own merge must come too late: after the merge that took one of them away.
        """
        pair = (left, right)
        known = self.stable_pairs.get(pair)
        if known is not None:
            return known
        rank, parts = self.rank, self.parts
        left_gone = right_gone = len(rank)
        answer = True
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and rank[joined] < left_gone and rank[joined] <= right_gone:
                # Equal ranks on the right: of two overlapping equal pairs the left one merges first.
                answer = False
                break
            left_made, right_made = rank.get(left, -1), rank.get(right, -1)
            if left_made < 0 and right_made < 0:
                break
            if left_made > right_made:
                left_gone, left = left_made, parts[left][1]
            else:
                right_gone, right = right_made, parts[right][0]
        if len(self.stable_pairs) >= REMEMBERED_PAIRS:
            self.stable_pairs.clear()
        self.stable_pairs[pair] = answer
        return answer

    def _last(self, word: str, end: int, last: list[int], mark: str) -> tuple[int, int]:
        """The token that ends ``word[:end]`` and its length, given the last tokens of all shorter prefixes."""
        known, tokens = self.stable_pairs, self.token
        longer = self.sizes[mark].get(word[end - 4 : end], ()) if end > 3 else ()
        for size in (*longer, 3, 2, 1):
            if size > end:
                continue
            token = tokens.get(word[end - size : end] + mark)
            if token is not None:
                if size == end:
                    return token, size
                before = last[end - size]
                apart = known.get((before, token))
                if apart or (apart is None and self.stable(before, token)):
                    return token, size
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each of the distinct words, which are written in byte symbols."""
        last: list[int] = [-1]
        length: list[int] = [0]
        before = ""
        for word in sorted(words):
            shared = 0
            most = min(len(before), len(word), len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], length[shared + 1 :]
            for end in range(len(last), len(word)):
                token, size = self._last(word, end, last, "")
                last.append(token)
                length.append(size)
            token, size = self._last(word, len(word), last, END)
            ids, end = [token], len(word) - size
            while end:
                ids.append(last[end])
                end -= length[end]
            ids.reverse()
            before = word
            yield word, ids

    def decode(self, ids) -> str:
        """The tokens of the ids, joined as the library does for a file without decoder."""
        return " ".join([self.text[i] for i in ids])

    def _pieces(self, text: str) -> list[tuple[str, bool | None]]:
        """Words of a text in order, each with whether it is plain, or None for a special token."""
        pieces: list[tuple[str, bool | None]] = []
        start = 0
        for found in [*self.special_pattern.finditer(text), None]:
            part = text[start : found.start() if found else len(text)]
            if _NOT_PLAIN.search(part):
                normal = self.rules.normalizer.normalize_str(part)
                pieces += [(w, False) for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(normal)]
            else:
                pieces += [(w, True) for w in _PLAIN_WORDS.findall(part.lower())]
            if found:
                pieces.append((found.group(), None))
                start = found.end()
        return pieces

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[list[bytes], list[str]]]:
        """For each text the ids of its words as bytes (32 bits each) and, if ``spelled``, the words' decoded tokens."""
        if len(self.plain) + len(self.other) > REMEMBERED_WORDS:
            self.plain.clear()
            self.other.clear()
        split: list = []
        new: set[str] = set()
        for text in texts:
            if text and not self.special_pattern.search(text) and not _NOT_PLAIN.search(text):
                words = _PLAIN_WORDS.findall(text.lower())
                new.update(words)
                split.append(words)
            else:
                pieces = self._pieces(text or "")
                new.update(w for w, plain in pieces if plain)
                split.append(pieces)
        plain = {w: "".join([_SYMBOLS[b] for b in w.encode()]) for w in new - self.plain.keys()}
        other = {w for s in split if s and isinstance(s[0], tuple) for w, p in s if p is False and w not in self.other}
        coded = dict(self.encode_words(list({*plain.values(), *other})))
        ready = {w: self._value(struct.pack(f"<{len(ids)}I", *ids), ids) for w, ids in coded.items()}
        self.plain.update((w, ready[s]) for w, s in plain.items())
        self.other.update((w, ready[w]) for w in other)
        of_plain = self.plain.__getitem__
        for words in split:
            if words and isinstance(words[0], tuple):
                found = [
                    self.plain[w]
                    if p
                    else self.other[w]
                    if p is False
                    else self._value(struct.pack("<I", self.special[w]), [self.special[w]])
                    for w, p in words
                ]
            else:
                found = list(map(of_plain, words))
            yield (list(map(_FIRST, found)), list(map(_SECOND, found))) if self.spelled else (found, [])
        for w in [w for w, s in plain.items() if len(s) > REMEMBERED_LENGTH]:
            self.plain.pop(w, None)
        for w in [w for w in other if len(w) > REMEMBERED_LENGTH]:
            self.other.pop(w, None)

    def _value(self, packed_ids: bytes, ids: list[int]) -> tuple[bytes, str] | bytes:
        """What is remembered of a word: its ids as bytes, with its decoded tokens if ``spelled``."""
        return (packed_ids, self.decode(ids)) if self.spelled else packed_ids


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def ids_column(docs: DataFrame, path: str | None = None) -> Column:
    """The ids of ``text`` as an array column."""
    path = _path(path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.load(path, spelled=False)
        for texts in batches:
            found = [np.frombuffer(b"".join(ids), "<u4") for ids, _ in encoder.encode_texts(texts.to_pylist())]
            offsets = np.cumsum([0, *map(len, found)])
            values = np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

    return arrow_column(docs.sparkSession, run, "array<int>")(F.col("text"))


def encode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in a further column."""
    rows = docs.select(packed(docs).alias("row")).select("row", F.col("row.text").alias("text"))
    return rows.withColumn("made", ids_column(docs, path)).select("row.*", F.col("made").alias(column))


def decode(coded: DataFrame, ids: str = "ids", path: str | None = None, column: str = "decoded") -> DataFrame:
    """``coded`` with the decoded text of an array of ids in a further column; null ids stay null."""
    path = _path(path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.load(path)
        for arrays in batches:
            yield pa.array([None if x is None else encoder.decode(x) for x in arrays.to_pylist()], pa.string())

    return coded.withColumn(column, arrow_column(coded.sparkSession, run, "string")(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of ``text``, without sending ids or decoded texts back."""
    path = _path(path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.load(path)
        for texts in batches:
            n, ids_sums, decoded_sums = [], [], []
            for ids, words in encoder.encode_texts(texts.to_pylist()):
                data = b"".join(ids)
                n.append(len(data) // 4)
                ids_sums.append(hashlib.sha256(data).hexdigest())
                decoded_sums.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(decoded_sums, pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
    return arrow_column(docs.sparkSession, run, kind)(F.col("text"))


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", digests(docs, path).alias("d")).select("doc_id", "d.*")
