"""Edit-aware token counts.

A text is cut into pre-tokens, and runs of ``LEAF`` of them are the leaves of a segment tree that is kept with the
document: two arrays in heap order hold the code points and the tokens below each node.  An edit finds its leaves by
descending the tree, cuts only their text anew, and goes on to the right until a new pre-token starts where an old
leaf did; from there on nothing can differ, as a pre-token depends on what follows its start only.  On the left, a
leaf that ends two characters before the edit keeps its pre-tokens, as their pattern looks no further ahead.  Tokens are counted for the touched leaves alone, and only the sums above them change.

Tokens are those of a public byte-level vocabulary; strings of special tokens are ordinary text.

* null and empty text: no leaves, 0 tokens.  A null edit list, and edits of null texts, change nothing.
* edits apply one after the other, each to the text that the one before left; positions beyond the end mean the end.
* very long texts: memory is in proportion to one text.  Repeated rows get equal results.
* other columns pass through and may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, held

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 32
REMEMBERED_PIECES = 300_000
REMEMBERED_LENGTH = 64

TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<start:int,stop:int,text:string>>"

_ASCII = re.compile(r"[^\x00-\x1b\x20-\x7e]")
_ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)


class Counter:
    """Cuts texts into pre-tokens and counts their tokens; one per worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks = ranks
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding(
            "counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> Counter:
        return held(("counts", path), lambda: cls(path))

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text) if _ASCII.search(text) else _ASCII_PIECES.findall(text)

    def scan(self, text: str, start: int) -> Iterator[str]:
        """Pre-tokens from a place on, one by one."""
        return (m.group() for m in self.pattern.finditer(text, start))

    def count(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED_PIECES:
            known.clear()
        long = {}
        for piece in set(pieces):
            if piece in known:
                continue
            n = 1 if piece.encode() in self.ranks else len(self.encoding.encode_ordinary(piece))
            (known if len(piece) <= REMEMBERED_LENGTH else long)[piece] = n
        if long:
            return np.array([known[p] if p in known else long[p] for p in pieces], dtype=np.int32)
        return np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))


def heap(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: node k has the children 2k and 2k + 1, the leaves are the second half."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    level = np.zeros(width, dtype=np.int32)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(axis=1, dtype=np.int32)
        levels.append(level)
    return np.concatenate([np.zeros(1, np.int32), *reversed(levels)])


def build(counter: Counter, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    pieces = counter.cut(text or "")
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    starts = np.arange(0, len(pieces), LEAF)
    chars = np.fromiter(map(len, pieces), np.int32, len(pieces))
    return heap(np.add.reduceat(chars, starts)), heap(np.add.reduceat(counter.count(pieces), starts))


def _descend(chars: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds a place in the text, and where the leaf starts."""
    node, start, width = 1, 0, len(chars) // 2
    while node < width:
        left = 2 * node
        if place - start < chars[left]:
            node = left
        else:
            start += int(chars[left])
            node = left + 1
    return node - width, start


def _set(sums: np.ndarray, first: int, values: np.ndarray) -> None:
    """Set leaves and the sums above them."""
    width = len(sums) // 2
    low, high = width + first, width + first + len(values) - 1
    sums[low : high + 1] = values
    while low > 1:
        low, high = low // 2, high // 2
        for node in range(low, high + 1):
            sums[node] = sums[2 * node] + sums[2 * node + 1]


class Document:
    """A text with its tree, open to edits."""

    def __init__(self, counter: Counter, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.counter, self.text, self.chars, self.tokens = counter, text, chars, tokens
        self.reencoded = 0

    def total(self) -> int:
        return int(self.tokens[1]) if len(self.tokens) else 0

    def edit(self, start: int, stop: int, text: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        new = self.text[:start] + text + self.text[stop:]
        if not len(self.chars) or not new:
            self.text = new
            self.chars, self.tokens = build(self.counter, new)
            self.reencoded += len(new)
            return
        width = len(self.chars) // 2
        # White space is cut by looking two characters ahead; leaves that end before those keep their pre-tokens.
        first, at = _descend(self.chars, max(0, start - 2))
        leaf, old_place = _descend(self.chars, min(stop, size - 1))
        shift = len(new) - size
        pieces, place = [], at
        for piece in self.counter.scan(new, at):
            # Skip old leaves that start before this place or inside the edit.
            while leaf < width and (old_place < stop or old_place + shift < place):
                old_place += int(self.chars[width + leaf])
                leaf += 1
            if old_place + shift == place and old_place >= stop and leaf > first:
                break
            pieces.append(piece)
            place += len(piece)
        else:
            leaf = width
        slots = leaf - first
        self.text = new
        self.reencoded += place - at
        if len(pieces) > 4 * LEAF * slots:
            self.chars, self.tokens = self._spliced(first, leaf, pieces)
            return
        chars, tokens = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        if pieces:
            per_leaf = -(-len(pieces) // slots)
            starts = np.arange(0, len(pieces), per_leaf)
            lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
            chars[: len(starts)] = np.add.reduceat(lengths, starts)
            tokens[: len(starts)] = np.add.reduceat(self.counter.count(pieces), starts)
        _set(self.chars, first, chars)
        _set(self.tokens, first, tokens)

    def _spliced(self, first: int, last: int, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A tree with room for more leaves; the leaves around the edit are taken over."""
        width = len(self.chars) // 2
        starts = np.arange(0, len(pieces), LEAF)
        lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
        fresh = np.add.reduceat(lengths, starts), np.add.reduceat(self.counter.count(pieces), starts)
        return tuple(
            heap(np.concatenate([old[width : width + first], new, old[width + last :]]))
            for old, new in zip((self.chars, self.tokens), fresh)
        )


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def _arrays(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]))
    )


def trees(docs: DataFrame, path: str | None = None) -> Column:
    """The segment tree of ``text`` as a column, to be kept with the document."""
    path = _path(path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter.load(path)
        for texts in batches:
            found = [build(counter, text) for text in texts.to_pylist()]
            yield pa.StructArray.from_arrays([_arrays([f[i] for f in found]) for i in (0, 1)], names=["chars", "tokens"])

    return arrow_column(docs.sparkSession, run, TREE)(F.col("text"))


def n_tokens(tree: Column) -> Column:
    """The tokens of a document from the root of its tree."""
    return F.coalesce(F.get(tree["tokens"], F.lit(1)), F.lit(0)).cast("long")


def edited(docs: DataFrame, text: str, tree: str, edits: str, path: str | None = None) -> Column:
    """A column of text, tree, n_tokens and reencoded (code points cut anew) after the edits of a row."""
    path = _path(path)

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = Counter.load(path)
        for texts, kept, wanted in batches:
            chars, tokens = kept.field("chars"), kept.field("tokens")
            done = []
            for k, (value, changes) in enumerate(zip(texts.to_pylist(), wanted.to_pylist())):
                document = Document(
                    counter,
                    value or "",
                    np.array(chars[k].values, dtype=np.int32) if chars[k].is_valid else np.zeros(0, np.int32),
                    np.array(tokens[k].values, dtype=np.int32) if tokens[k].is_valid else np.zeros(0, np.int32),
                )
                for change in (changes or []) if value is not None else []:
                    document.edit(change["start"], change["stop"], change["text"] or "")
                done.append((document, None if value is None else document.text))
            yield pa.StructArray.from_arrays(
                [
                    pa.array([t for _, t in done], pa.string()),
                    pa.StructArray.from_arrays(
                        [_arrays([d.chars for d, _ in done]), _arrays([d.tokens for d, _ in done])],
                        names=["chars", "tokens"],
                    ),
                    pa.array([d.total() for d, _ in done], pa.int64()),
                    pa.array([d.reencoded for d, _ in done], pa.int64()),
                ],
                names=["text", "tree", "n_tokens", "reencoded"],
            )

    kind = f"struct<text:string,tree:{TREE},n_tokens:bigint,reencoded:bigint>"
    return arrow_column(docs.sparkSession, run, kind)(F.col(text), F.col(tree), F.col(edits))


def sample_edits(text: Column) -> Column:
    """Three edits of a text by itself: its start goes into its middle, a third of the way some characters go,
    and its end is written once more."""
    size = F.length(text)
    third = F.floor(size / 3).cast("int")

    def change(start: Column, stop: Column, value: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), value.alias("text"))

    middle = F.floor(size / 2)
    return F.array(
        change(middle, middle, F.substring(text, 1, 40)),
        change(third, third + 25, F.lit("")),
        change(size + 40, size + 40, F.substring(text, -30, 30)),
    )


def recounted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, n_tokens, and after ``sample_edits`` edited_tokens, reencoded, edited_sha256."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", trees(rows, path).alias("tree"), sample_edits(F.col("text")).alias("edits"))
    done = rows.withColumn("after", edited(rows, "text", "tree", "edits", path))
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        n_tokens(F.col("tree")).alias("n_tokens"),
        F.col("after.n_tokens").alias("edited_tokens"),
        F.col("after.reencoded").alias("reencoded"),
        F.sha2("after.text", 256).alias("edited_sha256"),
    )
