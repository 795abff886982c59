"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of the linked pairs.

Tokenizer A is a byte-level one and reads a space and the text; tokenizer B is a piece model, which adds the space
itself.  Where tokens of both end at the same byte, a group of tokens ends, and the two tokens are linked.  A link
is scored by how often its pair of ids is linked in the whole corpus, which is external spill counting:

1. *Spill.*  A map task encodes its documents and gathers (pair, document) records.  Whenever it holds 4 million of
   them or 16,384 documents (``Sizes``) it sorts them, deals them out by a radix of their B id and writes each radix as a
   run of zstd blocks.  Records of one pair and document become one record with a count; one pair's records of all
   documents of a spill become one entry with a total, so a hot pair is an entry per spill.
2. *Merge.*  Runs of a radix are merged 256 at a time by a heap, in as many rounds as it takes.  The shuffle hands
   a task its blocks in order of their first pair, so one block of each run is open at a time.
3. *Maxima.*  Pairs are ordered by B id, then A id.  The last merge sees all pairs of a B id in a row, at most one
   per A id, and marks the highest.
4. *Contributions.*  The counted pairs and the runs pass by each other once more in the same order, again at most
   256 runs to a task.  Each run adds up what its documents get; the sums go back to the documents.

A text is cut where a word ends before a single space or line break, places where neither tokenizer can join bytes;
words met before are looked up.  The cut is used only if the vocabulary of B allows it.

* null or empty text, and text whose joined token bytes of A or B differ from space and text (such as text with the
  piece model's own space sign): no tokens, zeros, empty ``groups``.
* special tokens' strings inside a text are plain text.
* very long texts: read whole; one makes a spill of its own, and a word of more than LONGEST_HELD characters is not
  remembered.
* ties for the highest count of a B id: all of them are best.
* repeated rows and null ids: each row counts.  An empty table gives an empty result.
* other columns, of any name, are carried in the struct ``row``; ``keep`` names those wanted.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, groupby, islice
from math import ceil
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, map_batches, packed, stored

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
RADIX_BITS = 6
LONGEST_HELD = 64
REMEMBERED_WORDS = 250_000
TOGETHER = 2000

_SPACE_AFTER_SPACE = re.compile(r"\s[ \n]")
_WORD_END = re.compile(r"(?<=\S)(?=[ \n])")


class Sizes(NamedTuple):
    """What a task holds at a time; results do not depend on it."""

    spill_links: int = 1 << 22
    spill_documents: int = 1 << 14
    block_pairs: int = 4096
    fan_in: int = 256


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + k): byte for k, byte in enumerate(others)}


class Aligner:
    """Both tokenizers, and the words already aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        special = set(self.a.get_added_tokens_decoder())
        for entry, number in self.a.get_vocab().items():
            self.bytes_a[number] = entry.encode() if number in special else bytes(alphabet[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        #: Neither a space after another character nor a line break may lie inside a piece.
        self.cuttable = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.a_bits = (len(self.bytes_a) - 1).bit_length()
        self.b_bits = max((len(self.bytes_b) - 1).bit_length(), RADIX_BITS)
        if self.a_bits + self.b_bits > 32:
            raise ValueError("the ids of a pair must fit 32 bits together")
        self.words: dict[str, tuple | None] = {}
        self.width_a = np.array([len(token) for token in self.bytes_a])
        self.width_b = np.array([len(token) for token in self.bytes_b])
        #: Ids as text with the sign that follows: within the side of a group, and behind it.
        self.written = [f"{i}{sign}" for i in range(len(self.bytes_a)) for sign in ",|"]
        self.written += [f"{i}{sign}" for i in range(len(self.bytes_b)) for sign in ",;"]
        # The same merges by rank, which are those of the vocabulary's numbers, and faster on short words.
        ranks = {token: number for number, token in enumerate(self.bytes_a) if number not in special}
        self.ranks = tiktoken.Encoding(
            "side-a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def key(self, a, b):
        """A pair as a number that orders by radix, then B, then A."""
        low = b & ((1 << RADIX_BITS) - 1)
        return ((low << (self.b_bits - RADIX_BITS) | b >> RADIX_BITS) << self.a_bits) | a

    def radix(self, keys):
        return keys >> (self.a_bits + self.b_bits - RADIX_BITS)

    def ids(self, key: int) -> tuple[int, int]:
        rotated = key >> self.a_bits
        high_bits = self.b_bits - RADIX_BITS
        b = (rotated & ((1 << high_bits) - 1)) << RADIX_BITS | rotated >> high_bits
        return key & ((1 << self.a_bits) - 1), b

    def cut(self, text: str) -> list[str]:
        whole = " " + text
        if not self.cuttable:
            return [whole]
        if _SPACE_AFTER_SPACE.search(whole):
            return _WORD_END.split(whole)
        found = []
        for k, line in enumerate(whole[1:].split("\n")):
            words = line.split(" ")
            found.append(("\n" if k else " ") + words[0])
            found += [" " + word for word in words[1:]]
        return found

    def learn(self, words: list[str]) -> None:
        """Align words not met before: many at a time, as they would stand in a text."""
        # A text's last word may end with white space and would run into the next one; so it stands alone.
        usual = [word for word in words if len(word) <= LONGEST_HELD and not word[-1].isspace()]
        # B adds a space to a text, so the first word of one has to begin with it.
        usual.sort(key=lambda word: word[0] != " ")
        for at in range(0, len(usual), TOGETHER):
            some = usual[at : at + TOGETHER]
            whole = "".join(some)
            if some[0][0] != " " or not self._align(some, self.ranks.encode_ordinary(whole), self.b.encode(whole[1:])):
                for word in some:
                    self._alone(word)
        for word in words:
            if word not in self.words:
                self._alone(word)

    def _alone(self, word: str) -> None:
        ids_a = self.a.encode(word, add_special_tokens=False).ids
        if word == " ":  # B adds no space to an empty text
            ids_b = [self.b.piece_to_id("▁")]
        elif word[0] == " ":
            ids_b = self.b.encode(word[1:])
        else:  # the space B adds stays a piece of its own before a line break
            ids_b = self.b.encode(word)[1:]
        if not self._align([word], ids_a, ids_b):
            self.words[word] = None

    def _align(self, words: list[str], ids_a: list[int], ids_b: list[int]) -> bool:
        """Remember the groups and links of words that stand one after the other; False if the bytes differ.

        What is kept of a word: its groups as text, each with a semicolon behind it, its links as packed keys, and
        its numbers of tokens.
        """
        raws = [word.encode() for word in words]
        whole = b"".join(raws)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join([known[i] for i in ids]) != whole:
                return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        ends = np.cumsum([len(raw) for raw in raws])
        of_word = [np.searchsorted(side, ends) for side in (ends_a, ends_b)]
        if any((side[np.minimum(at, len(side) - 1)] != ends).any() for side, at in zip((ends_a, ends_b), of_word, strict=True)):
            return False
        cuts, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        keys = self.key(a[last_a], b[last_b]).astype(np.uint32)
        # Tokens in the order of the text: those of A, then those of B of each group, each with the sign behind it.
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        until_a, until_b = last_a + 1, np.r_[0, last_b + 1]
        places_a = np.arange(len(a)) + until_b[group_a]
        places_b = np.arange(len(b)) + until_a[group_b]
        signs = np.empty(len(a) + len(b), np.int64)
        signs[places_a] = a * 2
        signs[places_a[last_a]] += 1
        signs[places_b] = 2 * len(self.bytes_a) + b * 2
        signs[places_b[last_b]] += 1
        written = [self.written[sign] for sign in signs.tolist()]
        links = keys.tobytes()
        n_a, n_b = of_word[0] + 1, of_word[1] + 1
        upto = np.searchsorted(cuts, ends) + 1
        start = start_a = start_b = 0
        for word, end, end_a, end_b in zip(words, upto.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
            groups = "".join(written[start_a + start_b : end_a + end_b])
            self.words[word] = (groups, links[4 * start : 4 * end], end_a - start_a, end_b - start_b)
            start, start_a, start_b = end, end_a, end_b
        return True

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """Tokens of A and of B, the groups and the links' keys of each text."""
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        cuts = [self.cut(text) if text else [] for text in texts]
        missing = list({word for words in cuts for word in words if word not in self.words})
        if missing:
            self.learn(missing)
        for words in cuts:
            found = [self.words[word] for word in words]
            if not found or None in found:
                yield 0, 0, "", np.empty(0, np.uint32)
                continue
            groups, keys, n_a, n_b = zip(*found, strict=True)
            yield sum(n_a), sum(n_b), "".join(groups)[:-1], np.frombuffer(b"".join(keys), np.uint32)
        for word in missing:
            if len(word) > LONGEST_HELD:
                del self.words[word]


def _aligner(path_a: str, path_b: str) -> Aligner:
    return held(("align", path_a, path_b), lambda: Aligner(path_a, path_b))


# Runs


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one zstd block."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    length = len(raw) // sum(np.dtype(kind).itemsize for kind in kinds)
    arrays, start = [], 0
    for kind in kinds:
        arrays.append(np.frombuffer(raw, kind, length, start))
        start += length * np.dtype(kind).itemsize
    return arrays


class Spill:
    """Records of a map task until they are written as runs."""

    def __init__(self, number: int, radix, sizes: Sizes):
        self.number, self.radix, self.sizes = number, radix, sizes
        self.records: list[np.ndarray] = []
        self.links = self.documents = 0

    def add(self, keys: np.ndarray) -> None:
        self.records.append(keys.astype(np.uint64) << np.uint64(32) | np.uint64(self.documents))
        self.links += len(keys)
        self.documents += 1

    @property
    def full(self) -> bool:
        return self.links >= self.sizes.spill_links or self.documents >= self.sizes.spill_documents

    def runs(self) -> Iterator[tuple]:
        """(spill, documents, radix, first pair, block of pairs and totals, block of documents and counts)"""
        if not self.links:
            return
        records, counts = _runs_of(np.sort(np.concatenate(self.records)))
        keys = (records >> np.uint64(32)).astype(np.uint32)
        documents = records.astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        entries = np.diff(np.r_[starts, len(keys)])
        totals = np.add.reduceat(counts, starts)
        pairs = keys[starts]
        radices = self.radix(pairs)
        breaks = set(np.flatnonzero(np.diff(radices)) + 1)
        at = 0
        for end in sorted(breaks | {len(pairs)}):
            for low in range(at, end, self.sizes.block_pairs):
                high = min(low + self.sizes.block_pairs, end)
                of = slice(starts[low], starts[high - 1] + entries[high - 1])
                yield (
                    self.number,
                    self.documents,
                    int(radices[low]),
                    int(pairs[low]),
                    _pack(pairs[low:high], totals[low:high].astype(np.uint64), entries[low:high].astype(np.uint32)),
                    _pack(documents[of], counts[of].astype(np.uint32)),
                )
            at = end


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.diff(np.r_[starts, len(values)])


_DOCUMENT = "spill long, place int, n_a long, n_b long, n_groups long, n_links long, groups string"
_RUN = "run long, documents int, radix int, first long, pairs binary, records binary"


def _encoded(
    docs: DataFrame, text: str, keep: list[str] | None, paths: tuple[str, str], digest: bool, sizes: Sizes
) -> DataFrame:
    """A stored table of two kinds of rows: documents (without radix) and blocks of runs."""
    kept = docs if keep is None else docs.select(*[docs[f"`{name}`"] for name in keep])
    row = packed(kept) if kept.columns else F.struct(F.lit(None).cast("int").alias("none"))
    pair = docs.select(row.alias("row"), docs[f"`{text}`"].alias("text"))
    row_type = pair.schema["row"].dataType
    of_document, of_run = T.StructType.fromDDL(_DOCUMENT), T.StructType.fromDDL(_RUN)
    extra = [*of_document.fields, *of_run.fields]
    schema = T.StructType([T.StructField("row", row_type), *extra])
    names, half = [field.name for field in extra], len(of_document.fields)
    kinds = [_ARROW[field.dataType.typeName()] for field in extra]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        task = TaskContext.get().partitionId()
        numbers = iter(range(task << 32, (task + 1) << 32))
        spill = Spill(next(numbers), aligner.radix, sizes)
        row_kind = None

        def runs(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                nothing = [pa.nulls(1, kind) for kind in kinds[:half]]
                block = [pa.array([v], kind) for v, kind in zip(row, kinds[half:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, row_kind), *nothing, *block], ["row", *names])

        for batch in batches:
            row_kind = batch.schema.field("row").type
            rows, ended = [], []
            for n_a, n_b, groups, keys in aligner.documents(batch.column(1).to_pylist()):
                written = (sha256(groups.encode()).hexdigest() if groups else "") if digest else groups
                rows.append((spill.number, spill.documents, n_a, n_b, len(keys), len(keys), written))
                spill.add(keys)
                if spill.full:
                    ended.append(spill)
                    spill = Spill(next(numbers), aligner.radix, sizes)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds[:half], strict=True)]
            columns += [pa.nulls(len(rows), kind) for kind in kinds[half:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *names])
            for done in ended:
                yield from runs(done.runs())
        yield from runs(spill.runs())

    return stored(map_batches(pair, encode, schema), "alignment")


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    held_back: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*held_back, strict=True), kinds, strict=True)]
        held_back.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for row in rows:
        held_back.append(row)
        if len(held_back) == size:
            yield batch()
    if held_back:
        yield batch()


def _dealt(blocks: DataFrame, parts: int, *order: str) -> DataFrame:
    """Blocks by (radix, part), each such group whole in one task and in the order given."""
    most = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(parts << RADIX_BITS, max(most, 1 << RADIX_BITS))
    number = (F.col("radix").cast("long") * parts + F.col("part")) % tasks
    return blocks.repartitionById(tasks, number.cast("int")).sortWithinPartitions("radix", "part", *order)


def _part(run: str, parts: int):
    return F.pmod(F.xxhash64(run), F.lit(parts)).alias("part")


# Merging


def _merged(blocks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
    """Pairs and their totals over all runs, from blocks in order of their first pair."""
    heap: list[tuple] = []
    for number, (first, block) in enumerate(chain(blocks, [(None, None)])):
        while heap and (first is None or heap[0][0] < first):
            key, total = heap[0][0], 0
            while heap and heap[0][0] == key:
                _, count, _, rest = run = heap[0]
                total += count
                following = next(rest, None)
                if following is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (*following, run[2], rest))
            yield key, total
        if block is not None:
            keys, totals, _ = _unpack(block, np.uint32, np.uint64, np.uint32)
            entries = zip(keys.tolist(), totals.tolist(), strict=True)
            heapq.heappush(heap, (*next(entries), number, entries))


def _blocks(entries: Iterable[tuple[int, int, int]], size: int) -> Iterator[tuple[int, bytes]]:
    """(first pair, block of pairs, totals and marks)"""
    entries = iter(entries)
    while True:
        some = list(islice(entries, size))
        if not some:
            return
        keys, totals, marks = zip(*some, strict=True)
        yield keys[0], _pack(np.array(keys, np.uint32), np.array(totals, np.uint64), np.array(marks, np.uint32))


def _marked(pairs: Iterable[tuple[int, int]], a_bits: int) -> Iterator[tuple[int, int, int]]:
    """Pairs in side-major order, marked where their total is the highest of their B id."""
    for _, of_b in groupby(pairs, lambda pair: pair[0] >> a_bits):
        of_b = list(of_b)
        highest = max(total for _, total in of_b)
        for key, total in of_b:
            yield key, total, int(total == highest)


def _merge(blocks: DataFrame, parts: int, paths: tuple[str, str], sizes: Sizes) -> DataFrame:
    """One round: (run, radix, first, pairs) merged to ``parts`` runs a radix; the last one marks the maxima."""
    final = parts == 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            a_bits = _aligner(*paths).a_bits
            for (radix, part), group in groupby(_rows(batches), lambda row: row[:2]):
                pairs = _merged((first, block) for _, _, first, block in group)
                marked = _marked(pairs, a_bits) if final else ((key, total, 0) for key, total in pairs)
                for first, block in _blocks(marked, sizes.block_pairs):
                    yield part, radix, first, block

        names = ["run", "radix", "first", "pairs"]
        yield from _batches(rows(), names, [pa.int64(), pa.int32(), pa.int64(), pa.binary()], 16)

    dealt = _dealt(blocks.select("radix", _part("run", parts), "first", "pairs"), parts, "first")
    return map_batches(dealt, merge, "run long, radix int, first long, pairs binary")


def _counted(encoded: DataFrame, paths: tuple[str, str], sizes: Sizes) -> tuple[DataFrame, int]:
    """One run a radix with all counts, and the number of spills."""
    runs = encoded.where("radix is not null")
    spills = left = runs.agg(F.countDistinct("run")).first()[0]
    blocks = runs.select("run", "radix", "first", "pairs")
    while True:
        parts = max(1, ceil(left / sizes.fan_in))
        blocks, left = _merge(blocks, parts, paths, sizes), parts
        if parts == 1:
            return blocks, spills


# Contributions


class Open:
    """The open block of a run, and how far it has been read."""

    def __init__(self, run: int, pairs: bytes, records: bytes):
        self.run = run
        self.keys, _, entries = _unpack(pairs, np.uint32, np.uint64, np.uint32)
        self.documents, self.counts = _unpack(records, np.uint32, np.uint32)
        self.starts = np.r_[0, np.cumsum(entries.astype(np.int64))]
        self.at = 0

    def read(self, counted: list[np.ndarray], sums: np.ndarray) -> bool:
        """Add what the pairs up to the last counted one give their documents; False once the block is used up."""
        keys, totals, marks = counted
        end = int(np.searchsorted(self.keys, keys[-1], "right"))
        if end > self.at:
            found = np.searchsorted(keys, self.keys[self.at : end])
            of = slice(self.starts[self.at], self.starts[end])
            repeats = np.diff(self.starts[self.at : end + 1])
            documents, counts = self.documents[of], self.counts[of].astype(np.int64)
            np.add.at(sums[0], documents, counts * np.repeat(marks[found].astype(np.int64), repeats))
            np.add.at(sums[1], documents, counts * np.repeat(totals[found].astype(np.int64), repeats))
            self.at = end
        return self.at < len(self.keys)


def _contributions(encoded: DataFrame, counted: DataFrame, spills: int, sizes: Sizes) -> DataFrame:
    """(spill, place, n_best, count_sum) of every document with links."""
    parts = max(1, ceil(spills / sizes.fan_in))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    no_run = [F.lit(None).cast(kind).alias(name) for name, kind in (("run", "long"), ("documents", "int"))]
    no_records = F.lit(None).cast("binary").alias("records")
    counts = counted.select("radix", everywhere, "first", F.lit(0).alias("kind"), *no_run, "pairs", no_records)
    runs = encoded.where("radix is not null").select(
        "radix", _part("run", parts), "first", F.lit(1).alias("kind"), "run", "documents", "pairs", "records"
    )

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, group in groupby(_rows(batches), lambda row: row[:2]):
                opened: list[Open] = []
                sums: dict[int, np.ndarray] = {}
                now = None
                for _, _, _, kind, run, documents, pairs, records in chain(group, [(None,) * 3 + (0,) + (None,) * 4]):
                    if kind == 0:
                        if now is not None:
                            opened = [block for block in opened if block.read(now, sums[block.run])]
                        now = _unpack(pairs, np.uint32, np.uint64, np.uint32) if pairs is not None else None
                        continue
                    sums.setdefault(run, np.zeros((2, documents), np.int64))
                    opened.append(Open(run, pairs, records))
                for run, found in sums.items():
                    yield run, found.shape[1], _pack(found)

        yield from _batches(rows(), ["run", "documents", "sums"], [pa.int64(), pa.int32(), pa.binary()], 16)

    dealt = _dealt(counts.unionByName(runs), parts, "first", "kind")
    partial = map_batches(dealt, contribute, "run long, documents int, sums binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, group in groupby(_rows(batches), lambda row: row[0]):
            total = None
            for _, documents, block in group:
                found = _unpack(block, np.int64)[0].reshape(2, documents)
                total = found.copy() if total is None else total + found
            places = np.flatnonzero(total[1])
            columns = [np.full(len(places), run), places.astype(np.int32), total[0][places], total[1][places]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["spill", "place", "n_best", "count_sum"])

    together = partial.repartition("run").sortWithinPartitions("run")
    return map_batches(together, add, "spill long, place int, n_best long, count_sum long")


def align_tokens(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    path_a: str = A_PATH,
    path_b: str = B_PATH,
    digest: bool = False,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Per document: ``row``, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids in order.  With ``digest`` it is the SHA-256 of that text, in
    lowercase hex, or empty as the text is; the text itself is several times as long as the document and then not stored.
    """
    paths = (path_a, path_b)
    encoded = _encoded(docs, text, keep, paths, digest, sizes)
    counted, spills = _counted(encoded, paths, sizes)
    found = _contributions(encoded, counted, spills, sizes)
    mine = encoded.where("radix is null").select("row", "spill", "place", "n_a", "n_b", "n_groups", "n_links", "groups")
    added = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("n_best", "count_sum")]
    return mine.join(found, ["spill", "place"], "left").select(
        "row", "n_a", "n_b", "n_groups", "n_links", *added, "groups"
    )


def pair_counts(
    docs: DataFrame, text: str = "text", path_a: str = A_PATH, path_b: str = B_PATH, sizes: Sizes = Sizes()
) -> DataFrame:
    """(a, b, n, best): how often each pair of ids is linked, and whether that is the most for its B id."""
    paths = (path_a, path_b)
    counted, _ = _counted(_encoded(docs, text, [], paths, True, sizes), paths, sizes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _aligner(*paths).ids
        for (block,) in _rows(batches):
            keys, totals, marks = _unpack(block, np.uint32, np.uint64, np.uint32)
            a, b = zip(*map(ids, keys.tolist()), strict=True)
            columns = [pa.array(c, pa.int64()) for c in (a, b, totals.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks == 1)], ["a", "b", "n", "best"])

    return map_batches(counted.select("pairs"), spread, "a long, b long, n long, best boolean")
