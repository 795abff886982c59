"""Line deduplication by winnowing over line hashes.

A run of lines with ``least_words`` words that occurs earlier goes: in a document of smaller doc_id, or further up in
the same one.  A window starts at a line and ends at the first line with which it holds that many words, or ends at a
line and starts at the last one with which it does.  Every line of a repeated run lies in a window of one of the two
kinds that is within the run, so the match grows both ways to its full length, whichever earlier place it agrees with.

The least line hash of a window (the last one among equals) is its fingerprint: equal windows choose the same line, so
every run of lines with that many words that occurs twice shares a fingerprint at the same place.  Fingerprints
found at one place only are dropped first.  For the others, the windows around the fingerprint are joined with
the earliest place of the same window, and overlapping windows are one match.  A line is deleted if it lies in
such a window that occurs earlier.  Of a run that repeats itself with overlap, the first period stays.

Places of a window are reduced to the earliest by a minimum that combines before the shuffle, so a passage in
a third of all documents forms no pairs.  Lines are compared as 64-bit hashes, windows by the hash of theirs.

* lines are what ``\\n`` separates, compared exactly; a line without words belongs to the run around it.
* null text stays null; empty text and documents with fewer words than a window stay as they are.
* null doc_id comes before all others.  Repeated rows (same doc_id and text) are one document: the rows stay
  or change alike.  Equal ids with different texts are ordered by the hash of the text.
* a document whose every line goes keeps an empty text in ``dedup_lines``; ``without_repeats`` leaves it out.
* other columns pass through and may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, document_key, map_batches, packed, stored

LEAST_WORDS = 30

_WINDOWS = "doc_id long, text_key long, start int, stop int, at int, print long, window long"


def _minimal(hashes: list[int], words: list[int], least_words: int) -> Iterator[tuple[int, int, int]]:
    """(first line, line after the last, line of the least hash) of the windows that start at each line."""
    least: deque[int] = deque()
    stop = total = 0
    for start in range(len(hashes)):
        while stop < len(hashes) and total < least_words:
            while least and hashes[least[-1]] >= hashes[stop]:
                least.pop()
            least.append(stop)
            total += words[stop]
            stop += 1
        if total < least_words:
            return
        at = least[0]
        yield start, stop, at
        total -= words[start]
        if at == start:
            least.popleft()


def windows(lines: list[str], least_words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first line, line after the last, fingerprint's line, fingerprint, hash of the window) of each window."""
    coded = [line.encode() for line in lines]
    hashes = [xxhash.xxh64_intdigest(line) for line in coded]
    packed_hashes = np.array(hashes, dtype=np.uint64).tobytes()
    words = [len(line.split()) for line in coded]  # bytes are split at ASCII white space only
    stops = {}
    for start, stop, at in _minimal(hashes, words, least_words):
        stops[start] = stop
        yield start, stop, at, hashes[at], xxhash.xxh64_intdigest(packed_hashes[8 * start : 8 * stop])
    n = len(lines)
    for *bounds, at in _minimal(hashes[::-1], words[::-1], least_words):
        stop, start = (n - x for x in bounds)
        # A window of both kinds is one wherever it occurs, and has been given already.
        if stops.get(start) != stop:
            at = n - 1 - at
            yield start, stop, at, hashes[at], xxhash.xxh64_intdigest(packed_hashes[8 * start : 8 * stop])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _window_batches(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for k in range(0, len(ids), 64):
                rows = [
                    (doc, key, *w)
                    for doc, key, text in zip(ids[k : k + 64], keys[k : k + 64], texts[k : k + 64])
                    if text
                    for w in windows(text.split("\n"), least_words)
                ]
                if rows:
                    doc, key, start, stop, at, prints, window = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc, pa.int64()),
                            pa.array(key, pa.int64()),
                            *[pa.array(x, pa.int32()) for x in (start, stop, at)],
                            _signed(prints),
                            _signed(window),
                        ],
                        names=["doc_id", "text_key", "start", "stop", "at", "print", "window"],
                    )

    return run


def _place(*more: str) -> Column:
    return F.struct("doc_id", "text_key", *more)


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document with repeats: doc_id, text_key, runs (array of first line, line after the last)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("text_key"), "text")
    found = stored(map_batches(texts, _window_batches(least_words), _WINDOWS), "lines-windows")
    places = found.groupBy("print").agg(F.min(_place("at")).alias("first"), F.max(_place("at")).alias("last"))
    shared = places.where("first != last").select("print")
    around = found.join(shared, "print", "left_semi")
    ends = around.groupBy("window").agg(F.min(_place("start")).alias("first"), F.max(_place("start")).alias("last"))
    ends = ends.where("first != last").select("window", "first")
    later = around.join(ends, "window").where(_place("start") > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("windows"))


def kept_lines(text: str, found: list) -> tuple[list[str], int]:
    """The lines that stay and the number of those that go."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    np.add.at(gone, [w["start"] for w in found], 1)
    np.add.at(gone, [w["stop"] for w in found], -1)
    gone = np.cumsum(gone)[:-1] > 0
    return [line for line, out in zip(lines, gone) if not out], int(gone.sum())


def _rewritten(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, found in batches:
        kept, n_lines, n_gone = [], [], []
        for text, spans in zip(texts.to_pylist(), found.to_pylist()):
            n_lines.append(0 if text is None else text.count("\n") + 1)
            if spans:
                left, gone = kept_lines(text, spans)
                kept.append("\n".join(left))
                n_gone.append(gone)
            else:
                kept.append(text)
                n_gone.append(0)
        yield pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())],
            names=["text", "n_lines", "n_removed"],
        )


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``row`` (the input row as a struct), its deduplicated ``text``, n_lines and n_removed."""
    found = repeated_runs(docs, least_words).select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key"), "windows"
    )
    rows = docs.select(packed(docs).alias("row"))
    rows = rows.withColumn("doc", F.col("row.doc_id").cast("long")).withColumn("key", document_key("row.text"))
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key"))
    rewrite = arrow_column(docs.sparkSession, _rewritten, "struct<text:string,n_lines:bigint,n_removed:bigint>")
    # Spark runs a deterministic function once more, in workers of its own, for a filter on its result.
    rewrite = rewrite.asNondeterministic()
    joined = rows.join(found, same, "left").select("row", rewrite(F.col("row.text"), F.col("windows")).alias("done"))
    return joined.select("row", "done.*")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut from their texts; documents of which nothing stays are left out."""
    done = dedup_lines(docs, least_words).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return done.select(
        *[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
