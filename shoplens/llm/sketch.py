"""Document fingerprints: threshold-scaled sketches.

A fingerprint keeps every hash of a word shingle below a fixed fraction of the hash range.  Which hashes it keeps
does not depend on the size of the text, so fingerprints merge by union and estimate the containment of a short
document in a long one as well as that of equals.  A text whose hashes all lie above the threshold keeps its least
one as a stand-in; being above the threshold, a stand-in is recognised, and a merge with kept hashes drops it.
The containment of short texts is an estimate from few hashes; README gives its error by size.

For the comparison of neighbours, ids and hashes of texts, without the texts, are sorted by ranges and stored with their
places.  Each partition of that table is cut into cells of CELL rows, whatever ids they have, so the size of a cell does
not depend on the size of the corpus.  Texts travel to their cells compressed.  The first document of a cell is also sent
to the cell before it, so that the next document is at hand everywhere; only the partitions' own ends have to be looked
up, in a table with a row for each.

* null or empty text, or text without words: empty fingerprint.  Two empty fingerprints are alike (1), an empty
  and a full one are not (0).  Texts with fewer words than a shingle have one shingle of all their words.
* null doc_id comes first.  Repeated ids follow each other in the order of their texts' hashes.  Rows equal in id and
  text follow each other and share a cell.
* very long texts: read whole, by the task that has their cell.
* one document alone is its own next document.  An empty table gives an empty result.
* other columns are neither read nor needed, and may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, held, map_batches, stored

SHINGLE = 5
FRACTION = 1 / 2
CELL = 512
REMEMBERED_WORDS = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """Hashes of words, remembered while there are not too many."""

    def __init__(self):
        self.known: dict = {}

    def of(self, words: list) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one hash of them all."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    total = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : len(hashes) - size + 1 + k])
    return total


def sketch(words: WordHashes, text: str | None, size: int, fraction: float) -> np.ndarray:
    """The kept hashes, ascending."""
    found = shingle_hashes(words.of(text.split()) if text else np.zeros(0, np.uint64), size)
    kept = np.unique(found[found < np.uint64(int(fraction * 2**64))])
    return kept if len(kept) or not len(found) else np.array([found.min()])


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller fingerprint that lies in the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The fingerprint of two texts together."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64(int(fraction * 2**64))]
    return kept if len(kept) else both[:1]


def written(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compressed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    compressor = zstandard.ZstdCompressor(level=6)
    for texts in batches:
        yield pa.array([compressor.compress((t or "").encode()) for t in texts.to_pylist()], pa.binary())


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, that of the next document by doc_id (after the last: the first), compressed."""
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of_text")]
    order = [F.col("doc_id").asc_nulls_first(), F.col("of_text")]
    keys = docs.select(*key).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(keys.select("*", F.monotonically_increasing_id().alias("place")), "sketch-places")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition, and what comes before it: the last cell of the partition before, or of the last one.
    ends = placed.groupBy(part.alias("part")).agg(F.floor(F.max(row) / CELL).alias("last_cell"))
    end = F.struct("part", "last_cell")
    before = F.coalesce(F.lag(end).over(Window.orderBy("part")), F.max(end).over(Window.partitionBy()))
    ends = stored(ends.select(F.col("part").alias("of_part"), before.alias("before")), "sketch-ends")

    small = arrow_column(docs.sparkSession, _compressed, "binary")(F.col("text"))
    rows = docs.select(*key, small.alias("text"))
    found = placed.select(F.col("doc_id").alias("of_doc"), F.col("of_text").alias("same_text"), "place")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("of_text") == F.col("same_text"))
    cells = rows.join(found, same).select(
        "doc_id", "text", "place", part.alias("part"), F.floor(row / CELL).alias("cell"), (row % CELL == 0).alias("head")
    )
    guests = F.when(F.col("cell") > 0, F.struct("part", (F.col("cell") - 1).alias("cell")))
    guests = guests.otherwise(F.struct(F.col("before.part").alias("part"), F.col("before.last_cell").alias("cell")))
    own = F.struct("part", "cell", F.lit(False).alias("guest"))
    sent = F.struct(guests["part"].alias("part"), guests["cell"].alias("cell"), F.lit(True).alias("guest"))
    places = F.when(F.col("head"), F.array(own, sent)).otherwise(F.array(own))
    # The broadcast side has a row for each partition of the sort.
    flagged = cells.join(F.broadcast(ends), F.col("part") == F.col("of_part"))
    flagged = flagged.select("doc_id", "text", "place", F.explode(places).alias("at"))
    following = Window.partitionBy("part", "cell").orderBy("guest", "place")
    paired = flagged.select("doc_id", "text", "place", "at.*").select(
        "doc_id", "text", F.lead("text").over(following).alias("next_text"), "guest"
    )
    return paired.where("not guest").drop("guest")


def word_hashes() -> WordHashes:
    """Those of this worker."""
    return held(("words",), WordHashes)


def _compared(size: int, fraction: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        last: tuple[str, np.ndarray] = ("", sketch(hashes, "", size, fraction))
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            chars, sums, own, changed, near_edited, near_next = [], [], [], [], [], []
            for one, two in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, following = expand(one).decode(), expand(two).decode()
                # The next document of the row before is usually this one.
                mine = last[1] if last[0] == text else sketch(hashes, text, size, fraction)
                other = edited(text, following)
                theirs = sketch(hashes, other, size, fraction)
                last = (following, sketch(hashes, following, size, fraction))
                chars.append(len(text))
                sums.append(hashlib.sha256(other.encode()).hexdigest())
                own.append(written(mine))
                changed.append(written(theirs))
                near_edited.append(containment(mine, theirs))
                near_next.append(containment(mine, last[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(chars, pa.int64()),
                    pa.array(sums, pa.string()),
                    pa.array(own, pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array(near_edited, pa.float64()),
                    pa.array(near_next, pa.float64()),
                ],
                names=_COMPARED.replace(",", "").split()[::2],
            )

    return run


_COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compare_neighbours(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, and their likeness to each other and the next."""
    return map_batches(with_next(docs), _compared(size, fraction), _COMPARED)


def fingerprints(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: doc_id and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            found = [written(sketch(hashes, t, size, fraction)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, fingerprint string")
