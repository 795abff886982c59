"""Near duplicates by b-bit MinHash.

A document is the set of its distinct word shingles, as 64-bit hashes.  Documents of equal sets are one class, and
only one representative of a class goes on.  Of each set ``minima`` hash minima are taken; groups of ``rows`` minima
make band keys, and of every minimum the low ``BITS`` bits are kept, packed into bit planes.  Representatives that
share a band key are candidates; counting equal bits of their planes, corrected for chance collisions, estimates
their similarity and drops pairs that are far below the limit.  The rest are confirmed on the full sets.

No group forms all its pairs.  First each member of a band is held against the band's least member only, and the
links found are joined to components.  A band is done if it then lies in one component.  In bands of up to
``SMALL_BAND`` members the remaining pairs across components are tried one by one.  The members of larger bands are
gathered by the bands that connect them and compared in blocks: blocks of ``BLOCK`` documents meet two at a time in
a task, which multiplies their incidence matrix, and returns a spanning forest of the links it finds.  A document
of which too large a part is shared with nobody in the block cannot have a link and leaves the matrix first.

The limit is exact: ``100 * |A and B| >= percent * |A or B|``.  With the defaults a link of just 0.8 shares no band
with a probability of three in a million, one of 0.85 with seven in a billion; the estimate, with a slack of five
standard errors, drops a link with less than one in a million.

* null or empty text, or text without words: empty set, linked with nothing.
* texts with fewer words than a shingle: the whole sequence of words is the one shingle.
* rows with the same doc_id are one vertex, and so are all rows without doc_id: links of any of them count for all,
  and their component is the same.  Rows without doc_id are the last vertex and get a null component_id if alone.
* an empty table gives an empty result.  Other columns pass through ``without_copies`` and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, packed, stored
from .components import components
from .sketch import mixed, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
ROWS = 5
BANDS = 32
BITS = 4
SMALL_BAND = 32
BLOCK = 1024
LAST = (1 << 63) - 1

_SKETCHED = "vertex long, cls long, cls2 long, n long, bands array<long>, planes array<long>"


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes, ascending.  Words are lower-cased in A-Z and split at ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(word_hashes().of(words), size))


def class_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    first = mixed(found + np.uint64(1)).sum(dtype=np.uint64)
    second = mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def _functions(minima: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(8)
    odd = random.integers(0, 1 << 31, (minima, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, random.integers(0, 1 << 32, (minima, 1), dtype=np.uint32)


def minima_of(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    odd, flip = functions
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), np.uint32(0xFFFFFFFF))
    for k in range(0, len(short), 4096):
        least = np.minimum(least, ((short[k : k + 4096] ^ flip) * odd).min(axis=1))
    return least


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    parts = minima.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(parts), dtype=np.uint64)
    for r in range(rows):
        key = mixed(key + parts[:, r])
    return key.view(np.int64)


def bit_planes(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima: for each bit, one bit per minimum, padded to whole 64-bit numbers."""
    width = -(-len(minima) // 64) * 64
    bits = np.zeros((BITS, width), dtype=np.uint8)
    bits[:, : len(minima)] = (minima >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64)


def _sketches(size: int, rows: int, bands: int):
    functions = _functions(rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second, keys, planes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                cls, cls2 = class_of(found)
                first.append(cls)
                second.append(cls2)
                least = minima_of(found, functions) if len(found) else None
                keys.append(None if least is None else band_keys(least, rows))
                planes.append(None if least is None else bit_planes(least))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(x, pa.int64()) for x in (first, second, n)],
                    *[pa.array(x, pa.list_(pa.int64())) for x in (keys, planes)],
                ],
                names=["vertex", "cls", "cls2", "n", "bands", "planes"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vertex, cls, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = shingles(text, size)
                if class_of(found)[0] == cls:  # the same doc_id may stand for other texts
                    rows.append((vertex, cls, len(found), found.tobytes()))
            if rows:
                vertex, cls, n, data = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vertex, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
                    names=["vertex", "cls", "n", "hashes"],
                )

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, one, two in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    rows.append((a, b))
            if rows:
                a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def block_links(vertices: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some documents."""
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column)[column] > 1
    inside = np.bincount(row[shared], minlength=len(sets))
    open_ = 100 * inside >= percent * sizes  # an upper bound of the similarity to any other
    chosen = np.flatnonzero(open_)
    if len(chosen) < 2:
        return []
    keep = shared & open_[row]
    place = np.cumsum(open_) - 1
    row, (_, column) = place[row[keep]], np.unique(column[keep], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(chosen), len(chosen)), dtype=np.float32)
    step = 4096
    for low in range(0, int(column[-1]) + 1, step):
        i, j = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(chosen), step), dtype=np.float32)
        part[row[i:j], column[i:j] - low] = 1.0
        common += part @ part.T
    sizes = sizes[chosen]
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    links, left = [], np.ones(len(chosen), dtype=bool)
    for start in range(len(chosen)):
        if left[start]:
            left[start] = False
            heap = [start]
            while heap:
                at = heap.pop()
                new = np.flatnonzero(linked[at] & left)
                left[new] = False
                links += [(int(vertices[chosen[at]]), int(vertices[chosen[k]])) for k in new]
                heap += new.tolist()
    return links


def _block(percent: int):
    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        links = block_links(group.column("vertex").to_numpy(), sets, percent)
        return pa.table(
            {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
        )

    return run


def _estimate(minima: int) -> Column:
    """Similarity from the planes ``a_planes`` and ``b_planes``: equal minima, less those equal by chance."""
    words = -(-minima // 64)
    unequal = F.lit(0)
    for w in range(words):
        differ = None
        for bit in range(BITS):
            at = F.lit(bit * words + w)
            x = F.get("a_planes", at).bitwiseXOR(F.get("b_planes", at))
            differ = x if differ is None else differ.bitwiseOR(x)
        unequal = unequal + F.bit_count(differ)
    chance = 2.0**-BITS
    return (1 - unequal / minima - chance) / (1 - chance)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("vertex"), "text")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (the document is that one)."""
    minima = rows * bands
    slack = 5 * (0.25 / minima) ** 0.5  # five standard errors, with the largest variance
    texts = _texts(docs)
    sketched = stored(map_batches(texts, _sketches(size, rows, bands), _SKETCHED), "near-sketches")
    full = sketched.where("n > 0")
    key = ["cls", "cls2", "n"]
    firsts = full.groupBy(*key).agg(F.min("vertex").alias("first"))
    representatives = stored(
        full.join(firsts, key).where("vertex = first").drop("first").dropDuplicates(["vertex", "cls"]), "near-first"
    )
    banded = representatives.select("vertex", "cls", F.explode("bands").alias("band"))
    shared = (
        banded.groupBy("band")
        .agg(F.count("*").alias("members"), F.min(F.struct("vertex", "cls")).alias("hub"))
        .where("members > 1")
    )
    members = stored(banded.join(shared, "band"), "near-bands")
    wanted = members.select("vertex", "cls").distinct()
    sets = stored(
        map_batches(
            texts.join(wanted, "vertex").select("vertex", "cls", "text"),
            _sets(size),
            "vertex long, cls long, n long, hashes binary",
        ),
        "near-sets",
    )
    planes = representatives.join(wanted, ["vertex", "cls"]).select("vertex", "cls", "n", "planes")
    planes = stored(planes, "near-planes")

    def side(name: str, df: DataFrame, *columns: str) -> DataFrame:
        return df.select(
            F.col("vertex").alias(f"{name}_vertex"), F.col("cls").alias(f"{name}_cls"),
            *[F.col(c).alias(f"{name}_{c}") for c in columns],
        )

    def confirm(pairs: DataFrame, purpose: str) -> DataFrame:
        """Links among distinct pairs of a_vertex, a_cls, b_vertex, b_cls."""
        a, b = ["a_vertex", "a_cls"], ["b_vertex", "b_cls"]
        likely = (
            pairs.distinct()
            .join(side("a", planes, "n", "planes"), a)
            .join(side("b", planes, "n", "planes"), b)
            .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            .where(_estimate(minima) >= percent / 100 - slack)
            .select(*a, *b)
        )
        joined = likely.join(side("b", sets, "hashes"), b).join(side("a", sets, "hashes"), a)
        joined = joined.select("a_vertex", "b_vertex", "a_hashes", "b_hashes")
        return stored(map_batches(joined, _confirmed(percent), "a long, b long"), purpose)

    hub = F.struct("vertex", "cls") != F.col("hub")
    stars = members.where(hub).select(
        F.col("hub.vertex").alias("a_vertex"),
        F.col("hub.cls").alias("a_cls"),
        F.col("vertex").alias("b_vertex"),
        F.col("cls").alias("b_cls"),
    )
    links = confirm(stars, "near-links")
    # A doc_id that stands for several texts ties their classes together.
    several = full.groupBy("vertex").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least != most")
    tied = full.join(several, "vertex").join(firsts, key).select(F.col("vertex").alias("a"), F.col("first").alias("b"))
    links = links.union(tied)
    found = components(links, "a", "b")

    placed = members.where("members > 2").join(
        found.withColumnRenamed("component", "c"), "vertex", "left"
    ).withColumn("c", F.coalesce("c", "vertex"))
    unfinished = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    unfinished = stored(placed.join(unfinished.select("band"), "band"), "near-open")
    small = unfinished.where((F.col("members") <= SMALL_BAND) & hub)
    pairs = side("a", small, "band", "c").join(
        side("b", small, "band", "c"),
        (F.col("a_band") == F.col("b_band")) & (F.col("a_c") < F.col("b_c")),
    )
    more = confirm(pairs.select("a_vertex", "a_cls", "b_vertex", "b_cls"), "near-more")

    large = unfinished.where(F.col("members") > SMALL_BAND)
    groups = components(large.select("vertex", F.col("hub.vertex").alias("hub_vertex")), "vertex", "hub_vertex")
    gathered = large.select("vertex", "cls").distinct().join(groups, "vertex", "left")
    gathered = stored(gathered.withColumn("grp", F.coalesce("component", "vertex")).drop("component"), "near-large")
    blocks = gathered.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("vertex", "cls"), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks").cast("int") - 1),
        lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")),
    )
    # With two blocks or more, a block meets itself wherever it meets another.
    meets = F.when(F.col("blocks") > 1, F.filter(meets, lambda m: m["i"] != m["j"])).otherwise(meets)
    dealt = gathered.join(blocks, "grp").select("vertex", "cls", "grp", F.explode(meets).alias("m"))
    dealt = dealt.join(sets, ["vertex", "cls"]).select("grp", "m.i", "m.j", "vertex", "hashes")
    in_blocks = dealt.groupBy("grp", "i", "j").applyInArrow(_block(percent), "a long, b long")
    final = components(links.union(more).union(in_blocks), "a", "b")

    classes = firsts.join(final, F.col("first") == F.col("vertex"), "left").select(
        *key, F.coalesce("component", "first").alias("c")
    )
    own = sketched.select("vertex", *key).join(classes, key, "left")
    none = F.lit(None).cast("long")
    component = F.coalesce("c", "vertex")
    return own.select(
        F.when(F.col("vertex") != LAST, F.col("vertex")).otherwise(none).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != LAST, component).otherwise(none).alias("component_id"),
        (component == F.col("vertex")).alias("kept"),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which no near duplicate of smaller doc_id exists; one document of a group stays."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("gone"))
    rows = docs.select(packed(docs).alias("row"))
    rows = rows.withColumn("vertex", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)))
    return rows.join(gone.distinct(), F.col("vertex") == F.col("gone"), "left_anti").select("row.*")
