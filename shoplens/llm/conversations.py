"""Repair of conversations by weighted interval parsing.

A conversation should have the roles ``(s?(ua)+)?`` (initials of system, user and assistant).  Its turns may be kept
(cost 0), get another role (3), be deleted (4), and turns without text may be inserted (3); a blank turn or one that
repeats an earlier one must go, and a turn cut off that stays costs 3 more.  Of the cheapest edits the audit, their
initials in order, is the least by ASCII.

The repair grammar is in Chomsky normal form.  Its nonterminals are pairs of states before and after a span, with
``[p, q] -> [p, r] [r, q]`` for spans and one rule for each edit of a single turn.  A cell of the table holds the least
(cost, audit) of each nonterminal for one span.  Insertions need no turn: their closure is worked into the cell of a
single turn from both sides.  Cells are combined bottom-up by span length.  Because a nonterminal names the state at
either end of its span, every split of a span gives the same cell, so one split is enough and lengths double: a
conversation of n turns takes n combinations.  (No audit of a span is the beginning of another one of equal cost: they
would differ by insertions alone, which cost.  So the least audit of a span is made of least audits.)

Turns are sorted by range, so a long conversation is spread over tasks; each makes one cell of its stretch, and the
cells of a conversation are combined in order.  Repeated turns are found by an aggregate that is combined before the
shuffle.  One conversation's digest is a single hash, so its turns pass one task, one by one.

* null role or text: one space, hence a blank turn.  null turn: sorted first.  null conv_id: a conversation of its own.
* equal turns: by role, then text, in code point order; a repeated row stands beside its copy.
* roles count by their first character; an empty role or another initial cannot be kept.
* empty and very long texts: read whole; a text is never cut.
* a conversation of which no turn is left: zeros, no audit, the hash of the empty string.
* other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
MOVES = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
STATES = range(4)
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
WHOLE, GONE, CUT = "whole", "gone", "cut"  # what a turn's fault allows

#: The least (cost, audit) by states before and after a span.
Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: ``[p, q] -> [p, r] [r, q]``."""
    cell: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            other = right.get((r, q))
            if other is not None:
                total = cost + other[0]
                known = cell.get((p, q))
                if known is None or total <= known[0]:
                    found = (total, audit + other[1])
                    if known is None or found < known:
                        cell[p, q] = found
    return cell


def _better(one: Cell, other: Cell) -> Cell:
    keys = one.keys() | other.keys()
    return {key: min(cell[key] for cell in (one, other) if key in cell) for key in keys}


@cache
def insertions() -> Cell:
    """The closure of insertions: the cell of a span without turns."""
    none = {(p, p): (0, "") for p in STATES}
    one = {(p, q): (INSERT, "I") for (initial, p), q in MOVES.items() if initial in NAMES}
    closure = none
    while (wider := _better(closure, combine(closure, one))) != closure:
        closure = wider
    return closure


@cache
def turn_cell(initial: str, fault: str) -> Cell:
    """The cell of one turn, with insertions before and after it."""
    edits: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault != GONE:
        more = CUT_OFF if fault == CUT else 0
        for (role, p), q in MOVES.items():
            found = []
            if role == initial:
                found.append((more, "K"))
            if role in NAMES:
                found.append((RETYPE + more, "R"))
            if found:
                edits = _better(edits, {(p, q): min(found)})
    return combine(combine(insertions(), edits), insertions())


def span_cell(cells: Iterable[Cell]) -> Cell:
    """The cell of neighbouring spans, combined by twos until one is left."""
    cells = list(cells)
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else insertions()


def best_repair(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def apply_audit(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that are left, from an audit and (role, text) in order."""
    state, turns = 0, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
        yield edit, role if edit == "K" else NAMES[initial], text
        state = MOVES[initial, state]


# Spark


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the damage that a checksum of conv_id and turn decides."""
    named = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    filled = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    )
    copies = F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return filled.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``place``, which grows in order of conversation and turn, stored."""
    keys = ["conv_id", "turn", "role"]
    dealt = turns.repartitionByRange(*keys, F.substring("text", 1, 32))
    ordered = dealt.sortWithinPartitions(*keys, "text", "copy")
    return stored(
        ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "turns"
    )


def _judged(placed: DataFrame) -> DataFrame:
    """(conv_id, place, stretch, initial, fault): the first fault of every turn."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = placed.select(
        "conv_id", "place", F.substring("role", 1, 1).alias("initial"), blank.alias("is_blank"), ended.alias("ended"), same.alias("same")
    )
    firsts = rows.groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("is_blank"), "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.col("ended"), "truncated")
        .otherwise("none")
    )
    stretch = F.shiftright("place", 33).alias("stretch")
    return rows.drop("same").join(firsts, "place", "left").select("conv_id", "place", stretch, "initial", fault.alias("fault"))


_ALLOWS = {"none": WHOLE, "blank": GONE, "duplicate": GONE, "truncated": CUT}
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_CELL_KEYS = [(p, q) for p in STATES for q in STATES]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _stretches(judged: DataFrame, id_type: str) -> DataFrame:
    """One row per conversation and stretch: its cell, its counts and the roles at its ends."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (_, conv_id), turns in groupby(_rows(batches), lambda row: row[:2]):
                counts = dict.fromkeys(_COUNTS, 0)
                cells, first, last, start = [], None, None, None
                for _, _, place, initial, fault in turns:
                    cells.append(turn_cell(initial, _ALLOWS[fault]))
                    if fault != "none":
                        counts[fault] += 1
                    if first is None:
                        first, start = initial, place
                    else:
                        counts["illegal"] += last + initial not in LEGAL
                    last = initial
                cell = span_cell(cells)
                costs, audits = zip(*(cell.get(key, (None, None)) for key in _CELL_KEYS), strict=True)
                yield conv_id, start, first, last, *counts.values(), costs, audits

        yield from _in_batches(rows(), _stretch_schema(ids), 64)

    ids = _arrow_type(id_type)
    dealt = judged.repartition("stretch").sortWithinPartitions("stretch", "place")
    schema = f"conv_id {id_type}, start long, first string, last string, {_LONGS}, costs array<long>, audits array<string>"
    return map_batches(dealt.select("stretch", "conv_id", "place", "initial", "fault"), parse, schema)


_LONGS = ", ".join(f"{name} long" for name in _COUNTS)


def _arrow_type(id_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]


def _stretch_schema(ids: pa.DataType) -> pa.Schema:
    fields = [("conv_id", ids), ("start", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    fields += [(name, pa.int64()) for name in _COUNTS]
    return pa.schema([*fields, ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _parsed(stretches: DataFrame, id_type: str) -> DataFrame:
    """(conv_id, counts, cost, audit) of every conversation that has turns."""
    ids = _arrow_type(id_type)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv_id, stretches in groupby(_rows(batches), lambda row: row[0]):
                counts, cells, last = [0] * len(_COUNTS), [], None
                for _, _, first, end, *found, costs, audits in stretches:
                    counts = [a + b for a, b in zip(counts, found, strict=True)]
                    if last is not None:
                        counts[-1] += last + first not in LEGAL
                    last = end
                    whole = zip(_CELL_KEYS, costs, audits, strict=True)
                    cells.append({key: (cost, audit) for key, cost, audit in whole if cost is not None})
                yield conv_id, *counts, *best_repair(span_cell(cells))

        fields = [("conv_id", ids), *((name, pa.int64()) for name in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())]
        yield from _in_batches(rows(), pa.schema(fields))

    dealt = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return map_batches(dealt, join, f"conv_id {id_type}, {_LONGS}, cost long, audit string")


def _with_audits(placed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its turns in order, in one task."""
    audits = parsed.select("conv_id", F.lit(-1).cast("long").alias("place"), F.col("audit").alias("role"), F.lit("").alias("text"))
    both = placed.select("conv_id", "place", "role", "text").unionByName(audits)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, iterator of (edit, role, text)) of each conversation."""
    for conv_id, rows in groupby(_rows(batches), lambda row: row[0]):
        _, _, audit, _ = next(rows)
        yield conv_id, apply_audit(audit, ((role, text) for _, _, role, text in rows))


def _digests(placed: DataFrame, parsed: DataFrame, id_type: str) -> DataFrame:
    ids = _arrow_type(id_type)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv_id, turns in _repaired(batches):
                whole = sha256()
                for k, (_, role, text) in enumerate(turns):
                    whole.update(f"{chr(10) if k else ''}{role}:{text}".encode())
                yield conv_id, whole.hexdigest()

        yield from _in_batches(rows(), pa.schema([("conv_id", ids), ("repaired_sha256", pa.string())]))

    return map_batches(_with_audits(placed, parsed), digest, f"conv_id {id_type}, repaired_sha256 string")


def _id_type(turns: DataFrame) -> str:
    return turns.schema["conv_id"].dataType.simpleString()


def _parts(turns: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    kind = _id_type(turns)
    placed = _placed(turns)
    parsed = stored(_parsed(_stretches(_judged(placed), kind), kind), "repairs")
    return placed, parsed, kind


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation after its repair, in order of place.

    ``turns`` has conv_id (bigint, int or string), turn, role, text and copy (its place among equal rows).
    """
    placed, parsed, kind = _parts(turns)
    ids = _arrow_type(kind)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv_id, k, *turn) for conv_id, turns in _repaired(batches) for k, turn in enumerate(turns))
        texts = [(name, pa.string()) for name in ("edit", "role", "text")]
        yield from _in_batches(rows, pa.schema([("conv_id", ids), ("place", pa.int64()), *texts]))

    schema = f"conv_id {kind}, place long, edit string, role string, text string"
    return map_batches(_with_audits(placed, parsed), repair, schema)


def repair_conversations(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Gaps, faults, cost, audit and digest of each conversation in ``conversations``, given its ``turns`` in part."""
    placed, parsed, kind = _parts(turns)
    gaps = (
        placed.where("turn is not null")
        .groupBy("conv_id", "turn")
        .agg(F.lit(1).alias("one"))
        .groupBy("conv_id")
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    )
    digests = _digests(placed, parsed, kind)
    every = conversations.select("conv_id").distinct()
    parts = every
    for part in (gaps, parsed, digests):
        parts = parts.unionByName(part, allowMissingColumns=True)
    whole = parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(name), F.lit(0).cast("long")).alias(name) for name in ("gaps", *_COUNTS, "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
    return whole
