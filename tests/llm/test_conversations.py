import re
from hashlib import sha256
from itertools import product
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplens.llm import conversations as conv
from shoplens.llm import queries

SPACE = " \t\n\v\f\r"
TURN = st.tuples(st.sampled_from("suax"), st.sampled_from([conv.WHOLE, conv.GONE, conv.CUT]))


def brute(turns):
    """The least (cost, audit) over all edits with up to two insertions a place, from the definition."""
    found = []

    def go(k, roles, cost, audit, inserted):
        if inserted < 2:
            for role in "ua":
                go(k, roles + role, cost + 3, audit + "I", inserted + 1)
        if k == len(turns):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
            return
        if not re.fullmatch("s?(ua)*u?", roles):  # nothing that follows can mend it
            return
        initial, fault = turns[k]
        go(k + 1, roles, cost + 4, audit + "D", 0)
        if fault != conv.GONE:
            more = 3 if fault == conv.CUT else 0
            go(k + 1, roles + initial, cost + more, audit + "K", 0)
            for role in "ua":
                go(k + 1, roles + role, cost + more + 3, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


@settings(max_examples=60, deadline=None)
@given(st.lists(TURN, max_size=4))
def test_cells_against_all_edits(turns):
    assert conv.best_repair(conv.span_cell(conv.turn_cell(*turn) for turn in turns)) == brute(turns)


@settings(max_examples=100, deadline=None)
@given(st.lists(TURN, min_size=2, max_size=9))
def test_every_split_gives_the_same_cell(turns):
    cells = [conv.turn_cell(*turn) for turn in turns]
    whole = conv.span_cell(cells)
    for k in range(1, len(cells)):
        assert conv.combine(conv.span_cell(cells[:k]), conv.span_cell(cells[k:])) == whole


def forward(turns):
    """Least (cost, audit) by state after each turn, left to right: a plainer way that shares no code."""
    table = {"": (0, "")}  # by the roles so far, reduced to "", s, u, a

    def move(state, role):
        if role == "s":
            return "s" if state == "" else None
        return {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role))

    def put(into, state, value):
        if state is not None and (state not in into or value < into[state]):
            into[state] = value

    def insert(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for role in "ua":
                    put(states, move(state, role), (cost + 3, audit + "I"))
        return states

    table = insert(table)
    for initial, fault in turns:
        after = {}
        for state, (cost, audit) in table.items():
            put(after, state, (cost + 4, audit + "D"))
            if fault in ("none", "truncated"):
                more = 3 * (fault == "truncated")
                put(after, move(state, initial), (cost + more, audit + "K"))
                for role in "ua":
                    put(after, move(state, role), (cost + more + 3, audit + "R"))
        table = insert(after)
    return min(table[state] for state in ("", "a") if state in table)


def expected(rows):
    """The query's rows from (conv_id, turn, role, text), by the contract."""
    found = {}
    for conv_id in {row[0] for row in rows}:
        kept = []
        for _, turn, role, text in (row for row in rows if row[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            kind = crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
        if not kept:
            found[conv_id] = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
            continue
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.rstrip(SPACE)
            if not bare:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("none" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [turn for turn, _, _ in kept if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = forward(list(zip(initials, faults)))
        out, rest, letter = [], iter(kept), None
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(rest)
            if edit != "D":
                letter = role[0] if edit == "K" else "a" if letter == "u" else "u"
                out.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[letter]}:{text}")
        digest = sha256("\n".join(out).encode()).hexdigest()
        counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
        found[conv_id] = (gaps, *counts, illegal, cost, audit, digest)
    return found


def by_id(df):
    rows = [tuple(row) for row in df.collect()]
    assert len({row[0] for row in rows}) == len(rows)
    return {row[0]: row[1:] for row in rows}


def test_query(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [(row.conv_id, row.turn, row.role, row.text) for row in table.collect()]
    assert by_id(queries.op12_conversation_repair(spark, folder)) == expected(rows)


SCHEMA = "conv_id long, turn long, role string, text string, place string, audit string"
ODD = [
    (1, 0, "user", "a question?"),
    (1, 1, "assistant", "an answer."),
    (1, 1, "assistant", "an answer."),
    (1, 5, "user", "an end"),
    (2, None, "system", "no turn."),
    (2, None, None, "no role."),
    (2, 3, "tool", None),
    (3, None, "user", None),
    (4, 0, "", "."),
    (4, 1, "user", " \n\t"),
    (None, 0, "user", "no id."),
    (None, 1, "assistant", "no id."),
    (5, 7, "user", "word " * 50_000 + "."),
    (6, 2, "user", "tie b."),
    (6, 2, "user", "tie a."),
    (7, -3, "assistant", "é漢😀!"),
]


def test_odd_rows(spark):
    rows = [(*row, "x", "y") for row in ODD]
    table = spark.createDataFrame(rows, SCHEMA)
    assert by_id(conv.repair_conversations(conv.damage(table), table)) == expected(ODD)


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conv.repair_conversations(conv.damage(table), table).count() == 0


def test_one_long_conversation_in_many_stretches(spark):
    rows = [(1, k, "uas"[k % 7 % 3] + "x", f"text {k % 150}{'.' * (k % 4 > 0)}") for k in range(3000)]
    rows += [(k, 0, "user", "short.") for k in range(2, 40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spread = conv.damage(table)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert conv._placed(spread).select(F.shiftright("place", 33).alias("stretch")).distinct().count() > 1
        assert by_id(conv.repair_conversations(spread, table)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_legal(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    found = {}
    for row in conv.repaired_turns(conv.damage(table)).orderBy("conv_id", "place").collect():
        found[row.conv_id] = found.get(row.conv_id, "") + row.role[:1]
    assert found and all(re.fullmatch("s?(ua)+", roles) for roles in found.values())


def test_costs_of_edits():
    assert [conv.turn_cell(*turn).get((0, 2)) for turn in product("ux", (conv.WHOLE, conv.CUT, conv.GONE))] == [
        (0, "K"),
        (3, "K"),
        (7, "DI"),
        (3, "R"),
        (6, "R"),
        (7, "DI"),
    ]
