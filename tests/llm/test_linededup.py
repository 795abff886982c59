import random
import re

from shoplens.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """Texts by doc_id, in the order of ids: runs as the shortest ones that begin or end at each line."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        words = [len(WORD.findall(line)) for line in lines]
        spans = set()
        for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
            for i in order:
                total = 0
                for j in order[order.index(i) :]:
                    total += words[j]
                    if total >= least:
                        spans.add((min(i, j), max(i, j) + 1))
                        break
        gone = set()
        for start, stop in sorted(spans):
            key = tuple(lines[start:stop])
            if key in seen:
                gone.update(range(start, stop))
            seen.add(key)
        out[doc] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def done(docs, **options):
    rows = linededup.dedup_lines(docs, **options).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    return {r["doc_id"]: r for r in rows}


def test_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for least in (5, 30):
        expected = brute(rows, least)
        assert {d: r["text"] for d, r in done(documents, least_words=least).items()} == expected


def test_runs_grow_both_ways_and_the_first_stays(make):
    run = "one two three\nfour five\nsix seven eight"
    docs = make(
        (1, f"start a\n{run}\nend a", "en", "a"),
        (2, f"{run}\nother", "en", "a"),
        (3, f"x\nfour five\ny\n{run}", "en", "a"),
    )
    found = done(docs, least_words=5)
    assert found[1]["n_removed"] == 0
    assert found[2]["text"] == "other"
    assert found[3]["text"] == "x\nfour five\ny"


def test_a_run_in_another_neighbourhood_is_found(make):
    # The earliest place of each single line has other neighbours than the run.
    docs = make(
        (1, "a a a\nx x x\nb b b\ny y y\nc c c", "en", "a"),
        (2, "a a a\nb b b\nc c c", "en", "a"),
        (3, "q\na a a\nb b b\nc c c", "en", "a"),
    )
    found = done(docs, least_words=9)
    assert found[2]["n_removed"] == 0
    assert found[3]["text"] == "q"


def test_periodic_text_keeps_its_first_period(make):
    docs = make((1, "\n".join(["a a a", "b b b"] * 4), "en", "a"))
    assert done(docs, least_words=6)[1]["text"] == "a a a\nb b b"


def brute_runs(rows, least):
    """Texts by doc_id, from the definition: every run of enough words that occurs earlier goes."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        words = [len(WORD.findall(line)) for line in lines]
        gone = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(words[i : j + 1]) >= least:
                    key = tuple(lines[i : j + 1])
                    if key in seen:
                        gone.update(range(i, j + 1))
                    seen.add(key)
        out[doc] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def test_the_tail_of_a_whole_run_goes(make):
    long, short = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("a", 40), ("b", 20)))
    docs = make((1, f"x\n{long}\n{short}\ny", "en", "a"), (2, f"p\n{long}\n{short}\nq", "en", "a"))
    assert done(docs)[2]["text"] == "p\nq"
    assert done(docs)[1]["n_removed"] == 0


def test_whole_runs_against_brute_force(make):
    pick = random.Random(5)
    pool = ["a", "b b", "c c c", "d d", "", "e e e e e"]
    rows = [(k, "\n".join(pick.choice(pool) for _ in range(pick.randrange(1, 14)))) for k in range(120)]
    docs = make(*[(k, text, "en", "a") for k, text in rows])
    for least in (4, 9, 15):
        assert {d: r["text"] for d, r in done(docs, least_words=least).items()} == brute_runs(rows, least)


def test_whole_runs_of_the_table(documents):
    # Longer documents have too many runs to list them all.
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    short = [(d, text) for d, text in rows if text.count("\n") < 60]
    found = done(documents.where("len(text) - len(replace(text, '\n', '')) < 60"))
    assert {d: r["text"] for d, r in found.items()} == brute_runs(short, 30)


def test_documents_of_which_nothing_stays_are_left_out(make):
    text = " ".join(map(str, range(40)))
    kept = linededup.without_repeats(make((2, text, "en", "a"), (1, text, "en", "b"), (3, "", "en", "a")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_odd_rows(odd, empty):
    rows = linededup.dedup_lines(odd).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[2]["text"] == "" and by[4]["n_removed"] == 0
    assert linededup.without_repeats(odd).columns == odd.columns
    assert linededup.dedup_lines(empty).count() == 0


def test_texts_are_rewritten_once(make):
    text = " ".join(map(str, range(40)))
    kept = linededup.without_repeats(make((1, text, "en", "a"), (2, f"x\n{text}", "en", "b")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: text, 2: "x"}
