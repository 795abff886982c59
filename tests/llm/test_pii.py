import random
import re

from shoplens.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = (
                True,
                all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                13 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if fits:
                found.append((kind, *m.span()))
    return found


def test_base_spans_of_random_texts():
    pick = random.Random(2)
    parts = ["a", "b.c", "@", "d.e", "@x.", ".", "-", " ", "+1", "(", ")", "12", "4111111111111111", "255", "256", "0", "é", "\n", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_base_spans_of_the_table(documents):
    for r in documents.select("text").collect():
        assert pii.base_spans(r["text"]) == brute(r["text"])


def test_hostile_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "a.@" * 100_000, "1." * 150_000, "+1" + " " * 300_000, "+1 " * 100_000, "a@b" * 100_000):
        pii.base_spans(text)
        list(pii.identifiers(text, []))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_contexts_of_seeds_find_unseen_identifiers(make):
    rows = [(i, f"reach me at user{i}@mail.example.com today\nplain words only", "en", "a") for i in range(8)]
    rows += [(20 + i, f"the card no. 411111111111111{d} on file", "en", "a") for i, d in enumerate("1") for _ in range(1)]
    good = [c for c in range(10**6, 10**6 + 900) if luhn(f"411111111{c}")]
    rows += [(30 + i, f"the card no. 411111111{c} on file", "en", "a") for i, c in enumerate(good[:6])]
    rows += [(50, "the card no. 4111111111111112 on file", "en", "a"), (51, "in the year 2024 there were 1999 of them", "en", "a")]
    found = by_id(pii.personal_data(make(*rows)))
    start = rows[-2][1].index("4111")
    assert found[50]["n_card"] == 0
    assert found[50]["spans"] == f"id:{start}:{start + 16}"
    assert found[51]["spans"] == ""
    assert all(found[i]["spans"] == found[i]["base"] != "" for i in range(8))


SEEDED = [(i, f"ask holder of record user{i}@mail.example.com before closing it", "en", "a") for i in range(6)]


def span_of(token, text):
    start = text.index(token)
    return f"id:{start}:{start + len(token)}"


def test_a_shape_that_no_seed_has_is_found_by_the_words_around_it(make):
    tokens = ("078-05-1120", "04dbebab91ab85687d33", "AC/5521/77", "83920174")
    rows = [(20 + i, f"ask holder of record {t} before closing it", "en", "a") for i, t in enumerate(tokens)]
    rows += [(30, "holder of record: \"555-123-4567\" or some other end", "en", "a")]
    rows += [(40, "in the year 2024 there were 1999 of them", "en", "a")]
    found = by_id(pii.personal_data(make(*SEEDED, *rows)))
    for i, t in enumerate(tokens):
        assert found[20 + i]["spans"] == span_of(t, rows[i][1])
    assert found[30]["spans"] == span_of("555-123-4567", rows[4][1])
    assert found[40]["spans"] == ""


def test_found_instances_are_seeds_of_new_patterns(make):
    tokens = ("AC-1001-7", "AC-1002-7", "AC-1003-7", "AC-1004-7")
    rows = [(20 + i, f"ask holder of record {t} before closing it", "en", "a") for i, t in enumerate(tokens)]
    rows += [(30 + i, f"ledger entry named {t} was paid twice", "en", "a") for i, t in enumerate(tokens)]
    rows += [(40, "ledger entry named 99/8877 was paid twice", "en", "a")]
    docs = make(*SEEDED, *rows)
    assert by_id(pii.personal_data(docs))[40]["spans"] == span_of("99/8877", rows[-1][1])
    assert by_id(pii.personal_data(docs, rounds=1))[40]["spans"] == ""


def test_an_instance_found_in_few_of_its_contexts_is_no_seed(make):
    years = ("1995", "1996", "1997", "1998")
    rows = [(20 + i, f"ask holder of record {y} before closing it", "en", "a") for i, y in enumerate(years)]
    rows += [
        (100 + 10 * k + i, f"in {word} the year {y} it rained", "en", "a")
        for k, word in enumerate(("fact", "short", "total"))
        for i, y in enumerate(years)
    ]
    rows += [(300 + i, f"back at {w} {y} {w} again", "en", "a") for i, y in enumerate(years) for w in ("home", "sea")]
    rows += [(200, "in fact the year 2024 it rained", "en", "a")]
    found = by_id(pii.personal_data(make(*SEEDED, *rows)))
    assert found[20]["spans"] != ""
    assert found[200]["spans"] == ""


def test_identifiers_are_cut_out_of_text_without_spaces(make):
    def tokens(text):
        return [text[s:e] for s, e in pii.identifiers(text, pii.base_spans(text))]

    filler = "".join(f'"k{c}":"v",' for c in "abcdefghij" * 10)
    assert tokens("{" + filler + '"acct":"99887-766","ssn":"078-05-1120"}') == ["99887-766", "078-05-1120"]
    assert tokens("Smith,78-4471,2031/5,x;1234") == ["78-4471", "2031/5", "1234"]
    assert tokens("http://a.b/c?id=88112233&t=ab12cd34#x") == ["88112233", "ab12cd34#x"]
    assert tokens("电话：5551234567，账号99887766号") == ["5551234567", "99887766"]
    assert tokens("é😀[4471]") == ["4471"]
    long = "a1" * 5000
    assert tokens(f"x={long};") == [long]
    # What was one token before and has no piece of its own stays one.
    assert tokens("00:1B:44:11:3A:B7 1,234,567 (555)123-4567") == ["00:1B:44:11:3A:B7", "1,234,567", "555)123-4567"]

    rows = [(i, f'{{"n":{i},"holder":"user{i}@mail.example.com","open":true}}', "en", "a") for i in range(6)]
    rows += [(20, '{"n":7,"holder":"DE-4471-0093","open":true}' + "é" * 300, "en", "a")]
    found = by_id(pii.personal_data(make(*rows)))
    assert found[20]["spans"] == span_of("DE-4471-0093", rows[-1][1])


def test_long_lines_of_many_identifiers_take_linear_time():
    for text in ("1234," * 60_000, "1:" * 150_000, "1)" * 150_000, "12:34:" * 50_000, "1" * 300_000 + ":"):
        for s, e in list(pii.identifiers(text, [])):
            pii.patterns(text, s, e)


def brute_worth(edges, rounds, least):
    score = {e[:2]: 1.0 if e[2] else 0.0 for e in edges}
    for round_ in range(rounds):
        worth = {}
        for pattern in {p for p, _, _ in edges}:
            own = [(i, seed) for p, i, seed in edges if p == pattern]
            seeds = sum(seed for _, seed in own)
            worth[pattern] = sum(score[pattern, i] for i, _ in own) / (len(own) + 1) if seeds >= least else 0.0
        for pattern, instance, seed in edges:
            mine = [worth[p] for p, i, _ in edges if i == instance]
            score[pattern, instance] = 1.0 if seed else sum(mine) / len(mine)
    return worth


def test_scores_against_brute_force(spark):
    pick = random.Random(4)
    edges = {(f"p{pick.randrange(8)}", f"i{k}", k % 2 == 0) for k in range(40) for _ in range(3)}
    df = spark.createDataFrame(sorted(edges), "pattern string, instance string, seed boolean")
    found = {r["pattern"]: round(r["worth"], 9) for r in pii.scored_patterns(df, 3, 2).collect()}
    assert found == {p: round(w, 9) for p, w in brute_worth(sorted(edges), 3, 2).items()}


def test_spans_start_with_the_base(documents):
    for r in pii.personal_data(documents).collect():
        assert r["spans"].startswith(r["base"])
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [kinds.count(k) for k in pii.KINDS] == [r[f"n_{k}"] for k in pii.KINDS]


def test_odd_rows(odd, empty):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (1, 2, 3))
    assert pii.personal_data(empty).count() == 0
