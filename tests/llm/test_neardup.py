import random

import numpy as np
import pytest

from shoplens.llm import neardup as nd
from shoplens.llm.components import components


def sets_of(rows, size):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        out[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    return out


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in ids}


def found(docs, **options):
    rows = nd.near_duplicates(docs, **options).collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_table(documents, size, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, size=size, percent=percent) == brute(rows, size, percent)


def copies(n, words=60, edits=14, seed=1):
    """A group of near copies, some linked and some not, and bystanders."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(500)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(pick.randrange(edits)):
            text[pick.randrange(words)] = f"x{pick.randrange(10**6)}"
        rows.append((1000 - i, " ".join(text)))
    return rows + [(2000 + i, " ".join(f"y{pick.randrange(10**6)}" for _ in range(40))) for i in range(20)]


@pytest.mark.parametrize("small", [2, 10_000])
def test_groups_of_near_copies_lose_no_link(make, monkeypatch, small):
    rows = copies(120)
    monkeypatch.setattr(nd, "SMALL_BAND", small)
    monkeypatch.setattr(nd, "BLOCK", 50)
    docs = make(*[(d, t, "en", "a") for d, t in rows])
    expected = brute(rows, 3, 85)
    assert len({c for _, c in expected.values()}) > 25
    assert found(docs, size=3, percent=85) == expected


def test_block_links_are_all_links():
    rows = copies(80)
    vertices = np.array([d for d, _ in rows])
    links = nd.block_links(vertices, [nd.shingles(t, 3) for _, t in rows], 85)
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {d: root(d) for d in parent} == {d: c for d, (_, c) in brute(rows, 3, 85).items()}


def test_exact_limit(make):
    # 17 of 20 shingles in common, and 16 of 19.
    text = lambda n, tail: " ".join([f"w{i}" for i in range(n)] + tail)
    a, b = text(19, ["a1", "a2"]), text(19, ["b1"])
    rows = [(1, a), (2, b), (3, text(18, ["c1", "c2"]).replace("w0", "v0")), (4, text(18, ["d1"]).replace("w0", "v0"))]
    assert found(make(*[(d, t, "en", "a") for d, t in rows]), size=3, percent=85) == brute(rows, 3, 85)


def test_estimate_is_close(documents):
    functions = nd._functions(160)
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64))
    b = a.copy()
    b[:400] = np.random.default_rng(2).integers(0, 1 << 63, 400).astype(np.uint64)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = (nd.bit_planes(nd.minima_of(s, functions)).reshape(nd.BITS, -1) for s in (a, b))
    unequal = sum(int(v).bit_count() for v in np.bitwise_or.reduce(x ^ y).view(np.uint64))
    estimate = (1 - unequal / 160 - 2.0**-nd.BITS) / (1 - 2.0**-nd.BITS)
    assert abs(estimate - exact) < 0.15


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    random.Random(1).shuffle(path)
    rows = components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()
    assert {r["vertex"]: r["component"] for r in rows} == {**{i: 0 for i in range(1, 61)}, **{100 + k: 100 for k in range(1, 50)}}


def test_rows_that_share_an_id_are_one_vertex(make):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = make((5, one, "en", "a"), (5, two, "en", "a"), (3, one, "en", "a"), (4, two, "en", "a"))
    rows = nd.near_duplicates(docs).collect()
    assert {r["component_id"] for r in rows} == {3} and len(rows) == 4


def test_odd_rows(odd, empty):
    rows = nd.near_duplicates(odd, size=3, percent=85).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["component_id"] == 6 and not by[7]["kept"]
    assert by[1]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"]
    kept = nd.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "None", "None"])
    assert nd.near_duplicates(empty).count() == 0
