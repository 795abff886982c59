import zlib
from collections import Counter

from shoplens.llm.shards import assign_shards


def assigned(docs, **options):
    return [r.asDict() for r in assign_shards(docs, **options).collect()]


def check(rows, shards=16):
    counts = Counter(r["shard"] for r in rows)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))


def test_every_shard_matches_the_mixture(documents):
    rows = assigned(documents)
    check(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents.select("doc_id").collect()}
    sources = Counter(r["source"] for r in rows)
    for shard in range(16):
        inside = Counter(r["source"] for r in rows if r["shard"] == shard)
        for source, n in sources.items():
            assert abs(inside[source] - n / 16) < 2


def test_sizes_and_checksums(documents):
    text = {r["doc_id"]: (r["text"] or "").encode() for r in documents.select("doc_id", "text").collect()}
    for r in assigned(documents):
        assert r["size"] == len(text[r["doc_id"]]) + 1
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]])


def test_many_cells_number_like_one(documents, monkeypatch):
    from shoplens.llm import shards

    one = sorted(map(str, assigned(documents)))
    monkeypatch.setattr(shards, "CELL", 7)
    assert sorted(map(str, assigned(documents.repartition(5)))) == one


def test_odd_rows(odd, empty):
    rows = assigned(odd)
    check(rows)
    assert len(rows) == odd.count()
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert assigned(empty) == []
