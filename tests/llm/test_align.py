from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoplens.llm import align, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ENTRIES = {number: entry for entry, number in A.get_vocab().items()}
ALPHABET = align._byte_alphabet()


def bytes_a(number):
    return bytes(ALPHABET[c] for c in ENTRIES[number])


def bytes_b(number):
    piece = B.id_to_piece(number)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()


def tokens(text):
    """Ids of both sides by the libraries over the whole text; none where the bytes differ."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    same = b"".join(map(bytes_a, a)) == raw and b"".join(map(bytes_b, b)) == raw
    return (a, b) if same else ([], [])


def ends(ids, width):
    at, found = 0, []
    for number in ids:
        at += len(width(number))
        found.append(at)
    return found


def links(a, b):
    ends_a, ends_b = ends(a, bytes_a), ends(b, bytes_b)
    by_end = dict(zip(ends_b, b))
    return [(number, by_end[end]) for number, end in zip(a, ends_a) if end in by_end]


def groups(a, b):
    ends_a, ends_b = ends(a, bytes_a), ends(b, bytes_b)
    cuts = sorted(set(ends_a) & set(ends_b))
    found = [([], []) for _ in cuts]
    for side, ids, at in ((0, a, ends_a), (1, b, ends_b)):
        for number, end in zip(ids, at):
            found[bisect_left(cuts, end)][side].append(str(number))
    return ";".join("|".join(",".join(side) for side in group) for group in found)


def expected(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, from the definition."""
    all_tokens = [tokens(text) for text in texts]
    all_links = [links(*of) for of in all_tokens]
    counts = Counter(link for of in all_links for link in of)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [
        (len(a), len(b), len(of), len(of), sum(counts[x] == highest[x[1]] for x in of), sum(counts[x] for x in of), groups(a, b))
        for (a, b), of in zip(all_tokens, all_links)
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
TEXTS = [
    "the cat sat on the mat, and the cat slept.",
    "the cat sat on the mat, and the cat slept.",
    "  two  spaces\n\n and breaks \n \t tabs\r\nends here \n",
    "naïve café 漢字 😀 ١٢ é İΣ",
    "a ▁ sign of the piece model",
    "<|endoftext|> <s></s><unk> <0x41>",
    "ﬁ á  no-break",
    "nul\0byte \x1c and \x85 others",
    "\n",
    " ",
    "",
    None,
    "x" * 3000,
    "don't we'll they've 1234567 $%&",
]


def rows_of(found):
    return sorted(tuple(row[c] for c in COLUMNS) for row in found.collect())


#: Sizes that make several spills, blocks and rounds of merging.
SMALL = align.Sizes(spill_documents=2, fan_in=2, block_pairs=3)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r  \x1c abcDE.'s,12é́漢▁<|>-"), max_size=40))
def test_words_make_the_whole_text(text):
    aligner = align._aligner(align.A_PATH, align.B_PATH)
    (n_a, n_b, found, keys) = next(aligner.documents([text]))
    a, b = tokens(text)
    assert (n_a, n_b, found) == (len(a), len(b), groups(a, b))
    assert [aligner.ids(int(key)) for key in keys] == links(a, b)


def test_against_definition(make):
    docs = make(*[(k, text, "en", "a") for k, text in enumerate(TEXTS)], extra=("row", "groups", "spill"))
    assert rows_of(align.align_tokens(docs)) == sorted(expected(TEXTS))


def test_spills_and_rounds_change_nothing(make, documents):
    texts = [row.text for row in documents.select("text").collect()]
    docs = documents.repartition(5)
    assert rows_of(align.align_tokens(docs, keep=["doc_id"])) == sorted(expected(texts))


def test_runs_are_merged_in_rounds(make):
    texts = TEXTS * 3
    docs = make(*[(k, text, "en", "a") for k, text in enumerate(texts)]).repartition(4)
    encoded = align._encoded(docs, "text", [], (align.A_PATH, align.B_PATH), True, SMALL)
    assert encoded.where("radix is not null").select("run").distinct().count() > 4  # over two rounds at a fan-in of 2
    assert rows_of(align.align_tokens(docs, sizes=SMALL)) == sorted(expected(texts))


def test_pair_counts(make):
    found = align.pair_counts(make(*[(k, text, "en", "a") for k, text in enumerate(TEXTS)]))
    counts = Counter(link for text in TEXTS for link in links(*tokens(text)))
    assert {(row.a, row.b): row.n for row in found.collect()} == dict(counts)


def test_odd_documents(odd, empty):
    rows = align.align_tokens(odd).collect()
    texts = [row.row.text for row in rows]
    assert sorted(tuple(row[c] for c in COLUMNS) for row in rows) == sorted(expected(texts))
    assert align.align_tokens(empty).count() == 0


def test_query(spark, folder, documents):
    found = {row.doc_id: row for row in queries.op13_align(spark, folder).collect()}
    rows = documents.select("doc_id", "text").collect()
    for row, wanted in zip(rows, expected([row.text for row in rows])):
        got = found[row.doc_id]
        assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.n_best, got.count_sum) == wanted[:-1]
        assert got.groups_sha256 == (sha256(wanted[-1].encode()).hexdigest() if wanted[-1] else "")
    assert len(found) == len(rows)
