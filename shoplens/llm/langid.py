"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A word is scored under a language
by the forward algorithm: the sum, over all ways to cut it into pieces, of the product of their probabilities.
A text's score is the product over its words, and languages are compared with equal priors.  The probabilities
are fitted by expectation maximisation over the same segmentations: each round is a Spark job that distributes
the counts of words over pieces with forward and backward sums and adds them up by language and piece.

Fitting reads a sample of labelled rows, of ``train_documents`` per language in expectation, drawn by a hash of
doc_id.  The model has a row per piece and a column per language, so its size is bounded by the vocabulary.
Words are runs of letters, in lower case; a single letter without piece stands for one unknown piece.

* null text or text without letters: language ``und``, score 0.
* null lang: not used for fitting.  null doc_id: hashed as empty text, so such rows are used for fitting.
* no labelled rows at all: every document is ``und`` with score 0.
* languages that score alike: the first by code point.  Repeated rows get equal results.
* words of more than LONGEST_TRAINED_WORD letters are scored with rescaled sums, in linear time, and not fitted on.
* other columns are neither read nor needed.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, held, map_batches, packed, stored

UNKNOWN_LANGUAGE = "und"
VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCUMENTS = 2000
ROUNDS = 3
LONGEST_PIECE = 16
LONGEST_TRAINED_WORD = 40
REMEMBERED_WORDS = 200_000
SMOOTHING = 0.05
SCALE = 1000.0

_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


class Pieces:
    """Lower-case letter pieces of a public vocabulary; the last number stands for an unknown letter."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
        usable = {p for p in found if p == p.lower() and regex.fullmatch(r"▁?\p{L}+|▁", p) and len(p) <= LONGEST_PIECE}
        self.number = {p: i for i, p in enumerate(sorted(usable))}
        self.unknown = len(self.number)
        self.size = self.unknown + 1
        #: All ends of pieces; one that is no piece itself is -1.  A longer end cannot be known if a shorter is not.
        self.ending = {p[k:]: -1 for p in usable for k in range(len(p))} | self.number
        self.scale = np.array([[SCALE ** len(p)] for p in sorted(usable)] + [[SCALE]])

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of all pieces in a word, with its start marked."""
        text, number, found = f"▁{word}", self.number, []
        for i in range(len(text)):
            known = number.get(text[i])
            found.append((i, i + 1, self.unknown if known is None else known))
            for j in range(i + 2, min(i + LONGEST_PIECE, len(text)) + 1):
                piece = number.get(text[i:j])
                if piece is not None:
                    found.append((i, j, piece))
        return found


    def trie(self, words: list[str]) -> tuple[list[np.ndarray], int, list[int]]:
        """Words as a trie: its edges by depth (from, to, piece), its size, and the node of each word.

        Sorted words are the depth-first order, so a prefix that words share is one path.
        """
        ending, unknown, depths = self.ending, self.unknown, []
        path, nodes, before, found = [0], 0, "", {}
        for word in sorted(words):
            text, shared = f"▁{word}", 0
            for a, b in zip(before, text):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                nodes += 1
                path.append(nodes)
                if end > len(depths):
                    depths.append([])
                edges = depths[end - 1]
                piece = ending.get(text[end - 1])
                edges += (path[end - 1], nodes, unknown if piece is None or piece < 0 else piece)
                if piece is not None:
                    for start in range(end - 2, max(-1, end - LONGEST_PIECE - 1), -1):
                        piece = ending.get(text[start:end])
                        if piece is None:
                            break
                        if piece >= 0:
                            edges += (path[start], nodes, piece)
            before = text
            found[word] = path[len(text)]
        return [np.array(e, dtype=np.int64).reshape(-1, 3) for e in depths], nodes + 1, [found[w] for w in words]


def _batch_edges(pieces: Pieces, words: list[str]) -> np.ndarray:
    rows = [(w, i, j, p) for w, word in enumerate(words) for i, j, p in pieces.edges(word)]
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def _sums(edges: np.ndarray, starts: int, ends: int, n: int, length: int, first: np.ndarray, model: np.ndarray, ascending: bool):
    """Sums over all paths from the first place; ``starts`` and ``ends`` are the columns of an edge's two ends."""
    sums = np.zeros((n, length + 1, model.shape[1]))
    sums[np.arange(n), first] = 1.0
    order = np.lexsort((edges[:, 0], edges[:, ends]))
    edges = edges[order]
    places = np.searchsorted(edges[:, ends], np.arange(length + 2))
    for place in range(1, length + 1) if ascending else range(length - 1, -1, -1):
        part = edges[places[place] : places[place + 1]]
        if len(part):
            value = sums[part[:, 0], part[:, starts]] * model[part[:, 3]]
            heads = np.flatnonzero(np.diff(part[:, 0], prepend=-1))
            sums[part[heads, 0], place] += np.add.reduceat(value, heads, axis=0)
    return sums


def forward(pieces: Pieces, words: list[str], model: np.ndarray) -> np.ndarray:
    """Log probability of each word (a row) under each language (a column)."""
    out = np.zeros((len(words), model.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONGEST_TRAINED_WORD]
    if short:
        chosen = [words[k] for k in short]
        depths, nodes, ends = pieces.trie(chosen)
        # Every path to a node covers the same letters, so a factor per letter keeps the sums in range.
        scaled = model * pieces.scale
        sums = np.ones((nodes, model.shape[1]))
        for edges in depths:
            before, node, piece = edges.T
            heads = np.flatnonzero(np.diff(node, prepend=-1))
            sums[node[heads]] = np.add.reduceat(sums[before] * scaled[piece], heads, axis=0)
        lengths = np.array([len(w) + 1 for w in chosen])
        out[short] = np.log(sums[ends]) - np.log(SCALE) * lengths[:, None]
    for k, word in enumerate(words):
        if len(word) > LONGEST_TRAINED_WORD:
            out[k] = _forward_long(pieces, word, model)
    return out


def _forward_long(pieces: Pieces, word: str, model: np.ndarray) -> np.ndarray:
    """The same sum with a window of places that is rescaled as it moves."""
    text, number = f"▁{word}", pieces.number
    recent: list[np.ndarray] = [np.ones(model.shape[1])]
    scale = np.zeros(model.shape[1])
    for j in range(1, len(text) + 1):
        known = number.get(text[j - 1])
        total = recent[-1] * model[pieces.unknown if known is None else known]
        for back in range(2, min(LONGEST_PIECE, j) + 1):
            piece = number.get(text[j - back : j])
            if piece is not None:
                total = total + recent[-back] * model[piece]
        recent.append(total)
        if len(recent) > LONGEST_PIECE:
            recent.pop(0)
        if j % LONGEST_PIECE == 0:
            top = recent[-1]
            recent = [r / top for r in recent]
            scale += np.log(top)
    return scale + np.log(recent[-1])


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over ``counts`` copies of the words, under one language."""
    edges = _batch_edges(pieces, words)
    n, ends = len(words), np.array([len(w) + 1 for w in words])
    length, column = int(ends.max()), model.reshape(-1, 1) * pieces.scale
    ahead = _sums(edges, 1, 2, n, length, np.zeros(n, np.int64), column, True)[:, :, 0]
    behind = _sums(edges, 2, 1, n, length, ends, column, False)[:, :, 0]
    word, start, end, piece = edges.T
    uses = ahead[word, start] * column[piece, 0] * behind[word, end] / ahead[np.arange(n), ends][word] * counts[word]
    return np.bincount(piece, weights=uses, minlength=pieces.size)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of fitting: a quarter, by checksum of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text) if len(w) <= LONGEST_TRAINED_WORD)
        if counts:
            langs, words = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "word", "n"],
            )


def _expecting(path: str, langs: list[str], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(("pieces", path), lambda: Pieces(path))
        total = np.zeros((pieces.size, len(langs)))
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by_lang.setdefault(lang, []).append((word, n))
            for lang, rows in by_lang.items():
                words, counts = zip(*rows)
                column = langs.index(lang)
                total[:, column] += expected(pieces, list(words), np.array(counts, float), model[:, column])
        piece, column = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(column), pa.array(total[piece, column])], names=["piece", "lang", "uses"]
        )

    return run


def fit(
    docs: DataFrame,
    train_documents: int = TRAIN_DOCUMENTS,
    rounds: int = ROUNDS,
    path: str | None = None,
) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and the probability of each piece (a row) under each of them (a column)."""
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = Pieces(path)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    rows = labelled.groupBy("lang").count().collect()  # one row per language
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return [], np.zeros((pieces.size, 0))
    share = {r["lang"]: min(1.0, train_documents / r["count"]) for r in rows}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = labelled.where(draw < limit).select("text", "lang")
    counted = map_batches(sample, _counted, "lang string, word string, n long")
    words = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    model = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    for _ in range(rounds):
        spread = words.repartition("word")
        uses = map_batches(spread, _expecting(path, langs, model), "piece long, lang long, uses double")
        total = np.full_like(model, SMOOTHING)
        for r in uses.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).collect():  # bounded by the model
            total[r["piece"], r["lang"]] += r["uses"]
        model = total / total.sum(axis=0)
    return langs, model


def scorer(path: str, langs: list[str], model: np.ndarray) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    """A function from texts to languages and scores, which remembers words it has seen."""
    pieces = Pieces(path)
    places: dict[str, int] = {}
    known = np.zeros((0, len(langs)))

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        nonlocal known
        found = [words_of(text) for text in texts]
        new = {w for words in found for w in words if w not in places}
        if len(places) + len(new) > REMEMBERED_WORDS:
            places.clear()
            known = np.zeros((0, len(langs)))
            new = {w for words in found for w in words}
        if new:
            fresh = sorted(new)
            for k in range(0, len(fresh), 4096):
                part = fresh[k : k + 4096]
                places.update(zip(part, range(len(places), len(places) + len(part))))
                known = np.concatenate([known, forward(pieces, part, model)])
        picked, scores = [], []
        for words in found:
            if not words or not langs:
                picked.append(UNKNOWN_LANGUAGE)
                scores.append(0.0)
                continue
            total = known[np.fromiter(map(places.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            picked.append(langs[best])
            scores.append(float(1.0 / math.fsum(np.exp(np.maximum(total - total[best], -700.0)))))
        return picked, scores

    return score


def _scorer(path: str, langs: list[str], model: np.ndarray) -> Callable:
    """The scorer of this worker for a model; words stay remembered from task to task."""
    return held(("langid", path, tuple(langs), hash(model.tobytes())), lambda: scorer(path, langs, model))


def predicted(docs: DataFrame, langs: list[str], model: np.ndarray, path: str | None = None) -> Column:
    """A column of lang_pred and score over ``text``; it sees nothing but the text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _scorer(path, langs, model)
        for texts in batches:
            picked, scores = score(texts.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(picked, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
            )

    return arrow_column(docs.sparkSession, predict, "struct<lang_pred:string,score:double>")(F.col("text"))


def identify(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    langs, model = fit(docs, train_documents)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(docs, langs, model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_language(docs: DataFrame, least_score: float = 0.5, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` whose language can be told; the rest are rejected.  Columns stay as they are."""
    langs, model = fit(docs, train_documents)
    rows = docs.select(packed(docs).alias("row")).select("row", F.col("row.text").alias("text"))
    rows = rows.withColumn("p", predicted(docs, langs, model))
    return rows.where(F.col("p.lang_pred") != UNKNOWN_LANGUAGE).where(F.col("p.score") >= least_score).select("row.*")
