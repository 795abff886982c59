"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and repeated five-word windows.  The method compares two
histograms of a document with those of its language by Jensen-Shannon distance (root of the divergence to
base 2, from 0 to 1): characters by class, and words by a fixed list of common words of the language with one
bin for all others.  The references are the summed histograms of all documents of the language that pass the
base rules.  A document without language, or of a language without reference, is held against the nearest
reference.  Short documents have rough histograms, so each comparison has a least length below which it is
not made.

Everything is a column expression.  Windows are compared by 64-bit hashes within one document; sorting them
keeps the work near linear in the text.

* null or empty text: all counts 0, base rules fail (fewer than ten words), not kept.
* null lang: nearest reference.  No reference at all (no labelled document passes): only base rules decide.
* null doc_id and repeated rows: each row is judged by itself.  An empty table gives an empty result.
* other columns are neither read nor needed, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Common words, in order of language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words})

#: Character classes, each as what a Java pattern matches.
CLASSES = (
    r"[a-z]",
    r"[A-Z]",
    r"[0-9]",
    r"[\x20]",
    r"[\x09-\x0D]",
    r"[.,;:!?'\"()-]",
    r"[#*$%&|<>]",
    r"[^\x00-\x7F]",
)

SPACES = r"[\x20\x09-\x0D]+"
LEAST_CHARS = 200
LEAST_WORDS = 100
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.45


def _once(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""

    def covered(starts: Column) -> Column:
        # Starts ascend; a window adds the words that reach beyond the one before it.
        added = F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-5).alias("last")),
            lambda acc, s: F.struct(
                (acc["sum"] + F.least(F.lit(5), s - acc["last"])).alias("sum"), s.alias("last")
            ),
        )
        return added["sum"]

    def starts(pairs: Column) -> Column:
        # Sorted (hash, start): a window is repeated if a neighbour has its hash.
        same = F.filter(
            F.transform(
                pairs,
                lambda p, i: F.when(
                    F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))
                    | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)),
                    p["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.sort_array(same)

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 5),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]),
        )

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), _once(_once(pairs, starts), covered)
        ).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) >= 6, _once(_once(words, windows), counted)).otherwise(F.lit(0).cast("long"))


def _counts(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of each document."""
    rows = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    known = F.array(*[F.lit(w) for w in COMMON_WORDS])
    places = F.filter(
        F.transform("words", lambda w: F.array_position(known, F.lower(w))), lambda place: place > 0
    )
    rows = rows.withColumns({"lines": lines, "places": places})
    found = F.size("places")
    bins = [found - F.size(F.array_remove("places", F.lit(i + 1).cast("long"))) for i in range(len(COMMON_WORDS))]
    classes = [F.length("text") - F.length(F.regexp_replace("text", f"{c}+", "")) for c in CLASSES]
    return rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(F.length("text"), *classes).alias("chars"),
        F.array(F.size("words"), *bins).alias("common"),
    ).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def _distance(document: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of a total and its parts."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def share(bins: Column) -> Column:
        total = F.get(bins, F.lit(0)).cast("double")
        return F.transform(F.slice(bins, 2, 1 << 20), lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0)))

    def rest(shares: Column) -> Column:
        left = F.aggregate(shares, F.lit(1.0), lambda acc, x: acc - x)
        return F.concat(shares, F.array(F.greatest(left, F.lit(0.0))))

    def whole(bins: Column) -> Column:
        return _once(share(bins), rest)

    terms = F.zip_with(whole(document), whole(reference), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))


def references(counts: DataFrame) -> DataFrame:
    """Summed histograms of the documents that pass the base rules: one row per language."""

    def summed(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(i)).cast("long")) for i in range(n)]).alias(f"ref_{name}")

    good = counts.where(~F.col("base_failed") & F.col("lang").isNotNull())
    return good.groupBy(F.col("lang").alias("ref_lang")).agg(
        summed("chars", len(CLASSES) + 1), summed("common", len(COMMON_WORDS) + 1)
    )


def quality(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_words: int = LEAST_WORDS,
    most_char_distance: float = MOST_CHAR_DISTANCE,
    most_word_distance: float = MOST_WORD_DISTANCE,
) -> DataFrame:
    """Per row: counts, base_failed, char_distance, word_distance (null where not compared), kept.

    Languages are few (labels of a training table), so their references travel to the documents as one
    array of a row per language.
    """
    counts = stored(_counts(docs), "quality-counts")
    found = references(counts).agg(
        F.collect_list(F.struct("ref_lang", "ref_chars", "ref_common")).alias("refs")
    )
    rows = counts.withColumn("one", F.lit(1)).join(F.broadcast(found.withColumn("one", F.lit(1))), "one", "left")
    own = F.filter("refs", lambda r: r["ref_lang"] == F.col("lang"))
    rows = rows.withColumn("against", F.when(F.size(own) > 0, own).otherwise(F.col("refs")))

    def nearest(name: str) -> Column:
        return F.array_min(F.transform("against", lambda r: _distance(F.col(name), r[f"ref_{name}"])))

    long_enough = F.get("chars", F.lit(0)) >= least_chars
    enough_words = F.col("n_words") >= least_words
    rows = rows.withColumns(
        {
            "char_distance": F.when(long_enough, nearest("chars")),
            "word_distance": F.when(enough_words, nearest("common")),
        }
    )
    far = (F.col("char_distance") > most_char_distance) | (F.col("word_distance") > most_word_distance)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "char_distance",
        "word_distance",
    )
