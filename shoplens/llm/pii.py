"""Personal data: fixed patterns, and bootstrapped contextual extraction beyond them.

Emails, addresses, card and phone numbers that match their patterns are the seeds.  The one or two words before and
after a seed make lexical patterns, whatever the seed looks like (its shape counts only where a line has no word
on that side); the same patterns around other identifier-like
tokens (four digits or more) tie those tokens to the seeds, so a token needs no shape that a seed has.  Spark scores
the graph of patterns and instances in rounds: a pattern is worth the mean score of its distinct instances, an
unknown instance the mean worth of its patterns, a seed always 1.  A pattern counts only with several distinct seeds.
An unknown instance that is found in half of its distinct contexts or more is a seed of the next round, so the
contexts it has besides become patterns too.  Tokens that enough patterns of high worth surround are reported as
further spans of the kind ``id``; base spans always stay.  A token whose contexts no seed of any round shares, such
as a secret that always follows the same words, is not found.

Texts are read once.  The graph holds only occurrences of identifiers, and is aggregated by pattern and instance, so
a pattern or an identifier that a third of all documents share is one row per task before it is shuffled.

* identifiers are cut out at white space and at quotes, brackets and ``, = : ; & ? ! |``, at the characters of scripts
  without spaces and at their punctuation, so minified JSON, CSV lines and URLs are read too.  Groups of hex digits
  between colons stay together.  Ends are code points, and a token may have any length.
* null and empty text: no spans.  Very long texts are read in linear time.
* null doc_id and repeated rows: rows equal in doc_id and text get equal results; each is kept.
* an empty table gives an empty result.  Other columns are neither read nor needed, and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_key, map_batches, stored

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
ROUNDS = 3
LEAST_SEEDS = 3
LEAST_WORTH = 0.5
LEAST_PATTERNS = 2
LEAST_DIGITS = 4
LONGEST_IDENTIFIER = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats match what the plain ones would, since what follows them cannot begin inside them.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=~^"
_SHAPE = re.compile(r"([0-9]+)|([^\W\d_]+)|(.)", re.S)
# Scripts written without spaces, and punctuation beyond ASCII.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WIDE = "\u00ab\u00bb\u2018-\u201f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_MARKS = r"\s\"'`,=:;&()\[\]{}<>" + _WIDE
_CUT = re.compile(rf"(?!(?<=[0-9])\)[0-9])[{_MARKS}?!|{_UNSPACED}]")
_SPACE = re.compile(r"\s")
_GROUPED = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}::?){2,}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_WORD = re.compile(f"[{_UNSPACED}]|[^{_MARKS}{_UNSPACED}]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part reaches back from an @ as far as it can, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind and start."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(int(part.lstrip("0")[:4] or 0) <= 255 for part in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def shape(identifier: str) -> str:
    """Runs of digits by length, letters as one sign, other characters as they are; a mixture by its length."""
    parts = _SHAPE.findall(identifier)
    if sum(bool(letters) for _, letters, _ in parts) > 2 and not any(other for *_, other in parts):
        return f"x{len(identifier)}"
    return "".join(f"9{len(d)}" if d else "a" if a else o for d, a, o in parts)


def _plain(text: str) -> list[str]:
    """Words in lower case, cut at quotes and brackets too; of the punctuation at their ends only what stands alone."""
    return [w.strip(_EDGE).lower() or w for w in _WORD.findall(text)]


def _neighbours(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two words before and the two after a span in its line, the nearest first; empty at the line's ends."""
    low, high = max(0, start - 80), min(len(text), end + 80)
    before = _plain(text[max(low, text.rfind("\n", low, start) + 1) : start])[:-3:-1]
    stop = text.find("\n", end, high)
    after = _plain(text[end : high if stop < 0 else stop])[:2]
    return before + [""] * (2 - len(before)), after + [""] * (2 - len(after))


def patterns(text: str, start: int, end: int) -> list[str]:
    """Words on either side; where a line has none, its end tells too little and the shape is added."""
    (near, far), (next_, later) = _neighbours(text, start, end)
    kind = "" if near and next_ else shape(text[start:end][:LONGEST_IDENTIFIER])
    before = [f"{near}\t*", f"{far} {near}\t*"] if near else [f"\t*\t\t{kind}"]
    after = [f"*\t{next_}", f"*\t{next_} {later}"] if next_ else [f"*\t\t{kind}"]
    return [*before, *after, f"{near}\t*\t{next_}" + ("" if near or next_ else f"\t\t\t{kind}")]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the punctuation at its ends."""
    token = text[start:end]
    return start + len(token) - len(token.lstrip(_EDGE)), end - (len(token) - len(token.rstrip(_EDGE)))


def _tokens(text: str, cut: re.Pattern, low: int, high: int) -> Iterator[tuple[int, int]]:
    """The stretches between two cuts that hold digits and lie between two places."""
    digits = _DIGITS.search(text, low, high)
    while digits:
        start, end = digits.span()
        while start > low and not cut.match(text, start - 1):
            start -= 1
        found = cut.search(text, end, high)
        low = end = found.start() if found else high
        yield start, end
        digits = _DIGITS.search(text, low, high)


def _pieces(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """The tokens of a stretch without white space; groups of hex digits between colons are one."""
    for m in _GROUPED.finditer(text, low, high):
        yield from _tokens(text, _CUT, low, m.start())
        yield m.span()
        low = m.end()
    yield from _tokens(text, _CUT, low, high)


def _n_digits(token: str) -> int:
    return sum(map(len, _DIGITS.findall(token)))


def identifiers(text: str, known: list[Span]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens outside the known spans, cut at white space and the punctuation between values.

    Where no piece has enough digits, the token between white space is taken whole if it is not too long.
    """
    taken = sorted((start, end) for _, start, end in known)
    k = 0
    for low, high in _tokens(text, _SPACE, 0, len(text)):
        if _n_digits(text[low:high]) < LEAST_DIGITS:
            continue
        pieces = [p for p in _pieces(text, low, high) if _n_digits(text[p[0] : p[1]]) >= LEAST_DIGITS]
        if not pieces and high - low <= LONGEST_IDENTIFIER:
            pieces = [(low, high)]
        for piece in pieces:
            start, end = _trimmed(text, *piece)
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            # Spans of different kinds may overlap, so the ones after the first are looked at as well.
            if not any(s < end and e > start for s, e in taken[k : k + 8]):
                yield start, end


def _instance(token: str) -> str:
    """What stands for a token in the graph: itself, or its hash if it is long."""
    return token if len(token) <= LONGEST_IDENTIFIER else hashlib.sha256(token.encode()).hexdigest()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


_SCANNED = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string,"
    " seen array<struct<start:int,stop:int,instance:string,seed:boolean,patterns:array<string>>>"
)
_SEEN = pa.list_(
    pa.struct(
        [
            ("start", pa.int32()),
            ("stop", pa.int32()),
            ("instance", pa.string()),
            ("seed", pa.bool_()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bases, seen = [], [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            spans = base_spans(text)
            counts.append([sum(k == kind for k, *_ in spans) for kind in range(len(KINDS))])
            bases.append(joined(spans))
            found = [(s, e, True) for _, s, e in spans] + [(s, e, False) for s, e in identifiers(text, spans)]
            seen.append(
                [
                    {
                        "start": s,
                        "stop": e,
                        "instance": _instance(text[s:e]),
                        "seed": seed,
                        "patterns": patterns(text, s, e),
                    }
                    for s, e, seed in found
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))],
                pa.array(bases, pa.string()),
                pa.array(seen, _SEEN),
            ],
            names=["doc_id", "text_key", *[f"n_{kind}" for kind in KINDS], "base", "seen"],
        )


def scored_patterns(
    edges: DataFrame,
    rounds: int = ROUNDS,
    least_seeds: int = LEAST_SEEDS,
    confident: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """pattern and worth, from edges of pattern, instance and seed; each pair occurs once.

    ``confident`` gives, from the worths of a round, the instances that count as seeds in the next one.
    """
    scores = edges.withColumn("score", F.col("seed").cast("double"))
    for round_ in range(rounds):
        worth = scores.groupBy("pattern").agg(
            F.when(F.sum(F.col("seed").cast("long")) >= least_seeds, F.sum("score") / (F.count("*") + 1))
            .otherwise(F.lit(0.0))
            .alias("worth")
        )
        worth = stored(worth, "pii-worth")
        if round_ + 1 == rounds:
            return worth
        known = edges.join(worth, "pattern")
        instances = known.groupBy("instance").agg(F.avg("worth").alias("mean"), F.max("seed").alias("sure"))
        if confident:
            more = confident(worth).select("instance", F.lit(True).alias("more"))
            instances = instances.join(more, "instance", "left")
            instances = instances.withColumn("sure", F.col("sure") | F.coalesce("more", F.lit(False)))
        scores = stored(
            edges.drop("seed").join(instances, "instance").select(
                "pattern",
                "instance",
                F.col("sure").alias("seed"),
                F.when(F.col("sure"), F.lit(1.0)).otherwise(F.col("mean")).alias("score"),
            ),
            "pii-scores",
        )
    raise ValueError("rounds must be 1 or more")


def found_instances(contexts: DataFrame, worth: DataFrame, least_worth: float, least_patterns: int) -> DataFrame:
    """Instances found in half of their distinct contexts or more, from contexts of instance and patterns."""
    good = worth.where(F.col("worth") >= least_worth).select("pattern")
    each = contexts.select("instance", F.xxhash64("patterns").alias("context"), F.explode("patterns").alias("pattern"))
    found = each.join(good, "pattern", "left_semi").groupBy("instance", "context").count()
    found = found.where(F.col("count") >= least_patterns).groupBy("instance").agg(F.count("*").alias("n_found"))
    all_ = contexts.groupBy("instance").agg(F.count("*").alias("n_contexts"))
    return found.join(all_, "instance").where("2 * n_found >= n_contexts").select("instance")


def personal_data(
    docs: DataFrame,
    rounds: int = ROUNDS,
    least_seeds: int = LEAST_SEEDS,
    least_worth: float = LEAST_WORTH,
    least_patterns: int = LEAST_PATTERNS,
) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base (spans of the base kinds) and spans (all)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("text_key"), "text")
    scanned = stored(map_batches(texts, _scan, _SCANNED), "pii-scanned")
    seen = scanned.select("doc_id", "text_key", F.explode("seen").alias("s")).select("doc_id", "text_key", "s.*")
    contexts = stored(seen.where("not seed").select("instance", "patterns").distinct(), "pii-contexts")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    worth = scored_patterns(
        edges, rounds, least_seeds, lambda known: found_instances(contexts, known, least_worth, least_patterns)
    )
    good = worth.where(F.col("worth") >= least_worth).select("pattern")
    unknown = seen.where("not seed").select("doc_id", "text_key", "start", "stop", F.explode("patterns").alias("pattern"))
    place = ["doc_id", "text_key", "start", "stop"]
    found = unknown.distinct().join(good, "pattern", "left_semi").groupBy(*place).count()
    found = found.where(F.col("count") >= least_patterns)
    further = found.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("found")
    )
    names = F.transform("found", lambda s: F.concat_ws(":", F.lit(FOUND), s["start"], s["stop"]))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>"))
    rows = scanned.drop("seen").join(
        further, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key")), "left"
    )
    spans = F.concat_ws(",", F.concat(base, F.coalesce(names, F.array().cast("array<string>"))))
    return rows.select("doc_id", *[f"n_{kind}" for kind in KINDS], "base", spans.alias("spans"))
