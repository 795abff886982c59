"""The queries of this package, by name, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, conversations, counts, langid, linededup, mix, neardup, pii, quality, shards, sketch, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix_plan(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.recounted(table(spark, folder, "documents"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, folder, "documents"))
    return done.select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign_shards(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compare_neighbours(table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).drop("char_distance", "word_distance")


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("row.doc_id", "held_out", "score", "predicted")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    table_ = table(spark, folder, "conversations")
    return conversations.repair_conversations(conversations.damage(table_), table_)


def op13_align(spark: SparkSession, folder: str) -> DataFrame:
    found = align.align_tokens(table(spark, folder, "documents"), keep=["doc_id"], digest=True)
    counts_of = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select("row.doc_id", *counts_of, F.col("groups").alias("groups_sha256"))


def queries() -> dict[str, Query]:
    found = [
        op1_mix_sources,
        op2_personal_data,
        op3_token_counts,
        op4_line_dedup,
        op5_shards,
        op6_bpe,
        op7_language,
        op8_near_duplicates,
        op9_fingerprints,
        op10_quality,
        op11_toxicity,
        op12_conversation_repair,
        op13_align,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op1_mix_sources": _MIX,
        "op4_line_dedup": _LINES,
        "op8_near_duplicates": _NEAR,
        "op10_quality": _QUALITY,
        "op12_conversation_repair": _REPAIR,
    }


_MIX = f"""
    WITH RECURSIVE draws AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
               (CAST('0x' || substr(md5('{mix.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
                + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
        FROM documents
    ),
    sizes AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM draws GROUP BY source),
    weighed AS (
        SELECT *, 2.0::DOUBLE * source_size AS cap,
               [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
        FROM sizes
    ),
    levels(step, level) AS (
        SELECT 0, 1.5::DOUBLE * sum(source_size) / sum(weight) FROM weighed
        UNION ALL
        SELECT step + 1, (
            SELECT (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN cap < weight * level THEN cap ELSE 0 END))
                   / nullif(sum(CASE WHEN cap < weight * level THEN 0 ELSE weight END), 0)
            FROM weighed)
        FROM levels WHERE step < (SELECT count(*) FROM weighed) AND level IS NOT NULL
    ),
    targets AS (
        SELECT source, n, source_size,
               least(cap, weight * coalesce((SELECT arg_max(coalesce(level, 'inf'::DOUBLE), step) FROM levels), 'inf'::DOUBLE)) AS target
        FROM weighed
    ),
    placed AS (
        SELECT d.*, n, source_size, target,
               CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
               target - whole * source_size AS rest,
               CASE WHEN source_size > 0 THEN sqrt(greatest(size, 1) / (source_size::DOUBLE / n)) ELSE 1 END AS lean,
               u / (u + lean * (1 - u)) AS y
        FROM draws d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ),
    summed AS (
        SELECT *, sum(size) OVER (PARTITION BY source ORDER BY y, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
        FROM placed
    ),
    missing AS (
        SELECT source, max(rest) - coalesce(max(upto) FILTER (upto <= rest AND rest > 0), 0) AS lack FROM summed GROUP BY source
    ),
    fill AS (
        SELECT s.source, arg_min(s.doc_id, (abs(size - lack), y, s.doc_id)) AS fill_id
        FROM summed s JOIN missing m ON s.source IS NOT DISTINCT FROM m.source
        WHERE rest > 0 AND upto > rest AND abs(size - lack) < lack GROUP BY s.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(size * (whole + CAST(rest > 0 AND upto <= rest OR coalesce(doc_id = fill_id, FALSE) AS INTEGER)) AS BIGINT) AS taken
    FROM summed s LEFT JOIN fill f ON s.source IS NOT DISTINCT FROM f.source
"""

_LINES = f"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ),
    line AS (
        SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos, lines[pos] AS line,
               len(regexp_extract_all(lines[pos], '[^\\x20\\x09-\\x0D]+')) AS words
        FROM docs
    ),
    summed AS (
        SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM line
    ),
    ends AS (
        SELECT a.doc_id, a.pos AS start, min(b.pos) AS stop
        FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos >= a.pos
             AND b.upto - a.upto + a.words >= {linededup.LEAST_WORDS}
        GROUP BY a.doc_id, a.pos
        UNION
        SELECT b.doc_id, max(a.pos), b.pos
        FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos >= a.pos
             AND b.upto - a.upto + a.words >= {linededup.LEAST_WORDS}
        GROUP BY b.doc_id, b.pos
    ),
    wins AS (
        SELECT e.*, array_to_string(list_slice(lines, start, stop), chr(10)) AS content
        FROM ends e JOIN docs USING (doc_id)
    ),
    later AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS nth FROM wins
        ) WHERE nth > 1
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM later)
    SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS text_sha256
    FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
    GROUP BY l.doc_id
"""

_NEAR = """
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(w) = 0 THEN []
                 WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
            END) AS s
        FROM docs
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ),
    links AS (
        SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * common >= 85 * (p.n + q.n - common)
    ),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(doc_id, other) AS (
        SELECT doc_id, doc_id FROM docs
        UNION
        SELECT reached.doc_id, sides.y FROM reached JOIN sides ON reached.other = sides.x
    )
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
    FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def _bins(name: str, parts: list[str]) -> str:
    return f"[{', '.join(parts)}] AS {name}"


_SHARE = "list_transform({0}, lambda n: CASE WHEN {1} > 0 THEN n / {1}::DOUBLE ELSE 0 END)"


def _distance(parts: str, total: str, ref: str, ref_total: str) -> str:
    def whole(bins: str, of: str) -> str:
        shares = _SHARE.format(bins, of)
        return f"list_append({shares}, greatest(1 - list_sum({shares}), 0))"

    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    both = f"({term.format('z[1]', 'z[2]')} + {term.format('z[2]', 'z[1]')}) / 2"
    return (
        f"sqrt(greatest(list_sum(list_transform(list_zip({whole(parts, total)}, {whole(ref, ref_total)}),"
        f" lambda z: {both})), 0))"
    )


def _quality_sql() -> str:
    def class_pattern(c: str) -> str:
        return c.replace("'", "''").replace(r"[^\x00-\x7F]", r"[^\x{00}-\x{7F}]")

    chars = _bins("chars", [f"len(text) - len(regexp_replace(text, '{class_pattern(c)}', '', 'g'))" for c in quality.CLASSES])
    common = _bins(
        "common", [f"len(list_filter(lowered, lambda w: w = '{w}'))" for w in quality.COMMON_WORDS]
    )
    n_chars, n_common = len(quality.CLASSES), len(quality.COMMON_WORDS)
    ref_chars = _bins("ref_chars", [f"sum(chars[{i + 1}])" for i in range(n_chars)])
    ref_common = _bins("ref_common", [f"sum(common[{i + 1}])" for i in range(n_common)])
    return f"""
    WITH docs AS (
        SELECT doc_id, lang, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM documents
    ),
    wins AS (
        SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)
    ),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM wins) WHERE n > 1),
    repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id),
    counts AS (
        SELECT doc_id, lang, text, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(n, 0) AS n_repeat_words, list_transform(words, lambda w: lower(w)) AS lowered,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
        FROM docs LEFT JOIN repeats USING (doc_id)
    ),
    hists AS (SELECT * EXCLUDE (text, lowered), len(text) AS n_chars, {chars}, {common} FROM counts),
    refs AS (
        SELECT lang AS ref_lang, sum(n_chars) AS all_chars, sum(n_words) AS all_words, {ref_chars}, {ref_common}
        FROM hists WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang
    ),
    far AS (
        SELECT doc_id, min({_distance("chars", "n_chars", "ref_chars", "all_chars")}) AS char_distance,
               min({_distance("common", "n_words", "ref_common", "all_words")}) AS word_distance
        FROM hists JOIN refs ON lang = ref_lang OR lang IS NULL OR lang NOT IN (SELECT ref_lang FROM refs)
        GROUP BY doc_id
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed
           AND NOT coalesce(n_chars >= {quality.LEAST_CHARS} AND char_distance > {quality.MOST_CHAR_DISTANCE}, FALSE)
           AND NOT coalesce(n_words >= {quality.LEAST_WORDS} AND word_distance > {quality.MOST_WORD_DISTANCE}, FALSE) AS kept
    FROM hists LEFT JOIN far USING (doc_id)
"""


_QUALITY = _quality_sql()


_REPAIR = f"""
    WITH RECURSIVE named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                              lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
        FROM conversations
    ),
    summed AS (
        SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, byte:
                   list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i:
                       CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind
        FROM named
    ),
    turns AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM summed WHERE kind <> 0
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM turns
    ),
    judged AS (
        SELECT *, left(role, 1) AS initial,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
               CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
        FROM placed
    ),
    moves(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
    inserts(p, q, cost, audit) AS (
        VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'),
               (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')
    ),
    edits AS (
        SELECT conv_id, pos, p, p AS q, 4 AS cost, 'D' AS audit FROM judged, (VALUES (0), (1), (2), (3)) states(p)
        UNION ALL
        SELECT conv_id, pos, p, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K'
        FROM judged JOIN moves USING (initial) WHERE fault IN ('none', 'truncated')
        UNION ALL
        SELECT conv_id, pos, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R'
        FROM judged, moves WHERE fault IN ('none', 'truncated') AND moves.initial <> 's'
    ),
    steps(conv_id, pos, state, cost, audit) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, q, i.cost, i.audit FROM judged, inserts i WHERE p = 0
        UNION ALL
        SELECT conv_id, pos, state, best.cost, best.audit
        FROM (
            SELECT s.conv_id, e.pos, i.q AS state,
                   min({{'cost': s.cost + e.cost + i.cost, 'audit': s.audit || e.audit || i.audit}}) AS best
            FROM steps s JOIN edits e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e.pos = s.pos + 1 AND e.p = s.state
                 JOIN inserts i ON i.p = e.q
            GROUP BY s.conv_id, e.pos, i.q
        )
    ),
    counted AS (
        SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, max(pos) AS n,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    ),
    best AS (
        SELECT c.conv_id, min({{'cost': s.cost, 'audit': s.audit}}) AS best
        FROM counted c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = c.n AND s.state IN (0, 3)
        GROUP BY c.conv_id
    ),
    letters AS (
        SELECT conv_id, letter,
               sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth) AS pos,
               sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth) AS place
        FROM (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS nth, audit[nth] AS letter FROM best)
    ),
    kept AS (
        SELECT l.conv_id, l.place, l.letter, j.role, CASE WHEN l.letter = 'I' THEN '' ELSE j.text END AS text,
               max(CASE WHEN l.place = 1 AND l.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
        FROM letters l LEFT JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND l.pos = j.pos
        WHERE l.letter <> 'D'
    ),
    repaired AS (
        SELECT conv_id, sha256(string_agg(
                   CASE WHEN letter = 'K' THEN role WHEN (place + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                   chr(10) ORDER BY place)) AS digest
        FROM kept GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
           coalesce(best.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
         LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
         LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
         LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
