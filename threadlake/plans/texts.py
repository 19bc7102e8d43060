"""Text, chunking and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators import chunks as op
from threadlake.operators import keywords as kw
from threadlake.plans import base
from threadlake.plans.base import WITH
from threadlake.plans.threads import _topic_of
from threadlake.sources.tables import table


def normalized_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized("text").alias("normalized"))


def letter_token_counts(spark, d):
    w = T.letter_tokens(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(w).cast("long").alias("tokens"), F.char_length("text").cast("long").alias("characters"))


def folded_contains(spark, d):
    """Documents that hold a phrase whatever their accents and case."""
    return table(spark, d, "documents").filter("text is not null").filter(T.folded("text").contains("ban goc")).select("doc_id")


def text_hashes(spark, d):
    """Texts delivered under several ids: hash, copies, first id (map-side combined; only the hash is shuffled)."""
    t = table(spark, d, "documents").filter("text is not null").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return t.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def utf16_lengths(spark, d):
    """UTF-16 offset of each text's end, and the upper bound of its tokens."""
    x = table(spark, d, "documents").filter("text is not null")
    return x.select("doc_id", T.utf16_offset(F.col("text"), F.char_length("text")).alias("utf16"), F.octet_length("text").alias("token_bound"))


def language_mix(spark, d):
    """Code-mixing index of the labelled languages of each user's documents."""
    lang = F.lower(F.split(F.trim("lang"), "[-_]")[0])
    x = table(spark, d, "documents").filter("username is not null").groupBy("username", lang.alias("l")).agg(F.count("*").alias("c"))
    g = x.groupBy("username").agg(F.collect_list(F.when(F.col("l").isNotNull(), F.col("c"))).alias("counts"), F.sum(F.when(F.col("l").isNull(), F.col("c")).otherwise(0)).alias("u"))
    return g.select("username", F.round(T.code_mixing_index(F.col("counts"), F.col("u")), 6).alias("mix"))


def _chunks(way):
    def run(spark, d):
        return op.numbered(op.chunk(base.units(spark, d, "full_text"), way)).select("chunk_id", "unit_id", "span_start", "span_end", "chunk")

    run.__name__ = f"chunks_{way}"
    return run


def chunks_whole(spark, d):
    return op.chunk(base.units(spark, d, "full_text"), "whole")


def chunks_post(spark, d):
    return op.post_chunks(base.units(spark, d, "full_text"), table(spark, d, "post_spans").filter("unit_id is not null"))


def chunk_parts(spark, d):
    """Post spans per chunk of whole texts that they overlap: the half-open range join."""
    whole = op.chunk(base.units(spark, d, "full_text"), "whole")
    spans = table(spark, d, "post_spans").filter("span_start is not null and span_end is not null and unit_id is not null").select("unit_id", "span_start", "span_end").distinct()
    return op.overlapping(whole, spans).groupBy("unit_id").agg(F.count("*").alias("parts"))


def topic_keywords(spark, d):
    """Keywords of every topic of the newest run; noise is the background."""
    u = base.units(spark, d, "full_text").filter("full_text is not null").join(_topic_of(spark, d).select("id", "topic_id"), "id")
    docs = u.select(F.col("topic_id").alias("class_id"), F.col("id").alias("doc_id"), kw.terms(kw.segments(F.col("full_text"))).alias("terms"))
    return kw.keywords(docs).select("class_id", F.array_join("keywords", ",").alias("keywords"))


def document_term_scores(spark, d):
    """Class-based TF-IDF of the letter tokens of documents by source."""
    w = F.transform(T.letter_tokens(F.col("text")), lambda x: F.lower(x))
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("source").alias("class_id"), "doc_id", w.alias("terms"))
    s = kw.term_scores(docs)
    return s.filter("docs >= 2 and not ubiquitous").select("class_id", "term", "tf", "docs", F.round("score", 9).alias("score"))


QUERIES = (
    normalized_texts, letter_token_counts, folded_contains, text_hashes, utf16_lengths, language_mix, _chunks("fixed_300"), _chunks("fixed_500"), _chunks("fixed_800"),
    _chunks("recursive_500"), _chunks("sentence"), chunks_whole, chunks_post, chunk_parts, topic_keywords, document_term_scores,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _norm_sql() -> str:
    x = "nfc_normalize(text)"
    for old, new in T.tone_pairs():
        x = f"replace({x}, '{old}', '{new}')"
    x = f"regexp_replace({x}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')"
    # an address loses its tail of punctuation; the greedy part takes all but that tail
    return f"regexp_replace(trim({x}), '(https?://\\S*?)[.,!?)\\];:\"'']+( |$)', '\\1\\2', 'g')"


_U = "u AS (SELECT id, arg_max(full_text, built_at) AS t FROM content_units GROUP BY id)"


def oracle_sql() -> dict[str, str]:
    return {
        "normalized_texts": f"SELECT doc_id, {_norm_sql()} AS normalized FROM documents",
        "letter_token_counts": r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+')) AS tokens, length(text) AS characters FROM documents WHERE text IS NOT NULL",
        "folded_contains": "SELECT doc_id FROM documents WHERE contains(replace(lower(strip_accents(text)), 'đ', 'd'), 'ban goc')",
        "text_hashes": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "utf16_lengths": r"SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::INT AS utf16, strlen(text)::INT AS token_bound FROM documents WHERE text IS NOT NULL",
        "language_mix": "WITH x AS (SELECT username, lower(regexp_split_to_array(trim(lang), '[-_]')[1]) AS l, count(*) AS c FROM documents WHERE username IS NOT NULL GROUP BY 1, 2) SELECT username, coalesce(round(100.0::DOUBLE * (1 - (max(c) FILTER (l IS NOT NULL))::DOUBLE / (sum(c) FILTER (l IS NOT NULL))::DOUBLE), 6), 0) AS mix FROM x GROUP BY 1",
        "chunks_whole": f"WITH {_U}" + r" SELECT id AS unit_id, length(t) - length(regexp_replace(t, '^\s+', '')) AS span_start, length(regexp_replace(t, '\s+$', '')) AS span_end, regexp_replace(t, '^\s+|\s+$', '', 'g') AS chunk FROM u WHERE regexp_matches(t, '\S')",
        "chunks_post": f"WITH {_U} SELECT unit_id, span_start, span_end, substr(t, span_start + 1, span_end - span_start) AS chunk FROM (SELECT DISTINCT unit_id, span_start, span_end FROM post_spans) s JOIN u ON u.id = unit_id WHERE span_start >= 0 AND span_end <= length(t) AND span_start < span_end",
        "chunk_parts": f"WITH {_U}, w AS (SELECT id, length(t) - length(regexp_replace(t, '^\\s+', '')) AS a, length(regexp_replace(t, '\\s+$', '')) AS b FROM u WHERE regexp_matches(t, '\\S')) SELECT unit_id, count(*) AS parts FROM (SELECT DISTINCT unit_id, span_start, span_end FROM post_spans) s JOIN w ON w.id = unit_id WHERE a < span_end AND span_start < b GROUP BY 1",
        "document_term_scores": r"WITH t AS (SELECT source AS class_id, doc_id, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT class_id, term, count(*) AS tf, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1, 2), f AS (SELECT term, sum(tf) AS f, count(*) AS classes FROM tf GROUP BY 1), z AS (SELECT class_id, sum(tf) AS size FROM tf GROUP BY 1), m AS (SELECT sum(size) / count(*) AS mean, count(*) AS n FROM z) SELECT tf.class_id, tf.term, tf.tf, docs, round(tf.tf / size * ln(1 + mean / f), 9) AS score FROM tf JOIN f ON f.term = tf.term JOIN z ON z.class_id = tf.class_id, m WHERE docs >= 2 AND NOT (n >= 3 AND classes >= ceil(0.8 * n))",
    }
