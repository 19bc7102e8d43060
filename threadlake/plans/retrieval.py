"""Retrieval queries: topic keywords as questions over all documents; label centroids over all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators import lexical
from threadlake.operators import retrieval as op
from threadlake.operators import vectors
from threadlake.plans.lineage import Stages
from threadlake.sources.tables import table


def _passages(spark, d):
    return table(spark, d, "documents").filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("passage_id"), "text")


def _questions(spark, d):
    words = F.from_json("keywords_json", "array<string>")
    return table(spark, d, "topics").select(F.col("id").alias("query_id"), F.array_join(words, " ").alias("text")).filter("text is not null")


def _scores(spark, d, mode="auto"):
    return Stages(spark, f"bm25-{mode}").keep(op.bm25(_passages(spark, d), _questions(spark, d), mode=mode))


def _lists(spark, d, run, *modes):
    """The rows of ``run`` over the lists of every block of questions."""
    out = None
    for block in lexical.query_blocks(_questions(spark, d)):
        rows = run(lexical.Lists(_passages(spark, d), block, *modes))
        out = rows if out is None else out.unionByName(rows)
    return out


def bm25_top(spark, d):
    """The ten best documents of every topic's keywords, ties included."""
    return op.top_ties(_scores(spark, d))


def bm25_matches(spark, d):
    """How many documents match each question, and the sum of their scores."""
    return _lists(spark, d, lambda x: x.totals(), "auto").withColumn("total", F.round("total", 3))


def _rrf(x, goal):
    """Fused rows and candidates of both lists, named by their questions."""
    return [x.named(rows) for rows in x.reciprocal(goal)]


BOTH = ("accented", "folded")


def rrf_top(spark, d):
    """Accented and folded index fused by reciprocal ranks."""
    return op.top_ties(_lists(spark, d, lambda x: _rrf(x, "top")[0], *BOTH))


def weighted_top(spark, d):
    return op.top_ties(_lists(spark, d, lambda x: x.top_fused("weighted"), *BOTH))


def distribution_top(spark, d):
    return op.top_ties(_lists(spark, d, lambda x: x.top_fused("distribution"), *BOTH))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"), "label")


def _centres(spark, d):
    return vectors.centroids(_vectors(spark, d), "label", "vector").select(F.col("label").cast("string").alias("query_id"), F.col("centroid").alias("vector"))


def _dense(spark, d):
    return Stages(spark, "dense").keep(op.dense(_vectors(spark, d), _centres(spark, d)))


def dense_top(spark, d):
    """The twenty nearest vectors of every label centroid."""
    return _dense(spark, d)


def reranked(spark, d):
    """The dense list with its first ten re-scored by the raw dot product with the centroid."""
    rows = _dense(spark, d)
    j = rows.join(_vectors(spark, d), "passage_id").join(_centres(spark, d).withColumnRenamed("vector", "c"), "query_id")
    scores = j.select("query_id", "passage_id", F.round(vectors.dot(F.col("vector"), F.col("c")), 6).alias("score"))
    return op.rerank(rows, scores, 10)


def diverse(spark, d):
    """The first twenty vectors of every centroid's whole list that repeat none before them, by maximal marginal relevance."""
    v = _vectors(spark, d).select("passage_id", "vector")
    return op.mmr(op.diverse_top(v, _centres(spark, d), v), v)


def gold_ranks(spark, d):
    """Where the vectors of each label first stand in its own list of all vectors."""
    gold = _vectors(spark, d).select(F.col("label").cast("string").alias("query_id"), F.col("label").alias("unit"), "passage_id")
    return op.gold_range(op.rank_range(op.dense_scores(_vectors(spark, d), _centres(spark, d))), gold)


def ab_verdicts(spark, d):
    """Fused by ranks against fused by weights, whole lists; the gold of a question is the first document of its accented list."""

    def run(x):
        fused, rows = x.reciprocal("gold")
        first = rows.filter("a > 0").groupBy("slot").agg(F.min(F.struct(-F.col("a"), "passage_id", "b")).alias("x")).select("slot", "x.passage_id", (-F.col("x.col1")).alias("a"), "x.b")
        gold = x.named(first).select("query_id", F.lit(0).alias("unit"), "passage_id")
        return op.ab_verdict(op.gold_answer(op.gold_range(op.rank_range(x.named(fused)), gold)), x.weighted_places(first))

    return _lists(spark, d, run, *BOTH)


def _graded(scores):
    """A stored grade of 0 to 3 per question and passage, as a judge would give: by score, four points a grade."""
    return scores.select("query_id", "passage_id", F.least(F.floor(F.col("score") / 4), F.lit(3)).cast("int").alias("grade"))


def score_counts(spark, d):
    """How many question and passage pairs bear each grade."""
    return _lists(spark, d, lambda x: x.grade_counts(), "auto").groupBy("grade").agg(F.sum("pairs").alias("pairs"))


def non_gold_kept(spark, d):
    """Per question the passages graded high enough to keep that are no gold (gold: the first place of the list, ties included)."""
    kept = _lists(spark, d, lambda x: x.kept_behind_first(), "auto")
    return _questions(spark, d).select("query_id").join(kept, "query_id", "left").select("query_id", F.coalesce("k", F.lit(0)).alias("kept"))


def graded_top(spark, d):
    """The ten best documents in the order of their grades, those under the kept grade dropped."""
    s = _scores(spark, d)
    rows = op.graded_rerank(op.top_ties(s), _graded(s), op.TOP_K)
    return op.grade_filter(rows, _graded(s)).select("query_id", "passage_id", "rank", "tied_from", "tied_to")


def rank_moves(spark, d):
    """Places that documents of the fused list gained against the accented list, where that is certain."""

    def run(x):
        fused, rows = _rrf(x, "top")
        listed = rows.filter("a > 0").select("query_id", "passage_id", (F.col("a") / lexical.UNIT).alias("score"))
        return op.rank_moves(op.top_ties(listed), op.top_ties(fused))

    return _lists(spark, d, run, *BOTH).select("query_id", "passage_id", F.col("moved").cast("int").alias("moved"))


def removal_steps(spark, d):
    """At which step documents of the accented list went: cut to the first ten, or graded too low."""
    return _lists(spark, d, lambda x: x.steps(), "accented")


def rounding_ties(spark, d):
    """Pairs of vectors per centroid that tie only because scores are rounded to two places."""
    x = op.dense_scores(_vectors(spark, d), _centres(spark, d)).select("query_id", F.round("score", 2).alias("s"), "score")
    g = x.groupBy("query_id", "s", "score").agg(F.count("*").alias("c")).groupBy("query_id", "s").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return g.groupBy("query_id").agg((F.sum(F.col("n") * (F.col("n") - 1) - F.col("same")) / 2).cast("long").alias("ties"))


def passage_hashes(spark, d):
    """Passages once each before anything is scored on them: the first id per text."""
    return _passages(spark, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("passage_id").alias("passage_id"))


def questions_with_tokens(spark, d):
    t, f = T.search_tokens(F.col("text")), T.search_tokens(T.folded("text"))
    return _questions(spark, d).select("query_id", F.array_join(t, " ").alias("tokens"), (t != f).alias("accented"))


QUERIES = (bm25_top, bm25_matches, rrf_top, weighted_top, distribution_top, dense_top, reranked, diverse, gold_ranks, ab_verdicts, score_counts, non_gold_kept, graded_top, rank_moves, removal_steps, rounding_ties, passage_hashes, questions_with_tokens)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _tokens_sql(x: str) -> str:
    base = f"lower(nfc_normalize(regexp_replace(regexp_replace({x}, '\\x{{FE0F}}?\\x{{20E3}}', ' ', 'g'), '[\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')))"
    t = "t"
    for old, new in T.terminal_tones().items():
        t = f"regexp_replace({t}, '(^|[^q]){old}$', '\\1{new}')"
    return f"list_transform(regexp_extract_all({base}, '\\p{{N}}+(?:[.,]\\p{{N}}+)+|[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{M}}\\p{{N}}]*'), lambda t: {t})"


def _folded_sql(x: str) -> str:
    return f"replace(strip_accents(lower(nfc_normalize({x}))), 'đ', 'd')"


_BM = f"""WITH pq AS (SELECT doc_id AS passage_id, {_tokens_sql('text')} AS t, {_tokens_sql(_folded_sql('text'))} AS f FROM documents WHERE text IS NOT NULL),
qq0 AS (SELECT id AS query_id, array_to_string(from_json(keywords_json, '["VARCHAR"]'), ' ') AS text FROM topics),
qq AS (SELECT query_id, {_tokens_sql('text')} AS t, {_tokens_sql(_folded_sql('text'))} AS f FROM qq0 WHERE text IS NOT NULL),
sz AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg_len FROM pq),
pt AS (SELECT passage_id, true AS acc, unnest(t) AS term, len(t) AS len FROM pq UNION ALL SELECT passage_id, false, unnest(f), len(t) FROM pq),
tf AS (SELECT acc, term, passage_id, count(*) AS tf, max(len) AS len FROM pt GROUP BY 1, 2, 3),
dfq AS (SELECT acc, term, count(*) AS df FROM tf GROUP BY 1, 2),
md AS (SELECT 'auto' AS mode, query_id, t <> f AS acc, t, f FROM qq UNION ALL SELECT 'accented', query_id, true, t, f FROM qq UNION ALL SELECT 'folded', query_id, false, t, f FROM qq),
qt AS (SELECT mode, query_id, acc, unnest(CASE WHEN acc THEN t ELSE f END) AS term FROM md),
qc AS (SELECT mode, query_id, acc, term, count(*) AS times FROM qt GROUP BY ALL),
sc0 AS (SELECT mode, query_id, passage_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6)::DOUBLE AS score
       FROM qc JOIN tf USING (acc, term) JOIN dfq USING (acc, term), sz GROUP BY 1, 2, 3),
sc AS (SELECT * FROM sc0 WHERE score > 0),
al AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.passage_id, b.passage_id) AS passage_id, coalesce(a.score, 0) AS sa, coalesce(b.score, 0) AS sb
       FROM (SELECT * FROM sc WHERE mode = 'accented') a FULL JOIN (SELECT * FROM sc WHERE mode = 'folded') b ON a.query_id = b.query_id AND a.passage_id = b.passage_id)
"""


def _top(rows: str, k: int = 10) -> str:
    return f", rw AS ({rows}), rk AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS tied_from, count(*) OVER (PARTITION BY query_id, score) AS c FROM rw) SELECT query_id, passage_id, score, rank::INT AS rank, tied_from::INT AS tied_from, tied_from + c - 1 AS tied_to FROM rk WHERE tied_from <= {k}"


_DN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v0, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), l AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY 1),
c AS (SELECT label::VARCHAR AS query_id, label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM l),
dr AS (SELECT query_id, vec_id AS passage_id, round(list_dot_product(v, c), 6) AS score FROM e, c)
"""


def oracle_sql() -> dict[str, str]:
    weighted = "SELECT query_id, passage_id, round(0.5 * CASE WHEN max(sa) OVER w > min(sa) OVER w THEN (sa - min(sa) OVER w) / (max(sa) OVER w - min(sa) OVER w) ELSE 0 END + 0.5 * CASE WHEN max(sb) OVER w > min(sb) OVER w THEN (sb - min(sb) OVER w) / (max(sb) OVER w - min(sb) OVER w) ELSE 0 END, 6)::DOUBLE AS score FROM al WINDOW w AS (PARTITION BY query_id)"

    def z(c):
        return f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.5 ELSE ({c} - avg({c}) OVER w + 3 * stddev_samp({c}) OVER w) / (6 * stddev_samp({c}) OVER w) END"

    dist = f"SELECT query_id, passage_id, round({z('sa')} + {z('sb')}, 6)::DOUBLE AS score FROM al WINDOW w AS (PARTITION BY query_id)"
    rr = ", rr AS (SELECT query_id, passage_id, 1.0::DOUBLE / (60 + rank() OVER w + (count(*) OVER (PARTITION BY mode, query_id, score) - 1) / 2.0::DOUBLE) AS s FROM sc WHERE mode <> 'auto' WINDOW w AS (PARTITION BY mode, query_id ORDER BY score DESC))"
    dense = _top("SELECT * FROM dr", 20)
    return {
        "bm25_top": _BM + _top("SELECT query_id, passage_id, score FROM sc WHERE mode = 'auto'"),
        "bm25_matches": _BM + "SELECT query_id, count(*) AS matches, round(sum(score), 3)::DOUBLE AS total FROM sc WHERE mode = 'auto' GROUP BY 1",
        "rrf_top": _BM + rr + _top("SELECT query_id, passage_id, round(sum(s), 6)::DOUBLE AS score FROM rr GROUP BY 1, 2"),
        "weighted_top": _BM + _top(weighted),
        "distribution_top": _BM + _top(dist),
        "dense_top": _DN + dense,
        "gold_ranks": _DN + _top("SELECT * FROM dr", 10**9).replace(" SELECT query_id, passage_id, score, rank::INT", ", tp AS (SELECT query_id, passage_id, score, rank::INT", 1).replace("tied_from::INT AS tied_from", "tied_from") + "), h AS (SELECT tp.query_id, e.label AS unit, tied_from, tied_to, count(*) AS h FROM tp JOIN e ON e.vec_id = tp.passage_id AND e.label::VARCHAR = tp.query_id GROUP BY ALL), f AS (SELECT query_id, unit, arg_min(struct_pack(a := tied_from, b := tied_to, h := h), tied_from) AS x FROM h GROUP BY 1, 2) SELECT c.query_id, c.label AS unit, x.a AS rank_from, x.b - x.h + 1 AS rank_to FROM c LEFT JOIN f ON f.query_id = c.query_id AND f.unit = c.label",
        "reranked": _DN + dense.replace(" SELECT query_id, passage_id, score, rank::INT", ", tp AS (SELECT query_id, passage_id, score, rank::INT", 1) + "), hd AS (SELECT tp.query_id, tp.passage_id, round(list_dot_product(e.v0, c.c), 6) AS score FROM tp JOIN e ON e.vec_id = tp.passage_id JOIN c ON c.query_id = tp.query_id WHERE tied_from <= 10) SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS tied_from, rank() OVER (PARTITION BY query_id ORDER BY score DESC) + count(*) OVER (PARTITION BY query_id, score) - 1 AS tied_to, false AS not_reranked FROM hd UNION ALL SELECT query_id, passage_id, score, rank, tied_from, tied_to, true FROM tp WHERE tied_from > 10",
        "ab_verdicts": _BM + rr + f""", w AS ({weighted}), f AS (SELECT query_id, passage_id, round(sum(s), 6)::DOUBLE AS score FROM rr GROUP BY 1, 2), gd AS (SELECT query_id, arg_min(passage_id, (-score, passage_id)) AS passage_id FROM sc WHERE mode = 'accented' GROUP BY 1),
rf AS (SELECT query_id, passage_id, rank() OVER v AS a, rank() OVER v + count(*) OVER (PARTITION BY query_id, score) - 1 AS b FROM f WINDOW v AS (PARTITION BY query_id ORDER BY score DESC)), rw AS (SELECT query_id, passage_id, rank() OVER v AS a, rank() OVER v + count(*) OVER (PARTITION BY query_id, score) - 1 AS b FROM w WINDOW v AS (PARTITION BY query_id ORDER BY score DESC))
SELECT query_id, CASE WHEN rf.a IS NULL AND rw.a IS NULL THEN 'unranked' WHEN rw.a IS NULL THEN 'A' WHEN rf.a IS NULL THEN 'B' WHEN rf.a <= rw.b AND rw.a <= rf.b THEN 'overlap' WHEN rf.b < rw.a THEN 'A' ELSE 'B' END AS verdict FROM gd LEFT JOIN rf USING (query_id, passage_id) LEFT JOIN rw USING (query_id, passage_id)""",
        "score_counts": _BM + "SELECT least(floor(score / 4), 3)::INT AS grade, count(*) AS pairs FROM sc WHERE mode = 'auto' GROUP BY 1",
        "non_gold_kept": _BM + ", k AS (SELECT query_id, least(floor(score / 4), 3) AS grade, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM sc WHERE mode = 'auto') SELECT qq.query_id, count(k.r) AS kept FROM qq LEFT JOIN k ON k.query_id = qq.query_id AND grade >= 2 AND r > 1 GROUP BY 1",
        "graded_top": _BM + _top("SELECT query_id, passage_id, score FROM sc WHERE mode = 'auto'").replace(" SELECT query_id, passage_id, score, rank::INT", ", tp AS (SELECT query_id, passage_id, score, rank::INT", 1) + "), g AS (SELECT *, least(floor(score / 4), 3) AS grade FROM tp), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS nr FROM g), m AS (SELECT *, min(nr) OVER w AS na, max(nr) OVER w AS nb FROM n WINDOW w AS (PARTITION BY query_id, grade, tied_from, tied_to)), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nr) AS hr FROM m WHERE grade >= 2) SELECT query_id, passage_id, hr::INT AS rank, (min(hr) OVER v)::INT AS tied_from, (max(hr) OVER v)::INT AS tied_to FROM h WINDOW v AS (PARTITION BY query_id, na, nb)",
        "rank_moves": _BM + rr + ", f AS (SELECT query_id, passage_id, round(sum(s), 6)::DOUBLE AS score FROM rr GROUP BY 1, 2), x AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS r, rank() OVER v AS a, rank() OVER v + count(*) OVER (PARTITION BY query_id, score) - 1 AS b FROM sc WHERE mode = 'accented' WINDOW v AS (PARTITION BY query_id ORDER BY score DESC)), y AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS r, rank() OVER v AS a, rank() OVER v + count(*) OVER (PARTITION BY query_id, score) - 1 AS b FROM f WINDOW v AS (PARTITION BY query_id ORDER BY score DESC)) SELECT y.query_id, y.passage_id, CASE WHEN y.a > x.b OR x.a > y.b THEN (x.r - y.r)::INT END AS moved FROM y JOIN x ON x.query_id = y.query_id AND x.passage_id = y.passage_id WHERE x.a <= 10 AND y.a <= 10",
        "removal_steps": _BM + ", k AS (SELECT query_id, passage_id, least(floor(score / 4), 3) AS grade, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM sc WHERE mode = 'accented') SELECT query_id, passage_id, CASE WHEN r > 10 THEN 'top' WHEN grade < 2 THEN 'grade' END AS step FROM k",
        "rounding_ties": _DN + ", g AS (SELECT query_id, round(score, 2) AS s, score, count(*) AS c FROM dr GROUP BY 1, 2, 3), h AS (SELECT query_id, s, sum(c) AS n, sum(c * (c - 1)) AS same FROM g GROUP BY 1, 2) SELECT query_id, (sum(n * (n - 1) - same) / 2)::BIGINT AS ties FROM h GROUP BY 1",
        "passage_hashes": "SELECT sha256(text) AS hash, min(doc_id) AS passage_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1",
        "questions_with_tokens": _BM + "SELECT query_id, array_to_string(t, ' ') AS tokens, t <> f AS accented FROM qq",
    }
