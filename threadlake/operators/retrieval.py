"""Lexical and dense retrieval over any number of queries at once: scores, rank ranges, fusion, reranking, diversity."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators.order_statistics import ranked
from threadlake.operators.vectors import dot, unit
from threadlake.plans.lineage import Stages

#: Fixed values of the methods.
K1, B = 1.2, 0.75
RRF_K = 60
DECIMALS = 6
ALPHA = 0.5
TOP_N, TOP_K = 20, 10
DUPLICATE, LAMBDA = 0.95, 0.5
KEEP_GRADE = 2
#: Bytes of query vectors that one block broadcasts.
BLOCK_BYTES = 32_000_000


class Bm25Index:
    """Postings of the terms that a stated set of queries asks for, in accented and folded form, made in one pass over the
    passages; corpus statistics cover all passages."""

    def __init__(self, passages: DataFrame, queries: DataFrame):
        stages = Stages(passages.sparkSession, "bm25")
        self.queries = stages.keep(queries.select("query_id", T.search_tokens(F.col("text")).alias("t"), T.search_tokens(T.folded("text")).alias("f")))
        wanted = self._terms(self.queries, F.lit(True)).union(self._terms(self.queries, F.lit(False))).distinct()
        tokens = passages.select("passage_id", T.search_tokens(F.col("text")).alias("t"), T.search_tokens(T.folded("text")).alias("f"))
        # one pass gives the postings that a query asks for and, as postings of an empty term, the lengths of all passages
        wanted = wanted.union(passages.sparkSession.range(1).select(F.lit(True), F.lit("")))
        forms = F.array(F.struct(F.lit(True).alias("accented"), F.concat(F.array(F.lit("")), F.coalesce("t", F.array().cast("array<string>"))).alias("w")), F.struct(F.lit(False).alias("accented"), F.col("f").alias("w")))
        terms = tokens.select("passage_id", F.greatest(F.coalesce(F.size("t"), F.lit(0)), F.lit(0)).alias("len"), F.explode(forms).alias("x")).select("passage_id", "len", "x.accented", F.explode("x.w").alias("term"))
        counted = terms.join(wanted, ["accented", "term"], "left_semi").groupBy("accented", "term", "passage_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        counted = stages.keep(counted)
        size = counted.filter("term = ''").agg(F.sum("tf").alias("n"), F.sum(F.col("len") * F.col("tf")).alias("words")).first()
        self.postings = counted.filter("term <> ''")
        self.n, self.mean = size["n"] or 0, (size["words"] or 0) / max(size["n"] or 0, 1)

    @staticmethod
    def _terms(queries: DataFrame, accented: Column) -> DataFrame:
        return queries.select(accented.alias("accented"), F.explode(F.when(accented, F.col("t")).otherwise(F.col("f"))).alias("term"))

    def scores(self, mode: str = "auto", k1: float = K1, b: float = B) -> DataFrame:
        """query_id, passage_id, score (rounded, over 0); a query with any accented token reads the accented postings, else the
        folded ones (``mode`` fixes one of them). Repeated query terms add."""
        accented = {"auto": F.col("t") != F.col("f"), "accented": F.lit(True), "folded": F.lit(False)}[mode]
        asked = self.queries.select("query_id", accented.alias("accented"), F.explode(F.when(accented, F.col("t")).otherwise(F.col("f"))).alias("term")).groupBy("query_id", "accented", "term").agg(F.count("*").alias("times"))
        df = self.postings.groupBy("accented", "term").agg(F.count("*").alias("df"))
        idf = F.log1p((F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.join(df, ["accented", "term"]).select("query_id", "accented", "term", (F.col("times") * idf).alias("w"))
        norm = (1 - b) + b * F.col("len") / F.lit(float(self.mean))
        scored = self.postings.join(weights, ["accented", "term"]).groupBy("query_id", "passage_id").agg(F.sum(F.col("w") * F.col("tf") / (F.col("tf") + k1 * norm)).alias("score"))
        return scored.select("query_id", "passage_id", F.round("score", DECIMALS).alias("score")).filter("score > 0")


def bm25(passages: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B, mode: str = "auto") -> DataFrame:
    """query_id, passage_id, score (rounded, over 0) of passages (passage_id, text) for queries (query_id, text).

    idf ln(1 + (N - df + .5) / (df + .5)), tf / (tf + k1 * norm). A filter belongs after the scores, for corpus statistics always
    cover all passages. Only postings of query terms are shuffled; the hot ones are summed map-side.
    """
    return Bm25Index(passages, queries).scores(mode, k1, b)


def rank_range(rows: DataFrame, key: str = "query_id", item: str = "passage_id", score: str = "score") -> DataFrame:
    """rows and rank, tied_from, tied_to per key: score descending, item ascending; ties share a range."""
    r = ranked(rows.select(key, item, F.round(score, DECIMALS).alias(score)), [key], [F.desc(score), F.col(item)])
    ties = r.groupBy(F.col(key).alias("_k"), F.col(score).alias("_s")).agg((F.min("_rank") + 1).alias("tied_from"), (F.max("_rank") + 1).alias("tied_to"))
    return r.join(ties, (F.col(key) == F.col("_k")) & (F.col(score) == F.col("_s"))).select(key, item, score, (F.col("_rank") + 1).alias("rank"), "tied_from", "tied_to")


def top_ties(rows: DataFrame, k: int = TOP_K, key: str = "query_id", item: str = "passage_id", score: str = "score") -> DataFrame:
    """Rank ranges of the first k rows per key and of all that tie with the k-th; parts of a key are cut down before they meet."""
    order = [F.desc(score)]
    part = Window.partitionBy(key, F.pmod(F.xxhash64(item), F.lit(32))).orderBy(*order)
    few = rows.withColumn("_r", F.rank().over(part)).filter(F.col("_r") <= k)
    w, ties = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, score)
    r = few.withColumn("tied_from", F.rank().over(w)).filter(F.col("tied_from") <= k).withColumn("tied_to", F.col("tied_from") + F.count("*").over(ties) - 1)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.col(item)))).select(key, item, score, "rank", "tied_from", "tied_to")


def renumber(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """New ranks after a filter; tie groups are carried on as memberships, not found again from scores."""
    w = Window.partitionBy(key).orderBy("rank")
    out = rows.withColumn("_new", F.row_number().over(w))
    g = Window.partitionBy(key, "tied_from", "tied_to")
    return out.withColumns({"_from": F.min("_new").over(g), "_to": F.max("_new").over(g)}).drop("rank", "tied_from", "tied_to").withColumnsRenamed({"_new": "rank", "_from": "tied_from", "_to": "tied_to"})


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, passage_id, score: sums of 1 / (k + middle of the rank range) over all lists (unioned rank ranges)."""
    mid = (F.col("tied_from") + F.col("tied_to")) / 2
    return lists.groupBy("query_id", "passage_id").agg(F.round(F.sum(1.0 / (k + mid)), DECIMALS).alias("score"))


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("query_id", "passage_id", F.col("score").alias("sa")).join(b.select("query_id", "passage_id", F.col("score").alias("sb")), ["query_id", "passage_id"], "full")
    return j.select("query_id", "passage_id", F.coalesce("sa", F.lit(0.0)).alias("sa"), F.coalesce("sb", F.lit(0.0)).alias("sb"))


def _with_stats(j: DataFrame, *stats) -> DataFrame:
    s = j.groupBy(F.col("query_id").alias("_q")).agg(*[f(c).alias(f"{c}_{n}") for c in ("sa", "sb") for n, f in stats])
    return j.join(s, F.col("query_id") == F.col("_q")).drop("_q")


def fuse_weighted(a: DataFrame, b: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(1 - alpha) * min-max of a + alpha * min-max of b over the candidates of either; a constant list counts 0."""
    j = _with_stats(_aligned(a, b), ("lo", F.min), ("hi", F.max))

    def scaled(c: str) -> Column:
        return F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(0.0)

    return j.select("query_id", "passage_id", F.round((1 - alpha) * scaled("sa") + alpha * scaled("sb"), DECIMALS).alias("score"))


def fuse_distribution(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of (x - (mean - 3 sd)) / (6 sd) of both lists (sample deviation); equal values count 0.5."""
    j = _with_stats(_aligned(a, b), ("mu", F.avg), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))

    def scaled(c: str) -> Column:
        flat = (F.col(f"{c}_hi") == F.col(f"{c}_lo")) | F.col(f"{c}_sd").isNull()
        return F.when(flat, 0.5).otherwise((F.col(c) - F.col(f"{c}_mu") + 3 * F.col(f"{c}_sd")) / (6 * F.col(f"{c}_sd")))

    return j.select("query_id", "passage_id", F.round(scaled("sa") + scaled("sb"), DECIMALS).alias("score"))


def dense_scores(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, passage_id, score: the cosine of every passage vector (passage_id, vector) with each of a stated set of queries
    (query_id, vector). Queries go out in blocks of at most ``BLOCK_BYTES``, whatever their number."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    blocks = max(1, -(-(size["n"] or 0) * (size["dim"] or 0) * 8 // BLOCK_BYTES))
    own = passages.select("passage_id", unit(F.col("vector")).alias("pv"))
    asked = queries.select("query_id", unit(F.col("vector")).alias("qv"))
    out = None
    for k in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        part = own.crossJoin(F.broadcast(block)).select("query_id", "passage_id", F.round(dot(F.col("pv"), F.col("qv")), DECIMALS).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def dense(passages: DataFrame, queries: DataFrame, k: int = TOP_N) -> DataFrame:
    """The k best passages (and their ties) per query by cosine; each task keeps its best k per query and part before anything
    is shuffled."""
    return top_ties(dense_scores(passages, queries), k)


def rerank(rows: DataFrame, scores: DataFrame, n: int = TOP_N) -> DataFrame:
    """The first n rows, extended to the end of their tie, in the order of new scores (query_id, passage_id, score); the tail follows
    as it was, marked ``not_reranked``."""
    head = rows.filter(F.col("tied_from") <= n)
    tail = rows.filter(F.col("tied_from") > n).withColumn("not_reranked", F.lit(True))
    new = rank_range(head.select("query_id", "passage_id").join(scores, ["query_id", "passage_id"])).withColumn("not_reranked", F.lit(False))
    return new.unionByName(tail.select(*new.columns))


def graded_rerank(rows: DataFrame, grades: DataFrame, n: int = TOP_N) -> DataFrame:
    """As ``rerank`` with grades 0-3: stable; rows tie only if they tied before and have one grade."""
    head = rows.filter(F.col("tied_from") <= n).drop("score").join(grades.withColumnRenamed("grade", "score"), ["query_id", "passage_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    g = Window.partitionBy("query_id", "score", "tied_from", "tied_to")
    new = head.withColumn("_n", F.row_number().over(w)).withColumns({"_a": F.min("_n").over(g), "_b": F.max("_n").over(g)})
    new = new.select("query_id", "passage_id", F.col("score").cast("double").alias("score"), F.col("_n").alias("rank"), F.col("_a").alias("tied_from"), F.col("_b").alias("tied_to"), F.lit(False).alias("not_reranked"))
    tail = rows.filter(F.col("tied_from") > n).withColumn("not_reranked", F.lit(True))
    return new.unionByName(tail.select(*new.columns))


def grade_filter(rows: DataFrame, grades: DataFrame, least: int = KEEP_GRADE) -> DataFrame:
    """Rows graded at least ``least``, the tail included, renumbered."""
    return renumber(rows.join(grades.filter(F.col("grade") >= least), ["query_id", "passage_id"], "left_semi"))


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    v = np.array(pdf["vector"].tolist(), float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


_RANGES = "query_id string, passage_id long, score double, rank int, tied_from int, tied_to int"


def _with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    ranks = [F.col(c).cast("int").alias(c) for c in ("rank", "tied_from", "tied_to")]
    return rows.join(vectors, "passage_id").select("query_id", "passage_id", "score", *ranks, "vector")


def near_duplicates(rows: DataFrame, vectors: DataFrame, threshold: float = DUPLICATE, wanted: int | None = None) -> DataFrame:
    """Drops a row whose cosine with an earlier kept row reaches the threshold; renumbered.

    ``wanted`` ends a query's list once so many are kept (a row is judged by earlier ones alone, so the first kept rows do not
    depend on where the list ends). The rows of a query meet in one task: give lists cut to a top, or use ``diverse_top``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v, kept = _vectors(pdf), []
        for i in range(len(pdf)):
            if wanted is not None and len(kept) == wanted:
                break
            if not kept or (v[kept] @ v[i]).max() < threshold:
                kept.append(i)
        return pdf.iloc[kept].drop(columns="vector")

    return renumber(_with_vectors(rows, vectors).groupBy("query_id").applyInPandas(run, _RANGES))


def diverse_top(passages: DataFrame, queries: DataFrame, vectors: DataFrame, wanted: int = TOP_N, threshold: float = DUPLICATE) -> DataFrame:
    """The first ``wanted`` rows of every query that repeat no row before them, from the whole list.

    Lists start at twice the wanted length; a query that keeps fewer is asked again with a list twice as long, until it is
    satisfied or its list was the whole table, so copies never crowd out what stands behind them.
    """
    stages = Stages(passages.sparkSession, "diverse")
    total, length, todo, out = passages.count(), 2 * wanted, queries, None
    while True:
        kept = stages.keep(near_duplicates(dense(passages, todo, length), vectors, threshold, wanted))
        short = [] if length >= total else [r["query_id"] for r in todo.select("query_id").join(kept.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < wanted).select("query_id").collect()]
        done = kept.filter(~F.col("query_id").isin(short)) if short else kept
        out = done if out is None else out.unionByName(done)
        if not short:
            return out
        todo, length = queries.filter(F.col("query_id").isin(short)), 2 * length


class _Marginal:
    """Marginal relevance of one query's rows: how a row trades its scaled score against what is picked already."""

    def __init__(self, score: np.ndarray, vectors: np.ndarray, lam: float):
        low, spread = (score.min(), np.ptp(score)) if len(score) else (0.0, 0.0)
        self.gain = lam * ((score - low) / spread if spread else 0 * score)
        self.likeness, self.share = vectors @ vectors.T, 1 - lam
        self.nearest: np.ndarray | None = None  # greatest likeness with a picked row

    def values(self) -> np.ndarray:
        return np.round(self.gain if self.nearest is None else self.gain - self.share * self.nearest, DECIMALS)

    def take(self, row: int) -> None:
        like = self.likeness[row]
        self.nearest = like.copy() if self.nearest is None else np.maximum(self.nearest, like)
        self.gain[row] = -np.inf


def mmr(rows: DataFrame, vectors: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """Maximal marginal relevance (Carbonell and Goldstein 1998): each place goes to the row of the greatest
    lam * scaled score - (1 - lam) * greatest cosine with a placed row; ``tied_at_pick`` counts the others equal to it then (null
    for a single row). Rows are a list already cut to its top: its table of likenesses is held at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        state = _Marginal(pdf["score"].to_numpy(float).copy(), _vectors(pdf), lam)
        places = []
        for _ in range(len(pdf)):
            now = state.values()
            row = int(np.argmax(now))
            places.append({"row": row, "score": now[row], "tied_at_pick": int(np.count_nonzero(now == now[row])) - 1})
            state.take(row)
        order = pd.DataFrame(places)
        place = np.arange(1, len(order) + 1)
        out = pdf.loc[order["row"], ["query_id", "passage_id"]].reset_index(drop=True)
        alone = len(order) == 1  # keeps its score: there is nothing to trade against
        return out.assign(score=pdf["score"] if alone else order["score"], rank=place, tied_from=place, tied_to=place, tied_at_pick=None if alone else order["tied_at_pick"])

    return _with_vectors(rows, vectors).groupBy("query_id").applyInPandas(run, _RANGES + ", tied_at_pick int")


def removed_at(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, passage_id, step: the first step whose rows no longer hold an item of the first one (null: it stayed)."""
    first = steps[0][1].select("query_id", "passage_id").distinct()
    out, step = first, F.lit(None).cast("string")
    for name, rows in reversed(steps[1:]):
        flag = f"_{name}"
        out = out.join(rows.select("query_id", "passage_id", F.lit(True).alias(flag)).distinct(), ["query_id", "passage_id"], "left")
        step = F.when(F.col(flag).isNull(), name).otherwise(step)
    return out.select("query_id", "passage_id", step.alias("step"))


def gold_range(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, unit, rank_from, rank_to of gold items (query_id, unit, passage_id): over all orders within tie groups the best
    place of a unit is the start of its earliest group, the worst that group's end minus its other hits there. Null without a hit."""
    hits = rows.join(gold, ["query_id", "passage_id"]).groupBy("query_id", "unit", "tied_from", "tied_to").agg(F.count("*").alias("h"))
    first = hits.groupBy("query_id", "unit").agg(F.min(F.struct("tied_from", "tied_to", "h")).alias("x"))
    units = gold.select("query_id", "unit").distinct()
    return units.join(first, ["query_id", "unit"], "left").select("query_id", "unit", F.col("x.tied_from").alias("rank_from"), (F.col("x.tied_to") - F.col("x.h") + 1).alias("rank_to"))


def gold_answer(ranges: DataFrame) -> DataFrame:
    """query_id, rank_from, rank_to for all units of a query together: from is the greatest, over the groups, of group start plus units in it
    minus one; to the greatest of the units' ends; null if a unit is missing."""
    groups = ranges.groupBy("query_id", "rank_from").agg(F.count("*").alias("k"), F.max("rank_to").alias("to"))
    missing = F.bool_or(F.col("rank_from").isNull())
    g = groups.groupBy("query_id").agg(missing.alias("missing"), F.max(F.col("rank_from") + F.col("k") - 1).alias("f"), F.max("to").alias("t"))
    return g.select("query_id", F.when(~F.col("missing"), F.col("f")).alias("rank_from"), F.when(~F.col("missing"), F.col("t")).alias("rank_to"))


def ab_verdict(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, verdict of two gold answers: A or B if it alone ranks or ranks wholly before; else no clear winner."""
    j = a.select("query_id", F.col("rank_from").alias("af"), F.col("rank_to").alias("at")).join(b.select("query_id", F.col("rank_from").alias("bf"), F.col("rank_to").alias("bt")), "query_id", "full")
    ra, rb = F.col("af").isNotNull(), F.col("bf").isNotNull()
    v = F.when(~ra & ~rb, "unranked").when(~rb, "A").when(~ra, "B").when((F.col("af") <= F.col("bt")) & (F.col("bf") <= F.col("at")), "overlap").when(F.col("at") < F.col("bf"), "A").otherwise("B")
    return j.select("query_id", v.alias("verdict"))


def rank_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, passage_id, moved: places gained, only where the rank ranges do not overlap."""
    j = after.join(before.select("query_id", "passage_id", F.col("rank").alias("_r"), F.col("tied_from").alias("_f"), F.col("tied_to").alias("_t")), ["query_id", "passage_id"])
    apart = (F.col("tied_from") > F.col("_t")) | (F.col("_f") > F.col("tied_to"))
    return j.select("query_id", "passage_id", F.when(apart, F.col("_r") - F.col("rank")).alias("moved"))


def rounding_ties(rows: DataFrame, raw: str = "score") -> DataFrame:
    """query_id, ties: pairs equal after rounding but not before."""
    g = rows.groupBy("query_id", F.round(raw, DECIMALS).alias("_s"), raw).agg(F.count("*").alias("c")).groupBy("query_id", "_s").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    return g.groupBy("query_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast("long").alias("ties"))


def metadata_filter(units: DataFrame, *, topics: list[str | None] | None = None, months: list[str] | None = None) -> DataFrame:
    """OR inside a field, AND across fields; an empty selection selects all; a null topic can be selected."""
    if topics:
        named = [t for t in topics if t is not None]
        ok = F.coalesce(F.col("topic_id").isin(named), F.lit(False)) if named else F.lit(False)
        units = units.filter(ok | F.col("topic_id").isNull() if None in topics else ok)
    return units.filter(F.col("month").isin(months)) if months else units


def parts_touched(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """chunks with ``opening`` and ``continuation``: which parts of the thread a chunk's span touches (spans: unit_id, place, span_start, span_end)."""
    s = spans.select("unit_id", "place", F.col("span_start").alias("_a"), F.col("span_end").alias("_b"))
    hit = chunks.join(s, "unit_id").filter((F.col("span_start") < F.col("_b")) & (F.col("_a") < F.col("span_end")))
    return hit.groupBy("unit_id", "span_start", "span_end").agg(F.bool_or(F.col("place") == 0).alias("opening"), F.bool_or(F.col("place") > 0).alias("continuation"))


def sub_queries(queries: DataFrame, rewrites: DataFrame, transform: str) -> DataFrame:
    """Sub-queries (query_id, sub_id, text) of a transform: ``none`` keeps the question, others take the stored rewrites (query_id,
    transform, place, text); ``expand`` and ``step_back`` also keep the question itself."""
    own = queries.select("query_id", F.lit(0).alias("sub_id"), "text")
    if transform == "none":
        return own
    new = rewrites.filter(F.col("transform") == transform).select("query_id", (F.col("place") + 1).alias("sub_id"), "text")
    return own.unionByName(new) if transform in ("expand", "step_back") else new


def merge_sub_queries(ranges: DataFrame) -> DataFrame:
    """Rank ranges of sub-queries (query_id, sub_id, ...) merged by reciprocal ranks."""
    return rank_range(rrf(ranges))


def contextual(chunks: DataFrame, contexts: DataFrame, way: str) -> DataFrame:
    """Chunk texts preceded by their context and a line feed, except for whole texts."""
    if way == "whole":
        return chunks
    j = chunks.join(contexts.select("chunk_id", "context"), "chunk_id", "left")
    return j.withColumn("chunk", F.concat_ws("\n", "context", "chunk")).drop("context")


def exact_round(column: Column, decimals: int = DECIMALS) -> Column:
    """Half away from zero on the exact binary value, where ``round`` decides on the shortest decimal form. Python decimals hold a
    double exactly, so this is an Arrow-batched function for where that exactness is claimed."""
    step = Decimal(1).scaleb(-decimals)

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: float(Decimal(x).quantize(step, ROUND_HALF_UP)) + 0.0, na_action="ignore")

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(column)


def plan_status(lexical: bool, dense_: bool, has_vectors: bool) -> str:
    """ok, bm25-only (dense was asked for but has no vectors), or in-progress (nothing can run)."""
    if dense_ and not has_vectors:
        return "bm25-only" if lexical else "in-progress"
    return "ok" if lexical or dense_ else "in-progress"
