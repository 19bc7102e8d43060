"""Cutting unit texts into retrieval chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators.order_statistics import quantiles, ranked
from threadlake.operators.vectors import dot, unit

_SCHEMA = "unit_id string, span_start int, span_end int, chunk string"


def chunk(units: DataFrame, way: str) -> DataFrame:
    """unit_id, span_start, span_end, chunk for a way of ``text.WAYS`` over units (id, full_text); blank chunks are dropped."""
    spans = T.WAYS[way]

    def run(frames):
        for pdf in frames:
            rows = [(u, *s, t[s[0] : s[1]]) for u, t in zip(pdf["id"], pdf["full_text"]) if t for raw in spans(t) if (s := T.trim(t, raw))]
            yield pd.DataFrame(rows, columns=["unit_id", "span_start", "span_end", "chunk"])

    return units.select("id", "full_text").mapInPandas(run, _SCHEMA)


def post_chunks(units: DataFrame, spans: DataFrame) -> DataFrame:
    """One chunk per stored post span that lies inside its text."""
    j = units.select(F.col("id").alias("unit_id"), "full_text").join(spans.select("unit_id", "span_start", "span_end").distinct(), "unit_id")
    ok = j.filter((F.col("span_start") >= 0) & (F.col("span_end") <= F.char_length("full_text")) & (F.col("span_start") < F.col("span_end")))
    return ok.select("unit_id", "span_start", "span_end", F.substring("full_text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("chunk"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_id by unit, then offset, over the whole table, without a single-task window."""
    return ranked(chunks, [], [F.col("unit_id"), F.col("span_start"), F.col("span_end")]).withColumnRenamed("_rank", "chunk_id").drop("_n")


def neighbour_likeness(sentences: DataFrame) -> DataFrame:
    """unit_id, k, cosine of each sentence vector (unit_id, k, vector) and the next one of its unit."""
    nxt = F.lead("vector").over(Window.partitionBy("unit_id").orderBy("k"))
    return sentences.withColumn("_next", nxt).filter(F.col("_next").isNotNull()).select("unit_id", "k", dot(unit(F.col("vector")), unit(F.col("_next"))).alias("cosine"))


def semantic_chunks(units: DataFrame, sentences: DataFrame) -> DataFrame:
    """Chunks broken under the quartile of all neighbour likenesses of the corpus, or over the cap.

    ``sentences``: unit_id, k, vector, one row per sentence span of the unit's text.
    """
    like = neighbour_likeness(sentences)
    limit = quantiles(like, [], "cosine", {"t": T.SEMANTIC_PERCENTILE})
    per = like.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("k", "cosine"))).alias("c")).crossJoin(F.broadcast(limit)).select("unit_id", "c.cosine", "t")
    j = units.select(F.col("id").alias("unit_id"), "full_text").join(per, "unit_id", "left")

    def run(frames):
        for pdf in frames:
            rows = []
            for u, t, c, limit_ in zip(pdf["unit_id"], pdf["full_text"], pdf["cosine"], pdf["t"]):
                s = T.sentence_spans(t or "")
                likeness = list(c) if c is not None else []
                if len(likeness) != max(len(s) - 1, 0):
                    raise ValueError(f"{u}: {len(likeness) + 1} sentence vectors for {len(s)} sentences")
                rows += [(u, a, b, t[a:b]) for a, b in T.semantic_spans(s, likeness, limit_, T.SEMANTIC_CAP)]
            yield pd.DataFrame(rows, columns=["unit_id", "span_start", "span_end", "chunk"])

    return j.mapInPandas(run, _SCHEMA)


def overlapping(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of chunks and spans of one unit that share a code point (half-open ranges): the range join on an equi key."""
    s = spans.select("unit_id", F.col("span_start").alias("_a"), F.col("span_end").alias("_b"), *[c for c in spans.columns if c not in ("unit_id", "span_start", "span_end")])
    return chunks.join(s, "unit_id").filter((F.col("span_start") < F.col("_b")) & (F.col("_a") < F.col("span_end"))).drop("_a", "_b")
