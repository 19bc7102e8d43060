import importlib

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from threadlake.functions import text as T
from threadlake.operators import keywords as kw
from threadlake.operators import significance
from threadlake.plans import base, comparisons, threads

PLANS = ("general", "overview", "reach", "threads", "comparisons", "identity", "texts", "retrieval", "streams", "summary")
MODULES = [importlib.import_module(f"threadlake.plans.{m}") for m in PLANS]
CASES = [(m, k) for m in MODULES for k in m.oracle_sql()]


@pytest.mark.parametrize("module,name", CASES, ids=[k for _, k in CASES])
def test_query_equals_sql(spark, data, module, name):
    compare(module.queries()[name](spark, data), module.oracle_sql()[name], data)


ALL = {k: f for m in MODULES for k, f in m.queries().items()}


@pytest.mark.parametrize("way", ["fixed_500", "recursive_500", "sentence"])
def test_chunks_are_the_pure_spans_of_every_unit(spark, data, way):
    texts = {r.id: r.full_text for r in base.units(spark, data, "full_text").collect()}
    got = ALL[f"chunks_{way}"](spark, data).orderBy("chunk_id").collect()
    wanted = [(u, *s) for u in sorted(texts) if texts[u] for raw in T.WAYS[way](texts[u]) if (s := T.trim(texts[u], raw))]
    assert [(r.unit_id, r.span_start, r.span_end) for r in got] == wanted and [r.chunk_id for r in got] == list(range(len(wanted)))
    assert all(r.chunk == texts[r.unit_id][r.span_start : r.span_end] for r in got)


def standing(terms, k):
    """What stands of the least prefix of which k stand: pairs, and words that no pair of the prefix holds."""
    for t in range(len(terms) + 1):
        prefix = terms[:t]
        held = {w for x in prefix if " " in x for w in x.split(" ")}
        kept = [x for x in prefix if " " in x or x not in held]
        if len(kept) == k:
            break
    return kept


@pytest.mark.parametrize("k", [3, 8])
def test_keywords_equal_their_definition(spark, data, k):
    u = base.units(spark, data, "full_text").filter("full_text is not null").join(threads._topic_of(spark, data).select("id", "topic_id"), "id")
    docs = u.select(F.col("topic_id").alias("class_id"), F.col("id").alias("doc_id"), kw.terms(kw.segments(F.col("full_text"))).alias("terms"))
    size = {r.class_id: r["count"] for r in docs.groupBy("class_id").count().collect()}
    scored = [r for r in kw.term_scores(docs).collect() if not r.ubiquitous and r.docs >= min(2, size[r.class_id])]
    wanted = {}
    for c in {r.class_id for r in scored}:
        own = sorted((r for r in scored if r.class_id == c), key=lambda r: (round(r.score, 9), len(r.term.split(" ")), r.term), reverse=True)
        wanted[c] = standing([r.term for r in own], k)
    assert {r.class_id: list(r.keywords) for r in kw.keywords(docs, k).collect()} == wanted and len(wanted) > 1
    if k == 8:
        assert {r.class_id: r.keywords.split(",") for r in ALL["topic_keywords"](spark, data).collect()} == wanted


def test_diverse_rows_are_unlike_and_many(spark, data):
    v = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    by = {}
    for r in ALL["diverse"](spark, data).collect():
        by.setdefault(r.query_id, []).append(r.passage_id)
    for ids in by.values():
        m = np.array([v[i] for i in ids])
        assert (m @ m.T - 2 * np.eye(len(ids))).max() < 0.95 and len(ids) == 20


def test_comparisons_against_the_kernel(spark, data):
    """Every topic and rate of the whole query equals the kernel on the values themselves; topics and noise add up to the channel."""
    cells = comparisons._cells(spark, data).toPandas()
    got = ALL["topic_comparisons"](spark, data).toPandas()
    assert len(got) == cells.dropna().groupby(["topic_id", "metric"]).ngroups
    for r in got.head(4).itertuples():
        own = cells[(cells.topic_id == r.group_id) & (cells.metric == r.metric)].value.to_numpy()
        rest = cells[(cells.topic_id != r.group_id) & (cells.metric == r.metric)].value.to_numpy()
        wanted = significance.compare(np.sort(own), np.sort(rest), seed=zlib.crc32(f"{r.group_id}|{r.metric}".encode()))
        assert (r.p, r.delta, r.n_group, r.n_rest) == (pytest.approx(wanted["p"]), pytest.approx(wanted["delta"]), len(own), len(rest))
    rows_ = ALL["comparison_rows"](spark, data).toPandas()
    for _, g in rows_.groupby("metric"):
        parts, whole = g[g.kind != "channel"], g[g.kind == "channel"].iloc[0]
        assert parts.n.sum() == whole.n and parts.excluded_no_views.sum() == whole.excluded_no_views


def test_every_name_is_registered_once():
    names = [k for m in MODULES for k in m.queries()]
    assert len(names) == len(set(names))
