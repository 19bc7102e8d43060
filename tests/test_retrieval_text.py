import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from threadlake.functions import text as T
from threadlake.operators import chunks, keywords, retrieval

ROW = "query_id string, passage_id long, score double"


def ranks(spark, data):
    return retrieval.rank_range(spark.createDataFrame(data, ROW))


def test_rank_range_and_top_ties(spark):
    data = [("q", 3, 0.5), ("q", 1, 0.5), ("q", 2, 0.9), ("q", 4, 0.1)]
    assert [(r.passage_id, r.rank, r.tied_from, r.tied_to) for r in ranks(spark, data).orderBy("rank").collect()] == [(2, 1, 1, 1), (1, 2, 2, 3), (3, 3, 2, 3), (4, 4, 4, 4)]
    top = retrieval.top_ties(spark.createDataFrame(data, ROW), 2)
    assert [(r.passage_id, r.tied_from, r.tied_to) for r in top.orderBy("rank").collect()] == [(2, 1, 1), (1, 2, 3), (3, 2, 3)]


def test_renumber_carries_groups(spark):
    kept = ranks(spark, [("q", 1, 0.5), ("q", 2, 0.5), ("q", 3, 0.5), ("q", 4, 0.1)]).filter("passage_id <> 2")
    assert [(r.passage_id, r.rank, r.tied_from, r.tied_to) for r in retrieval.renumber(kept).orderBy("rank").collect()] == [(1, 1, 1, 2), (3, 2, 1, 2), (4, 3, 3, 3)]


def test_fusion_of_constant_and_absent_lists(spark):
    a, b = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 2.0)], ROW), spark.createDataFrame([("q", 2, 1.0), ("q", 3, 3.0)], ROW)
    w = {r.passage_id: r.score for r in retrieval.fuse_weighted(a, b).collect()}
    assert w == {1: 0.5, 2: pytest.approx(0.5 + 1 / 6, abs=1e-6), 3: 0.5}
    one = retrieval.fuse_distribution(a.filter("passage_id = 1"), b.limit(0))
    assert [r.score for r in one.collect()] == [1.0]


def test_bm25_statistics_ignore_filters_and_count_repeats(spark):
    p = spark.createDataFrame([(1, "bánh mì ngon"), (2, "banh mi"), (3, None), (4, "")], "passage_id long, text string")
    q = spark.createDataFrame([("a", "bánh"), ("f", "banh"), ("ff", "banh banh")], "query_id string, text string")
    out = {(r.query_id, r.passage_id): r.score for r in retrieval.bm25(p, q).collect()}
    assert set(out) == {("a", 1), ("f", 1), ("f", 2), ("ff", 1), ("ff", 2)}
    assert out["ff", 2] == pytest.approx(2 * out["f", 2], abs=2e-6)
    assert retrieval.bm25(p.limit(0), q).count() == 0


def brute_mmr(score, v, lam):
    left, out = list(range(len(score))), []
    rel = (score - score.min()) / (score.max() - score.min())
    while left:
        vals = [round(lam * rel[i] - (1 - lam) * (max(v[i] @ v[j] for j in out) if out else 0), 6) for i in left]
        out.append(left.pop(int(np.argmax(vals))))
    return out


def test_mmr_and_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(12, 4))
    v[5] = v[2] * 2
    score = np.sort(rng.random(12))[::-1]
    r = ranks(spark, [("q", i, float(s)) for i, s in enumerate(score)])
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "passage_id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s6 = np.round(score, 6)
    got = [x.passage_id for x in retrieval.mmr(r, vec).orderBy("rank").collect()]
    assert got == brute_mmr(s6, u, 0.5)
    kept = []
    for i in range(12):
        if all(u[i] @ u[j] < 0.95 for j in kept):
            kept.append(i)
    assert [x.passage_id for x in retrieval.near_duplicates(r, vec).orderBy("rank").collect()] == kept and 5 not in kept


def test_gold_range_equals_all_orders(spark):
    rng = random.Random(8)
    for _ in range(6):
        n = 6
        score = [rng.choice([0.1, 0.2, 0.3]) for _ in range(n)]
        gold = {0: rng.sample(range(n), 2), 1: rng.sample(range(n), 1)}
        gold[1] = [x for x in gold[1] if x not in gold[0]] or [next(x for x in range(n) if x not in gold[0])]
        places = {0: set(), 1: set(), "both": set()}
        for perm in itertools.permutations(range(n)):
            if all(score[a] >= score[b] for a, b in zip(perm, perm[1:])):
                first = {u: min(perm.index(x) for x in g) + 1 for u, g in gold.items()}
                places[0].add(first[0])
                places[1].add(first[1])
                places["both"].add(max(first.values()))
        r = ranks(spark, [("q", i, s) for i, s in enumerate(score)])
        g = spark.createDataFrame([("q", u, x) for u, xs in gold.items() for x in xs], "query_id string, unit int, passage_id long")
        ranges = retrieval.gold_range(r, g)
        got = {x.unit: (x.rank_from, x.rank_to) for x in ranges.collect()}
        assert got == {u: (min(places[u]), max(places[u])) for u in (0, 1)}
        a = retrieval.gold_answer(ranges).first()
        assert (a.rank_from, a.rank_to) == (min(places["both"]), max(places["both"]))


def test_ab_verdicts_moves_and_removal(spark):
    a = spark.createDataFrame([("1", 1, 2), ("2", None, None), ("3", 5, 6), ("4", None, None)], "query_id string, rank_from int, rank_to int")
    b = spark.createDataFrame([("1", 2, 3), ("2", 4, 4), ("3", 7, 9), ("4", None, None)], "query_id string, rank_from int, rank_to int")
    assert rows(retrieval.ab_verdict(a, b)) == [("1", "overlap"), ("2", "B"), ("3", "A"), ("4", "unranked")]
    before, after = ranks(spark, [("q", 1, 0.9), ("q", 2, 0.5), ("q", 3, 0.5)]), ranks(spark, [("q", 3, 0.9), ("q", 1, 0.5), ("q", 2, 0.1)])
    assert {r.passage_id: r.moved for r in retrieval.rank_moves(before, after).collect()} == {1: -1, 2: None, 3: 2}
    steps = [("start", before), ("first", before.filter("passage_id < 3")), ("second", before.filter("passage_id < 2"))]
    assert {r.passage_id: r.step for r in retrieval.removed_at(steps).collect()} == {1: None, 2: "second", 3: "first"}


def test_reranks_spill_over_ties(spark):
    r = ranks(spark, [("q", 1, 0.9), ("q", 2, 0.5), ("q", 3, 0.5), ("q", 4, 0.1)])
    new = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.2), ("q", 3, 0.3), ("q", 4, 0.9)], ROW)
    assert [(x.passage_id, x.not_reranked) for x in retrieval.rerank(r, new, 2).orderBy("rank").collect()] == [(3, False), (2, False), (1, False), (4, True)]
    g = spark.createDataFrame([("q", 1, 2), ("q", 2, 3), ("q", 3, 3), ("q", 4, 1)], "query_id string, passage_id long, grade int")
    assert [(x.passage_id, x.tied_from, x.tied_to) for x in retrieval.graded_rerank(r, g, 3).orderBy("rank").collect()] == [(2, 1, 2), (3, 1, 2), (1, 3, 3), (4, 4, 4)]
    assert [x.passage_id for x in retrieval.grade_filter(r, g).orderBy("rank").collect()] == [1, 2, 3]


def test_metadata_filter(spark):
    u = spark.createDataFrame([(1, "a", "2026-01"), (2, None, "2026-01"), (3, "b", "2026-02")], "id int, topic_id string, month string")
    ids = lambda **k: [r.id for r in retrieval.metadata_filter(u, **k).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(topics=[None]) == [2] and ids(topics=["a", None], months=["2026-01"]) == [1, 2] and ids(topics=["b"], months=["2026-01"]) == []


def test_normalize():
    assert T.normalize("hoà  bình\n\tthuý  https://a.example/x).") == "hòa bình thúy https://a.example/x"
    assert T.normalize(unicodedata.normalize("NFD", "đẹp quá")) == "đẹp quá" and T.normalize(None) is None
    assert T.fold("Đặng Tiến Đông") == "dang tien dong"
    assert T.search_form("quý hoà") == "quý hòa" and T.search_form("1️⃣ ❤️") == "1  ❤"


TEXTS = ["", "a", "One. Two! Three…\nFour", "😀 Hello there. 😀 2. Item one. 3) Item two.", "x" * 1200, " ".join(["word"] * 400), "Para one.\n\nPara two is " + "long " * 200]


@pytest.mark.parametrize("way", sorted(T.WAYS))
def test_spans_cover_every_character(way):
    for t in TEXTS:
        spans = T.WAYS[way](t)
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(c.isspace() for i, c in enumerate(t) if i not in covered)
        if way.startswith("fixed"):
            assert all(b - a <= int(way.split("_")[1]) for a, b in spans)
        assert all(a < b for a, b in spans) and spans == sorted(spans)


def test_sentences():
    t = "😀 Hello there. 😀 2. Item one. 3) Item two."
    assert [t[a:b] for a, b in T.sentence_spans(t)] == ["😀 Hello there. 😀", "2. Item one.", "3) Item two."]


def test_semantic_chunks_and_overlap(spark):
    u = spark.createDataFrame([("u", "One is here. Two is here. Three is here."), ("v", "Single.")], "id string, full_text string")
    s = spark.createDataFrame([("u", 0, [1.0, 0.0]), ("u", 1, [1.0, 0.1]), ("u", 2, [0.0, 1.0]), ("v", 0, [1.0, 0.0])], "unit_id string, k int, vector array<double>")
    c = chunks.semantic_chunks(u, s)
    assert sorted(r.chunk for r in c.collect()) == ["One is here. Two is here.", "Single.", "Three is here."]
    spans = spark.createDataFrame([("u", 0, 12, "x"), ("u", 25, 26, "y")], "unit_id string, span_start int, span_end int, mark string")
    assert [r.mark for r in chunks.overlapping(c, spans).collect()] == ["x"]


def test_utf16(spark):
    df = spark.createDataFrame([("a😀b", 2), ("abc", 2)], "t string, i int")
    assert [r.o for r in df.select(T.utf16_offset(F.col("t"), F.col("i")).alias("o")).collect()] == [3, 2]


def test_keywords_pair_displaces_words(spark):
    docs = [("c1", i, "raw noodles soup. raw noodles bowl") for i in range(3)] + [("c2", i, "tax form office. tax form late") for i in range(3, 6)]
    df = spark.createDataFrame(docs, "class_id string, doc_id int, t string").select("class_id", "doc_id", keywords.terms(keywords.segments(F.col("t"))).alias("terms"))
    out = {r.class_id: r.keywords for r in keywords.keywords(df, 3).collect()}
    assert "raw noodles" in out["c1"] and "raw" not in out["c1"] and "noodles" not in out["c1"]
    seg = spark.createDataFrame([("l'été de 2026 est beau",)], "t string").select(keywords.segments(F.col("t")).alias("s")).first().s
    assert seg == [["été", None, None, None, "beau"]]
