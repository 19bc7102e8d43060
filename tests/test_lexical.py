"""Queries over whole BM25 lists: equal to their SQL, and no table of a row per question and passage is ever written."""

import json
import random

import pytest

from tests.oracle import compare
from threadlake.operators import lexical
from threadlake.plans import retrieval
from threadlake.plans.lineage import Stages

NAMES = ("rrf_top", "bm25_matches", "ab_verdicts", "non_gold_kept", "distribution_top", "weighted_top", "score_counts", "removal_steps", "rank_moves")
WORDS = "phở bò bún chả bánh mì ngon quá pho bo bun cha banh mi ngon qua the soup of noodles à la carte".split()
QUESTIONS, PASSAGES = 40, 600


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every question meets most passages; questions and passages repeat; one question has no words, one asks for none that occur."""
    d, rng = tmp_path_factory.mktemp("lists"), random.Random(3)
    asked = [" ".join(rng.choices(WORDS, k=rng.randint(2, 7))) for _ in range(QUESTIONS - 4)]
    asked += [asked[0], asked[1], "!", "xyz"]
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([3, 4, 9, 20]))) for _ in range(PASSAGES * 2 // 3)]
    texts += rng.choices(texts, k=PASSAGES - len(texts) - 1) + [""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").toPandas().to_parquet(d / "documents.parquet")
    spark.createDataFrame([(f"q{i}", json.dumps(a.split())) for i, a in enumerate(asked)], "id string, keywords_json string").toPandas().to_parquet(d / "topics.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_no_row_per_pair_is_kept(spark, folder, monkeypatch, name):
    kept, keep = [], Stages.keep
    monkeypatch.setattr(Stages, "keep", lambda self, df: (out := keep(self, df), kept.append(out.count()))[0])
    compare(retrieval.queries()[name](spark, folder), retrieval.oracle_sql()[name], folder)
    assert max(kept) < QUESTIONS * PASSAGES / 3


@pytest.mark.parametrize("name", [n for n in NAMES if n in ("rrf_top", "ab_verdicts", "rank_moves", "bm25_matches", "removal_steps", "score_counts")])
def test_longer_tops_and_blocks_of_questions(spark, folder, monkeypatch, name):
    monkeypatch.setattr(lexical, "FIRST", 1)
    monkeypatch.setattr(lexical, "GROWTH", 2)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 200)
    compare(retrieval.queries()[name](spark, folder), retrieval.oracle_sql()[name], folder)


def test_deliveries_of_one_passage_add_up(spark):
    p = spark.createDataFrame([(1, "pho bo"), (1, "pho ga ngon"), (2, "pho"), (3, None)], "passage_id long, text string")
    q = spark.createDataFrame([("a", "pho ngon"), ("b", "phở")], "query_id string, text string")
    lists = lexical.Lists(p, q, "auto")
    # idf of pho: 2 of 4 rows, ngon: 1 of 4; lengths of the rows 2, 3, 1, 0: the greater counts where a term is in both
    idf = {t: lexical.np.log1p((4 - n + 0.5) / (n + 0.5)) for t, n in (("pho", 2), ("ngon", 1))}
    part = lambda n, length: n / (n + 1.2 * (0.25 + 0.75 * length / 1.5))
    total = idf["pho"] * (part(2, 3) + part(1, 1)) + idf["ngon"] * part(1, 3)
    assert [(r.query_id, r.matches, r.total) for r in lists.totals().collect()] == [("a", 2, pytest.approx(total, abs=2e-6))]
