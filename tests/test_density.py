import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import density, retrieval, significance


def test_leaf_clusters_find_separate_clouds():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 0.2, (30, 3)), rng.normal(0, 0.2, (25, 3)) + 5, [[20.0, 20, 20]]])
    lab = density.leaf_clusters(x, 10)
    assert len(set(lab[:30]) - {-1}) == 1 and len(set(lab[30:55]) - {-1}) == 1 and set(lab[:30]) - {-1} != set(lab[30:55]) - {-1}
    assert lab[-1] == -1
    two = np.r_[np.zeros(30, int), np.ones(25, int), -1]
    assert density.validity(x, two) > 0.5 > density.validity(x, rng.permutation(two))
    assert density.validity(x, np.zeros(len(x), int)) is None and (density.leaf_clusters(x[:3]) == -1).all()


def test_spanning_tree_is_least():
    d = np.array([[0, 1, 4], [1, 0, 2], [4, 2, 0.0]])
    assert density.spanning_tree(d)[:, 2].sum() == 3


def test_size_is_checked(monkeypatch):
    monkeypatch.setattr(density, "MOST_POINTS", 5)
    with pytest.raises(ValueError):
        density.leaf_clusters(np.zeros((20, 3)))


def test_principal_axes(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(80, 4)) * [5, 3, 1, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>").repartition(3)
    out = np.array([[r.x, r.y, r.z] for r in density.principal_coordinates(df, "k", "v").orderBy("k").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(out), np.abs((x - x.mean(0)) @ vt[:3].T), atol=1e-8)


def test_rounding_on_the_binary_value(spark):
    df = spark.createDataFrame([(0.0000005,), (0.5,), (2.5,), (-2.5,)], "v double")
    assert [r.r for r in df.select(retrieval.exact_round(F.col("v"), 0).alias("r")).collect()] == [0.0, 1.0, 3.0, -3.0]
    assert df.limit(1).select(retrieval.exact_round(F.col("v")).alias("r")).first().r == 0.0 and df.limit(1).select(F.round("v", 6).alias("r")).first().r == 1e-6
    assert retrieval.plan_status(True, True, False) == "bm25-only" and retrieval.plan_status(False, True, False) == "in-progress"


def test_sub_queries_and_context(spark):
    q = spark.createDataFrame([("q", "ask")], "query_id string, text string")
    r = spark.createDataFrame([("q", "expand", 0, "more"), ("q", "hyde", 0, "made up")], "query_id string, transform string, place int, text string")
    texts = lambda t: sorted(x.text for x in retrieval.sub_queries(q, r, t).collect())
    assert texts("none") == ["ask"] and texts("expand") == ["ask", "more"] and texts("hyde") == ["made up"]
    c = spark.createDataFrame([(1, "body"), (2, "other")], "chunk_id int, chunk string")
    x = spark.createDataFrame([(1, "about")], "chunk_id int, context string")
    assert [r.chunk for r in retrieval.contextual(c, x, "fixed_300").orderBy("chunk_id").collect()] == ["about\nbody", "other"]


def test_pair_bootstrap():
    v = np.full((6, 6), 0.7)
    assert significance.pair_bootstrap_interval(v, 100) == (pytest.approx(0.7), pytest.approx(0.7))
