import datetime as dt
import math

import numpy as np
import pytest

from tests.oracle import compare
from threadlake.llm import percentiles as P

ROW = "unit_id string, measured_on date, topic_id string, popularity_index long, engagement_rate double, n int"


def test_leaves_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 1e-300, 1, 1.0000001, 7, 1e300, np.inf])
    leaf = P.leaves(x)
    assert (np.diff(leaf) >= 0).all() and leaf[4] == leaf[5]
    np.testing.assert_allclose(P.leaf_value(P.leaves(x[2:10])), x[2:10], rtol=2**-19)


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed", "sorted"])
def test_rank_error_is_bounded_after_any_merges(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=60_000), "ties": rng.integers(0, 7, 60_000).astype(float), "skewed": rng.lognormal(3, 4, 60_000), "sorted": np.arange(60_000.0)}[kind]
    parts = np.array_split(x, [100, 5_000, 5_001, 40_000])
    nodes, counts = zip(*[P.compress(P.leaves(p) + (1 << P.BITS), np.ones(len(p), np.int64), 0.01) for p in parts])
    n, c = P.compress(np.concatenate(nodes), np.concatenate(counts), 0.02)
    assert c.sum() == len(x) and len(n) < 3 * P.BITS / 0.02
    r, leaf = P.Ranks(n, c), np.sort(P.leaves(x))
    for v in rng.choice(leaf, 60):
        below, upto = np.searchsorted(leaf, v), np.searchsorted(leaf, v, "right")
        assert r.surely_below(v) <= below and upto <= r.at_most(v)
        assert r.at_most(v) - r.surely_below(v) <= (upto - below) + 2 * 0.03 * len(x)
    for rank in (0, 17, 30_000, 59_999):
        low, high = r.leaf_range(rank)
        assert low <= leaf[rank] <= high


def frames(spark, values, stored):
    rows = [(f"u{k}", dt.date(2026, 3, 1 + k % 28), g, 10, v, 1) for k, (g, v) in enumerate(values)]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(stored, "group_id string, bucket_key string, iqr_low double, median double, iqr_high double, v double")


def test_edges_of_the_band_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.lognormal(0, 1, 200), 3)
    at = lambda p: float(np.percentile(x, p))
    eps = 1e-12
    stored = [("t", "2026-03", at(22), at(53), at(78)), ("t", "all", at(22) - eps, at(53) + eps, at(78) + eps), ("t", "all", None, math.nan, at(75)), (None, "all", 9.0, 9.0, 9.0), ("zz", "all", 9.0, 9.0, 9.0)]
    m, s = frames(spark, [("t", float(v)) for v in x], [(*r, 0.0) for r in stored])
    got = {tuple(r) for r in P.wrong_statistics(m, s).collect()}
    assert got == {("t", "all", "iqr_low"), ("t", "all", "median"), ("t", "all", "iqr_high")}


def test_small_groups_and_unusable_rows(spark):
    good = [("t", float(v)) for v in range(39)]
    m, s = frames(spark, good, [("t", "all", -5.0, 1e9, 1e9, 0.0)])
    extra = spark.createDataFrame([("u0", dt.date(2026, 3, 1), "t", 10, 0.0, 1), ("x", dt.date(2026, 3, 1), "t", 0, 5.0, 1), ("y", dt.date(2026, 3, 1), "t", 5, math.nan, 1), ("z", None, "t", 5, 5.0, 1), ("w", dt.date(2026, 3, 1), None, 5, 5.0, 1), ("v", dt.date(2026, 3, 1), "t", 5, None, 1)], ROW)
    assert P.wrong_statistics(m.union(extra), s).count() == 0
    assert P.wrong_statistics(m.limit(0), s).count() == 0 and P.wrong_statistics(m, s.limit(0)).count() == 0
    r = {x.bucket_key: x for x in P.group_percentiles(m.union(extra)).collect()}
    assert r["all"].n == r["2026-03"].n == 39 and abs(r["all"].median - 19) < 1e-3


def test_digest_over_partitions(spark):
    df = spark.range(200_000, numPartitions=7).selectExpr("cast(id % 2 as string) as g", "cast(id as double) as v")
    for r in P.digest(df, ["g"], "v", 0.01).collect():
        ranks = P.Ranks(np.array(r.nodes), np.array(r.weights))
        assert ranks.n == 100_000 and len(r.nodes) <= 3 * P.BITS / 0.01
        assert abs(P.leaf_value(np.array([ranks.quantile_leaf(0.5)]))[0] - 100_000) <= 0.02 * 200_000


def test_query_equals_sql(spark, data):
    compare(P.queries()["p6_found"](spark, data), P.oracle_sql()["p6_found"], data)
