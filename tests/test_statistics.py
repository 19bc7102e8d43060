import itertools
import math
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.conftest import rows
from threadlake.functions import metrics
from threadlake.operators import order_statistics, partitions, reach, sessions, significance


def effect_of(a, b):
    """P(B > A) + P(B = A) / 2 and its standard error from all pairs."""
    above = (np.asarray(b)[None] > np.asarray(a)[:, None]) + (np.asarray(b)[None] == np.asarray(a)[:, None]) / 2
    va, vb = above.mean(1).var(ddof=1) / len(a), above.mean(0).var(ddof=1) / len(b)
    return above.mean(), math.sqrt(va + vb)


def test_a_value_that_half_of_all_rows_share_is_one_row(spark):
    df = spark.range(40_000).selectExpr("'k' as k", "if(id % 2 = 0, 0.0, cast(id as double)) as v")
    r = order_statistics.value_ranks(df, ["k"], "v")
    assert r.count() == 20_001 and r.agg(F.max("_c"), F.max(F.col("_before") + F.col("_c")), F.max("_n")).first()[:] == (20_000, 40_000, 40_000)
    per_task = order_statistics.ranked(df, ["k"], [F.col("v")])
    assert per_task.agg(F.count_distinct("_rank")).first()[0] == 40_000
    groups = spark.createDataFrame([("k",), ("empty",), (None,)], "k string")
    out = {x.k: x for x in order_statistics.distribution(df, ["k"], "v", groups=groups).collect()}
    assert (out["empty"].n, out["empty"].median, out["empty"].insufficient_data) == (0, 0.0, True) == (out[None].n, out[None].mean, out[None].insufficient_data) and out["k"].n == 40_000


def test_distribution_matches_numpy(spark):
    rng = np.random.default_rng(4)
    data = [("a", float(x)) for x in rng.integers(0, 9, 501)] + [("b", 1.5)] + [("c", None)] + [(None, 2.0), (None, 4.0)]
    out = {r.k: r for r in order_statistics.distribution(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    a = [v for k, v in data if k == "a"]
    assert (out["a"].n, out["a"].insufficient_data) == (501, False)
    np.testing.assert_allclose([out["a"].iqr_low, out["a"].median, out["a"].iqr_high, out["a"].mean], [*np.percentile(a, [25, 50, 75]), np.mean(a)])
    assert (out["b"].iqr_low, out["b"].median, out["b"].iqr_high, out["b"].insufficient_data) == (1.5, 1.5, 1.5, True)
    assert "c" not in out and out[None].median == 3.0


def test_ranks_cover_everything(spark):
    df = spark.range(5000).selectExpr("id % 3 as k", "hash(id) % 100 as v")
    r = order_statistics.ranked(df, ["k"], [F.col("v")])
    for k in range(3):
        assert sorted(x._rank for x in r.filter(f"k = {k}").collect()) == list(range(r.filter(f"k = {k}").count()))


def test_rank_sums_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(g, "m", float(v)) for g, v in zip(rng.choice(["x", "y", None], 60), rng.integers(0, 8, 60))]
    out = {r.g: r for r in significance.rank_sums(spark.createDataFrame(data, "g string, metric string, v double"), "g", "metric", "v").collect()}
    for g in ("x", "y"):
        a, b = [v for k, _, v in data if k == g], [v for k, _, v in data if k != g]
        delta = sum((p > q) - (p < q) for p in a for q in b) / (len(a) * len(b))
        assert out[g].delta == pytest.approx(delta)
        assert math.erfc(abs(out[g].z) / math.sqrt(2)) == pytest.approx(significance.mann_whitney(a, b), abs=1e-9)


def test_mann_whitney_exact_by_enumeration():
    a, b = [1.0, 5.0, 9.0], [2.0, 3.0, 4.0, 8.0]
    pool = sorted(a + b)
    us = [sum(x > y for x in s for y in set(pool) - set(s)) for s in itertools.combinations(pool, 3)]
    u = sum(x > y for x in a for y in b)
    top = max(u, 12 - u)
    assert significance.mann_whitney(a, b) == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))


def test_permutation_test_against_enumeration():
    a, b = np.array([1.0, 2.0, 2.5, 7.0]), np.array([3.0, 6.0, 8.0, 9.0])
    pool = np.concatenate([a, b])
    t = []
    for s in itertools.combinations(range(8), 4):
        rest = [i for i in range(8) if i not in s]
        t.append(significance.studentized(*map(np.array, effect_of(pool[list(s)], pool[rest]))))
    seen = significance.studentized(*map(np.array, effect_of(a, b)))
    exact = min(1, 2 * min(np.mean(np.array(t) >= seen - 1e-12), np.mean(np.array(t) <= seen + 1e-12)))
    got = significance.permutation_test(a, b, 20_000, seed=1)
    assert got["p"] == pytest.approx(exact, abs=0.02)
    assert got == significance.permutation_test(a[::-1], b, 20_000, seed=1)
    assert significance.permutation_test([1.0], b) is None and significance.permutation_test([1.0, math.nan], b) is None
    apart = significance.permutation_test([1, 2, 3], [4, 5, 6], 500)
    assert (apart["delta"], apart["delta_low"]) == (-1.0, None)


def test_student_t():
    assert significance.student_t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert significance.student_t_quantile(0.975, 3) == pytest.approx(3.182446305, abs=1e-7)
    assert significance.brunner_munzel_t([1, 1], [1, 1]) is None


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, float("nan"))], "i int, p double")
    out = {r.i: r.p_holm for r in significance.holm(df, "p", []).collect()}
    assert out == {1: pytest.approx(0.03), 3: pytest.approx(0.06), 2: pytest.approx(0.06), 4: None, 5: None}


def test_verdict_and_direction(spark):
    cases = [(None, 0.1, False), (0.01, 0.2, True), (0.2, 0.2, False), (0.01, 0.2, False), (0.01, -0.2, False)]
    df = spark.createDataFrame(cases, "p double, d double, few boolean")
    assert [r.v for r in df.select(metrics.verdict(F.col("p"), F.col("d"), F.col("few")).alias("v")).collect()] == ["not tested", "too few posts", "not distinguishable", "higher", "lower"]
    d = spark.createDataFrame([(0, 0, 1.0), (2, 0, -1.0), (0, 3, 1.0), (1, 2, 0.5), (1, 2, None), (2, 2, None)], "h int, l int, e double")
    assert [r.v for r in d.select(partitions.display_direction(F.col("h"), F.col("l"), F.col("e")).alias("v")).collect()] == [None, "higher", "lower", "higher", "lower", "higher"]


def test_freshness_and_wilson(spark):
    df = spark.createDataFrame([(-3.0,), (12.0,), (60.0,), (108.0,)], "h double")
    assert [r.w for r in df.select(metrics.freshness(F.col("h")).alias("w")).collect()] == [1.0, 1.0, 0.5, 0.25]
    lo, hi = metrics.wilson(F.col("a"), F.col("b"))
    r = spark.createDataFrame([(0, 0), (8, 10)], "a int, b int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert tuple(r[0]) == (0.0, 1.0) and r[1].lo == pytest.approx(0.490157, abs=1e-6) and r[1].hi == pytest.approx(0.943319, abs=1e-6)


def test_summer_time(spark):
    df = spark.createDataFrame([("2026-03-29 00:59:00",), ("2026-03-29 01:01:00",), ("2026-10-25 00:59:00",), ("2026-10-25 01:01:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r.d for r in df.select(metrics.is_dst(F.col("t"), "Europe/Paris").alias("d")).collect()] == [False, True, True, False]


def test_gap_of_exactly_ten_minutes_breaks(spark):
    secs = [0, 599, 1199, 1798, 2398, 2398]
    df = spark.createDataFrame([(s,) for s in secs], "s int").select(F.timestamp_seconds("s").alias("ts"))
    b = sessions.gap_batches(df, 600)
    assert sorted(x["count"] for x in b.groupBy("batch").count().collect()) == [2, 2, 2]


def test_reach_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(reach, "BLOCK", 32)
    rng = np.random.default_rng(6)
    views = rng.integers(1, 500, 150).tolist()
    df = spark.createDataFrame([(f"{i:04d}", i, v) for i, v in enumerate(views)], "id string, s int, views int").withColumn("posted_at", F.timestamp_seconds(F.col("s") * 3600))
    out = {r.position: r for r in reach.relative_reach(df).collect()}
    assert len(out) == 150
    for i in range(150):
        want = None if i < 10 else float(np.median(views[max(0, i - 20) : i]))
        assert out[i].baseline == want


def test_partition_runs_a_b_a(spark):
    runs = [(1, "u", 0), (1, "v", 1), (2, "u", 0), (2, "v", 1), (3, "u", 1), (3, "v", 1), (4, "u", 0), (4, "v", 1)]
    df = spark.createDataFrame(runs, "run_id long, unit_id string, label int")
    assert [r.partition_no for r in partitions.distinct_partitions(df).orderBy("run_id").collect()] == [1, 1, 2, 3]


def test_identity_events(spark):
    prev = [(f"u{i}", "A") for i in range(6)] + [(f"v{i}", "B") for i in range(4)] + [(f"w{i}", "C") for i in range(4)]
    cur = [(f"u{i}", 0 if i < 3 else 1) for i in range(6)] + [(f"v{i}", 2) for i in range(4)] + [(f"w{i}", 2) for i in range(4)] + [("n1", 3), ("n2", 3)]
    m = partitions.match_clusters(spark.createDataFrame(prev, "unit_id string, topic string"), spark.createDataFrame(cur, "unit_id string, label int"))
    got = {r.cluster: (r.event, r.topic, r.sources) for r in m.collect()}
    assert got == {0: ("split", None, "A"), 1: ("split", None, "A"), 2: ("merged", None, "B,C"), 3: ("new", None, "")}
    sims = spark.createDataFrame([(0, "A", 0.9), (1, "A", 0.95), (3, "B", 0.99)], "cluster int, topic string, cosine double")
    saved = {r.cluster: (r.event, r.topic) for r in partitions.rescue_by_content(m, sims, 0.8).collect()}
    assert saved[1] == ("kept", "A") and saved[0] == ("split", None) and saved[3] == ("new", None)


def test_core_streak_history(spark):
    runs = [(r, u, lab) for r in (1, 2, 3, 4) for u, lab in (("a", 0), ("b", 0), ("c", 0 if r > 2 else 5), ("d", -1))]
    core = partitions.co_cluster_core(spark.createDataFrame(runs, "run_id long, unit_id string, label int"), spark.createDataFrame([(u, "T") for u in "abcd"], "unit_id string, topic string"))
    assert rows(core) == [("T", "a"), ("T", "b")]
    ev = spark.createDataFrame([(1, "x", "kept"), (2, "x", "renamed"), (3, "x", "kept"), (4, "x", "kept"), (3, "y", "kept")], "run_id long, topic string, event string")
    assert rows(partitions.keeping_streak(ev)) == [("x", 2), ("y", 0)]
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "run_id long, partition_no long")
    comp = spark.createDataFrame([(1, "d1", "g", "m", 0.5, 0.01, False), (2, "d2", "g", "m", -0.5, 0.01, False), (3, "d3", "g", "m", 0.5, None, False)], "run_id long, run_at string, group_id string, metric string, effect_size double, p_value_holm double, insufficient_data boolean")
    assert rows(partitions.partition_history(parts, comp)) == [("g", "m", 1, 0, 1, 1, "d2")]


def test_ami(spark):
    def ami(data):
        return [r.ami for r in partitions.adjusted_mutual_information(spark.createDataFrame(data, "la int, lb int, n long")).collect()]

    assert ami([(0, 1, 5), (1, 0, 5)]) == [pytest.approx(1.0)] and ami([(3, 4, 9)]) == [1.0] and ami([]) == []
    assert abs(ami([(0, 0, 25), (0, 1, 25), (1, 0, 25), (1, 1, 25)])[0]) < 0.02
    k = np.array([0, 1, 7, 15, 16, 17, 300, 10**6])
    np.testing.assert_allclose(partitions._log_factorial(k), [math.lgamma(x + 1) for x in k], rtol=1e-14, atol=1e-13)


def test_normal_tail(spark):
    z = [0.0, 1e-9, -0.5, 1.96, 2.0, 2.5, -4.0, 6.5, 8.0, 12.0]
    out = spark.createDataFrame([(v,) for v in [*z, None]], "z double").select(metrics.normal_tail(F.col("z")).alias("p")).collect()
    np.testing.assert_allclose([r.p for r in out[:-1]], [math.erfc(abs(v) / math.sqrt(2)) for v in z], atol=4e-15)
    assert out[-1].p is None


def test_anchors_and_plans(spark):
    cur = [(u, 0) for u in "abc"] + [("d", -1), ("x", 1), ("y", 1), ("z", 1)]
    current = spark.createDataFrame(cur, "unit_id string, label int")
    members = spark.createDataFrame([(f"t{k}", u) for u, k in cur if k >= 0], "topic string, unit_id string")
    anchors = spark.createDataFrame([("t0", u) for u in "abd"] + [("t1", u) for u in "xabc"], "topic string, unit_id string")
    assert {r.topic: (r.overlap, r.n_cluster, r.n_anchor, r.holds) for r in partitions.anchor_holds(anchors, members, current).collect()} == {"t0": (2, 3, 2, True), "t1": (1, 3, 4, False)}
    near = spark.createDataFrame([("t1", 0.9)], "topic string, cosine double")
    assert all(r.holds for r in partitions.anchor_holds(anchors, members, current, near, 0.8).collect())
    m = spark.createDataFrame([(0, "kept", "t0"), (1, "split", None), (2, "kept", "t1"), (3, "new", None), (4, "kept", "t2")], "cluster int, event string, topic string")
    st = spark.createDataFrame([("t0", True), ("t1", True), ("t2", False)], "topic string, current boolean")
    plan = partitions.topic_plan(m, 7, st, spark.createDataFrame([(2,)], "cluster int"))
    assert {r.cluster: (r.topic_id, r.reason) for r in plan.collect()} == {0: ("t0", None), 1: ("topic_7", "split"), 2: ("t1", "drift"), 3: ("topic_8", "new"), 4: ("t2", "config_change")}
    events = {r.topic_id: r.event for r in partitions.topic_events(plan, spark.createDataFrame([("t0",), ("gone",)], "topic_id string")).collect()}
    assert events == {"t0": "kept", "topic_7": "split", "t1": "relabeled", "topic_8": "new", "t2": "relabeled", "gone": "retired"}


def test_placements_match_relative_effects():
    rng = np.random.default_rng(9)
    for na, nb, high in ((3, 9, 5), (9, 3, 5), (7, 90, 30), (90, 7, 10**9), (5, 5, 2)):
        a, b = np.sort(rng.integers(0, high, na).astype(float)), np.sort(rng.integers(0, high, nb).astype(float))
        places = significance.Placements(a, b)
        pooled, drawn = np.sort(np.concatenate([a, b])), np.concatenate([places.seen, places.draw(40, rng)])
        effect, se = places.statistic(drawn)
        for at, e, s in zip(drawn, effect, se):
            few = np.isin(np.arange(na + nb), at)
            x, y = (pooled[~few], pooled[few]) if places.swapped else (pooled[few], pooled[~few])
            assert (e, s) == pytest.approx(effect_of(x, y), abs=1e-12)
    seen = significance.Placements(np.arange(2.0), np.arange(2.0, 20)).draw(38_000, rng)
    counts = np.bincount(seen[:, 0] * 20 + seen[:, 1], minlength=400)
    assert (counts > 0).sum() == 190 and counts[counts > 0].min() > 120 and counts.max() < 290


def test_topic_comparisons_draws_100_000_permutations(spark, monkeypatch):
    from threadlake.plans import comparisons

    data = [("high" if i < 60 else None, "m", float(i % 7 + (9 if i < 55 else 0))) for i in range(300)]
    monkeypatch.setattr(comparisons, "_cells", lambda s, d: s.createDataFrame(data, "topic_id string, metric string, value double"))
    whole = comparisons.topic_comparisons(spark, "").collect()
    assert whole[0].p == pytest.approx(2 / 100_001)
    monkeypatch.setattr(significance, "DRAWN_PER_TASK", 5_000_000)
    assert comparisons.topic_comparisons(spark, "").collect() == whole  # drawn by several tasks


def test_large_comparisons_match_the_kernels(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = [(g, "m", float(v)) for g, v in zip(rng.choice(["x", "y", "z", None], 400, p=[0.5, 0.3, 0.01, 0.19]), rng.integers(0, 40, 400))] + [("x", "n", 1.0), ("x", "n", 2.0), ("y", "n", 3.0), ("y", "n", 4.0)]
    monkeypatch.setattr(significance, "KERNEL_VALUES", 3)
    df = spark.createDataFrame(data, "g string, metric string, v double")
    out = {(r.metric, r.group_id): r for r in significance.compare_groups(df, "g", "metric", "v").collect()}
    assert len(out) == len({(k, g) for g, k, _ in data if g})
    for (k, g), r in out.items():
        a, b = [v for h, q, v in data if h == g and q == k], [v for h, q, v in data if h != g and q == k]
        assert (r.median_group, r.median_rest, r.n_group, r.n_rest) == (np.median(a), np.median(b), len(a), len(b))
        want = significance.brunner_munzel_t(a, b)
        assert (want is None) == (r.method == "mann_whitney") and (want or k == "n")
        if want:
            assert [r.p, r.delta, r.delta_low, r.delta_high] == pytest.approx([want[c] for c in ("p", "delta", "delta_low", "delta_high")], abs=1e-9)
        low, high = significance.median_difference_interval(a, b, seed=zlib.crc32(f"{g}|{k}".encode()))
        assert (r.diff_low, r.diff_high) == (low, high)


def test_median_shift_keeps_large_topics(spark, monkeypatch):
    from threadlake.plans import comparisons, identity

    rng = np.random.default_rng(12)
    data = [(f"t{i % 3}", "engagement", float(v)) for i, v in enumerate(rng.integers(0, 9, 150))]
    centre = float(np.median([v for _, _, v in data]))
    data.append(("flat", "engagement", centre))
    monkeypatch.setattr(comparisons, "_cells", lambda s, d: s.createDataFrame(data, "topic_id string, metric string, value double"))
    monkeypatch.setattr(significance, "KERNEL_VALUES", 10)
    out = {r.topic_id: r for r in identity.median_shift(spark, "").collect()}
    assert set(out) == {"t0", "t1", "t2", "flat"}
    centre = float(np.median([v for _, _, v in data]))
    for g, r in out.items():
        own = [v for k, _, v in data if k == g]
        assert r.n == len(own) and r.p == pytest.approx(significance.wilcoxon_signed_rank(own, centre), nan_ok=True)
