"""The grid and the hierarchy on small fixtures, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from threadlake.operators import hierarchy, regular_grid

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 1, 1, tzinfo=UTC)
READ = "post_id string, fetched_at timestamp, views long, posted_at string"
POST = "id string, posted_at timestamp, views long"


def at(h):
    return T0 + dt.timedelta(hours=h)


def grid(spark, readings, posts):
    return regular_grid.regular_grid(spark.createDataFrame(readings, READ), spark.createDataFrame(posts, POST))


def test_grid_edge_cases(spark):
    posts = [("a", at(1), 9), ("a", None, None), ("b", at(0), 1), (None, at(0), 1), ("n", None, 1)]
    readings = [
        ("a", at(0), 500, "x"),  # before the post: no reading
        ("a", at(2), 10, "x"), ("a", at(2), 10, "x"), ("a", at(2), 12, "x"),  # repeated, tie
        ("a", at(26), 40, "x"),
        ("a", at(30), 0, "x"), ("a", at(31), None, "x"), ("a", None, 5, "x"), (None, at(3), 5, "x"),
        ("a", dt.datetime(2026, 7, 1, tzinfo=UTC), 99, "x"),
        ("zz", at(3), 5, "x"),  # unknown post
        ("b", at(5), 7, "x"),
        ("n", at(5), 7, "x"),  # no publishing time: no lower bound
    ]
    out = {(r.post_id, r.slot_no): (r.views, r.filled) for r in grid(spark, readings, posts).collect()}
    first = int(at(2).timestamp()) // 21600
    assert sorted(out) == [("a", first + k) for k in range(5)] + [("b", first), ("n", first)]
    assert out["a", first] == (12.0, False) and out["a", first + 4] == (40.0, False)
    assert [out["a", first + k][1] for k in (1, 2, 3)] == [True] * 3
    assert all(10 <= out["a", first + k][0] <= 45 for k in (1, 2, 3))


def test_grid_empty(spark):
    assert grid(spark, [], []).count() == 0
    assert grid(spark, [("a", at(1), 1, "")], []).count() == 0


def test_imputation_recovers_a_smooth_series():
    x = 100 * 1.01 ** np.arange(200) + 20 * np.sin(np.arange(200) / 5)
    gap = np.zeros(200, bool)
    gap[np.random.default_rng(1).choice(np.arange(1, 199), 60, replace=False)] = True
    known = np.where(gap, 0.0, x)
    out = regular_grid.impute(known.copy(), gap, np.array([0]), np.array([200]), 12, 3, 1e-4, 200)[0]
    linear = np.interp(np.arange(200), np.flatnonzero(~gap), x[~gap])
    assert (out[~gap] == x[~gap]).all()
    assert np.abs(out - x)[gap].mean() < 0.6 * np.abs(linear - x)[gap].mean()


def test_imputation_does_not_depend_on_company():
    rng = np.random.default_rng(2)
    series = [np.cumsum(rng.integers(1, 9, n)).astype(float) for n in (3, 7, 40, 41, 90)]
    gaps = [np.r_[False, rng.random(len(s) - 2) < 0.4, False] for s in series]
    n = np.array([len(s) for s in series])
    starts = np.cumsum(n) - n
    both, settled = regular_grid.impute(np.concatenate(series), np.concatenate(gaps), starts, n, 12, 2, 1e-3, 1000)
    assert settled.all()
    assert not regular_grid.impute(np.concatenate(series), np.concatenate(gaps), starts, n, 12, 2, 1e-3, 1)[1].all()
    for s, g, a, k in zip(series, gaps, starts, n):
        alone = regular_grid.impute(s.copy(), g, np.array([0]), np.array([k]), 12, 2, 1e-3, 1000)[0]
        np.testing.assert_allclose(both[a : a + k], alone)


TREE = "id string, replied_to_id string, root_post_id string, is_reply boolean, parent string, top string"


def brute(posts):
    par = {}
    for i, p, r, rep in posts:
        if i is not None:
            a = par.setdefault(i, [None, None, False])
            p, r = ((x or "").strip() or None for x in (p, r))
            par[i] = [a[0] or p, a[1] or r, a[2] or bool(rep)]
    out = set()
    for i, (p, r, rep) in par.items():
        seen, k = [i], i
        while par[k][0] in par and par[k][0] not in seen:
            k = par[k][0]
            seen.append(k)
        if par[k][0] in par:
            loop = seen[seen.index(par[k][0]) :]
            out.add((i, "cycle" if i in loop else "into_cycle", min(loop), -1))
        elif par[k][0] is not None or par[k][2]:
            out.add((i, "lost_parent", k, len(seen) - 1))
        elif not (r == k or (i == k and r is None)):
            out.add((i, "wrong_root", k, len(seen) - 1))
    return sorted(out)


def frame(spark, posts):
    return spark.createDataFrame([(*p, "p", "t") for p in posts], TREE)


def test_chains_on_random_forests(spark):
    rng = random.Random(3)
    ids = [f"{i:03d}" for i in range(160)]
    posts = []
    for k, i in enumerate(ids):
        p = rng.choice([None, "999", i, *[ids[k - 1]] * 6, rng.choice(ids), rng.choice(ids)])
        posts.append((i, f" {p}\t" if p and rng.random() < 0.2 else p, rng.choice([None, ids[0], rng.choice(ids)]), rng.choice([True, False, None])))
    posts += [(posts[5][0], None, None, None), posts[7], (None, ids[0], None, True)]
    assert rows(hierarchy.chain_findings(frame(spark, posts))) == brute(posts)


def test_long_chain_and_circle(spark):
    chain = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, "c0000", i > 0) for i in range(300)]
    circle = [(f"o{i:04d}", f"o{(i + 1) % 70:04d}", None, True) for i in range(70)] + [("o9000", "o0003", None, True)]
    found = rows(hierarchy.chain_findings(frame(spark, chain + circle)))
    assert found == sorted([(f"o{i:04d}", "cycle", "o0000", -1) for i in range(70)] + [("o9000", "into_cycle", "o0000", -1)])
    tree = {r.id: r for r in hierarchy.full_tree(frame(spark, chain)).collect()}
    assert tree["c0299"].path.split("/") == [f"c{i:04d}" for i in range(300)] and tree["c0000"].n_descendants == 299


def test_rows_of_a_deep_chain_grow_with_the_logarithm_of_its_depth(spark, monkeypatch):
    written = []
    keep = hierarchy.Stages.keep

    def counted(self, df):
        out = keep(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(hierarchy.Stages, "keep", counted)
    n = 100_000
    chain = spark.range(n).select(
        F.format_string("c%06d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("c%06d", F.col("id") - 1)).alias("replied_to_id"), F.lit("c000000").alias("root_post_id"), (F.col("id") > 0).alias("is_reply")
    )
    forest = hierarchy.build_forest(chain)
    assert forest.reached.agg(F.max("depth")).first()[0] == n - 1 and forest.reached.count() == n
    assert sum(written) <= n * 20


def test_descendants_and_empty(spark):
    posts = [("a", None, None, False), ("b", "a", "a", True), ("c", "b", "a", True)]
    assert rows(hierarchy.descendants(frame(spark, posts))) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    empty = frame(spark, [])
    assert hierarchy.chain_findings(empty).count() == hierarchy.descendants(empty).count() == hierarchy.full_tree(empty).count() == 0


@pytest.mark.parametrize("hot", [2000])
def test_hot_parent(spark, hot):
    posts = [("root", None, None, False)] + [(f"k{i:05d}", "root", "root", True) for i in range(hot)]
    assert hierarchy.build_forest(frame(spark, posts)).reached.filter("depth = 1").count() == hot
