import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from tests.oracle import compare
from threadlake.llm import clustering as C

UNIT = "id string, umap_x double, umap_y double, umap_z double, built_at int, cell string, cluster string"


def frame(spark, points):
    return spark.createDataFrame([(f"{i:05d}", *map(float, p), 1, "c", "c") for i, p in enumerate(points)], UNIT)


def brute(points, step=0.8, least=8):
    p = np.asarray(points, float)
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= step
    seen, out = set(), []
    for i in range(len(p)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in group:
                    group.add(int(j))
                    todo.append(int(j))
        seen |= group
        if len(group) >= least:
            first = min(group)
            out += [(f"{first:05d}", f"{j:05d}") for j in group if j != first]
    return sorted(out)


def blobs():
    rng = np.random.default_rng(5)
    dense = rng.normal(0, 0.25, (150, 3))
    bridge = np.column_stack([np.arange(1, 9) * 0.79 + 0.5, np.zeros(8), np.zeros(8)])
    broken = np.column_stack([np.arange(0, 12) * 0.8 + 30, np.zeros(12), np.zeros(12)])
    apart = np.column_stack([np.arange(0, 12) * 0.80001 + 60, np.zeros(12), np.zeros(12)])
    copies = np.tile([[5.0, 5.0, 5.0]], (20, 1))
    few = rng.normal(20, 0.1, (7, 3))
    spread = rng.uniform(-12, -4, (220, 3))
    return np.concatenate([dense, bridge, broken, apart, copies, few, spread])


def test_groups_equal_brute_force(spark):
    p = blobs()
    assert rows(C.found(frame(spark, p))) == brute(p)


def test_ambiguous_cells_are_refined(spark):
    rng = np.random.default_rng(6)
    # two dense clouds whose least distance lies around one step
    a, b = rng.uniform(0, 0.4, (60, 3)), rng.uniform(0, 0.4, (60, 3)) + [0.4 + 0.78, 0, 0]
    for shift in (0.0, 0.05, 0.1):
        p = np.concatenate([a, b + [shift, 0, 0]])
        assert rows(C.found(frame(spark, p))) == brute(p)


def test_squaring_by_joins_equals_squaring_in_one_task(spark, monkeypatch):
    """The distributed rounds and contractions give the groups of the local kernel, and flow decides them."""
    f = frame(spark, blobs())
    local = C.cluster_units(f).members
    one = {r.unit_id: (r.group, r.cluster) for r in local.collect()}
    monkeypatch.setattr(C, "LOCAL_LINKS", 0)
    monkeypatch.setitem(C.markov_levels.__kwdefaults__, "local_links", 0)
    many = {r.unit_id: (r.group, r.cluster) for r in C.cluster_units(f).members.collect()}

    def classes(x, k):
        out = {}
        for unit, names in x.items():
            out.setdefault(names[k], set()).add(unit)
        return {frozenset(v) for v in out.values()}

    assert classes(one, 0) == classes(many, 0)
    same = classes(one, 1) & classes(many, 1)
    assert len(same) >= 0.9 * len(classes(one, 1))


def test_groups_are_what_flow_brings_together(monkeypatch):
    """Without flow (every node its own cluster) nothing merges: the links alone decide nothing."""
    links = pa.RecordBatch.from_pydict({"a": ["a", "b", "d"], "b": ["b", "c", "e"], "s": [0.9, 0.8, 0.7], "m": [1.0] * 3, "n": [1.0] * 3})
    found = {r["node"]: r["part"] for b in C._local_levels(iter([links]), True) for r in b.to_pylist()}
    assert found == {"a": found["b"], "b": found["c"], "c": found["a"], "d": found["e"], "e": found["d"]} and found["a"] != found["d"]
    monkeypatch.setattr(C, "_settle", lambda col, row, v, n, *a: (np.arange(n), np.ones(n)))
    with pytest.raises(RuntimeError, match="do not merge"):
        list(C._local_levels(iter([links]), True))


def test_flow_of_two_cliques():
    a = [(i, j) for i in range(5) for j in range(i)] + [(i, j) for i in range(5, 10) for j in range(5, i)] + [(5, 4)]
    x, y = np.array(a).T
    own = np.arange(10)
    low, flow = C._settle(np.r_[x, y, own], np.r_[y, x, own], np.ones(2 * len(a) + 10), 10, 2.0, C.PRUNE, C.KEEP, C.ROUNDS)
    assert low[:5].tolist() == [low[0]] * 5 and low[5:].tolist() == [low[5]] * 5 and low[0] != low[5] and (flow > 0).all()
    unlike = np.arange(40)  # a path is cut into several clusters
    assert len(set(C._settle(np.r_[unlike[:-1], unlike[1:], unlike], np.r_[unlike[1:], unlike[:-1], unlike], np.ones(118), 40, 2.0, C.PRUNE, C.KEEP, C.ROUNDS)[0].tolist())) > 4


def test_messy_rows(spark):
    base = [(f"{i:02d}", 0.1 * i, 0.0, 0.0, 2, "x", "x") for i in range(8)]
    extra = [("00", 99.0, 0.0, 0.0, 1, "x", "x"), base[3], ("90", None, 0.0, 0.0, 1, "x", "x"), ("91", float("nan"), 0.0, 0.0, 1, "x", "x"), ("92", float("inf"), 0.0, 0.0, 1, "x", "x"), (None, 0.0, 0.0, 0.0, 1, "x", "x")]
    df = spark.createDataFrame(base + extra, UNIT)
    assert rows(C.found(df)) == [("00", f"{i:02d}") for i in range(1, 8)]
    assert C.found(df.limit(0)).count() == 0 and C.summaries(df.limit(0)).count() == 0


def test_summary_counts_everyone_and_flow_separates(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.normal(0, 0.3, (60, 3)) + [2.2, 0, 0], [[0.9, 0, 0], [1.4, 0, 0]]])
    s = C.summaries(frame(spark, p)).collect()
    assert sum(r.n_units for r in s) == len(p) and all(r.representatives.startswith('["') for r in s)
    assert sum(r.n_units >= 20 for r in s) >= 2  # the thin bridge does not make one cluster of two clouds


@pytest.mark.parametrize("name", ["p4_found"])
def test_query_equals_sql(spark, data, name):
    compare(C.queries()[name](spark, data), C.oracle_sql()[name], data)
