"""Density clustering of bounded point sets (hierarchical, leaf selection) and its validity index, as numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kernels hold all pairwise distances: larger groups are refused, not cut.
MOST_POINTS = 6_000
MIN_SIZE = 4


def _distances(x: np.ndarray) -> np.ndarray:
    if len(x) > MOST_POINTS:
        raise ValueError(f"{len(x)} points are too many for one kernel (at most {MOST_POINTS})")
    s = (x * x).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0))


def spanning_tree(d: np.ndarray) -> np.ndarray:
    """Edges (a, b, length) of a minimum spanning tree, by Prim's method on a full matrix."""
    n = len(d)
    inside, best, link, out = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (d[at] < best) & ~inside
        best[closer], link[closer] = d[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        out.append((link[at], at, best[at]))
    return np.array(out).reshape(-1, 3)


def leaf_clusters(x: np.ndarray, min_size: int = MIN_SIZE, neighbours: int | None = None) -> np.ndarray:
    """Labels of the leaves of the density hierarchy (-1: noise): mutual reachability, spanning tree, condensed tree.

    Walking the merges from the coarsest, a split counts only if both sides hold ``min_size`` points; a side without further
    counting splits is a leaf, and its points are those it holds when it comes into being.
    """
    n = len(x)
    labels = np.full(n, -1)
    if n < 2 * min_size:
        return labels
    d = _distances(np.asarray(x, float))
    core = np.sort(d, axis=1)[:, min(neighbours or min_size, n) - 1]
    tree = spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None])))
    children, size, top = {}, {i: 1 for i in range(n)}, list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    node = {i: i for i in range(n)}
    for k, (a, b, _) in enumerate(tree[np.argsort(tree[:, 2], kind="stable")]):
        ra, rb = find(int(a)), find(int(b))
        children[n + k] = (node[ra], node[rb])
        size[n + k] = size[node[ra]] + size[node[rb]]
        top[rb] = ra
        node[ra] = n + k
    todo, leaves = [(2 * n - 2, None)], []
    while todo:
        v, born = todo.pop()
        walk = v
        while walk >= n:
            a, b = children[walk]
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                todo += [(a, a), (b, b)]
                break
            if not big:
                if born is not None:
                    leaves.append(born)
                break
            walk = big[0]
        else:
            if born is not None and size[born] >= min_size:
                leaves.append(born)
    for c, v in enumerate(sorted(leaves)):
        stack = [v]
        while stack:
            u = stack.pop()
            if u < n:
                labels[u] = c
            else:
                stack += children[u]
    order = {c: k for k, c in enumerate(dict.fromkeys(labels[labels >= 0]))}
    return np.array([order.get(c, -1) for c in labels])


def validity(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Density-based validity (Moulavi et al. 2014): per cluster (separation - sparseness) / the greater, weighted by size over
    all points; None with under two clusters."""
    x, labels = np.asarray(x, float), np.asarray(labels)
    names = [c for c in np.unique(labels) if c >= 0 and (labels == c).sum() > 1]
    if len(names) < 2:
        return None
    d, dim = _distances(x), x.shape[1]
    parts, core = {}, np.zeros(len(x))
    for c in names:
        at = np.flatnonzero(labels == c)
        inner = d[np.ix_(at, at)]
        with np.errstate(divide="ignore"):
            p = np.where(inner > 0, inner, np.inf) ** -dim
        core[at] = np.maximum(p.sum(1) / (len(at) - 1), 1e-300) ** (-1 / dim)
        parts[c] = at
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    sparse = {c: spanning_tree(reach[np.ix_(at, at)])[:, 2].max() for c, at in parts.items()}
    total = 0.0
    for c, at in parts.items():
        apart = min(reach[np.ix_(at, o)].min() for k, o in parts.items() if k != c)
        total += len(at) / len(x) * (apart - sparse[c]) / max(apart, sparse[c], 1e-300)
    return float(total)


def cluster(points: DataFrame, group: str, min_size: int = MIN_SIZE) -> DataFrame:
    """group, unit_id, label, validity of points (group, unit_id, x, y, z), one kernel per group of at most ``MOST_POINTS``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit_id")
        x = pdf[["x", "y", "z"]].to_numpy(float)
        lab = leaf_clusters(x, min_size)
        return pd.DataFrame({group: pdf[group], "unit_id": pdf["unit_id"], "label": lab, "validity": validity(x, lab)})

    kind = dict(points.dtypes)[group]
    return points.select(group, "unit_id", "x", "y", "z").groupBy(group).applyInPandas(run, f"{group} {kind}, unit_id string, label int, validity double")


def principal_coordinates(vectors: DataFrame, key: str, vector: str, axes: int = 3) -> DataFrame:
    """key and coordinates on the first principal axes. The covariance is a sum over rows, one map-side partial per task, so only a
    dimension-by-dimension matrix leaves the executors; signs make the largest loading positive. A linear stand-in for
    neighbour embeddings, whose coordinates the tables hold ready-made."""
    from pyspark.sql.types import ArrayType, DoubleType

    def partial(frames):
        n, s, q = 0, 0.0, 0.0
        for pdf in frames:
            v = np.array(pdf["v"].tolist(), float)
            n, s, q = n + len(v), s + v.sum(0), q + v.T @ v
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast(ArrayType(DoubleType())).alias("v"))
    parts = rows.select("v").mapInPandas(partial, "n long, s array<double>, q array<double>").toPandas()
    if not len(parts):
        return rows.select(key, *[F.lit(None).cast("double").alias(a) for a in "xyz"[:axes]])
    n = parts["n"].sum()
    mean = np.sum([np.array(s) for s in parts["s"]], axis=0) / n
    cov = np.sum([np.array(q) for q in parts["q"]], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    w, u = np.linalg.eigh(cov)
    lead = u[:, ::-1][:, :axes]
    lead = lead * np.sign(lead[np.abs(lead).argmax(0), range(axes)])

    def project(axis):
        terms = F.zip_with("v", F.array(*[F.lit(float(x)) for x in lead[:, axis]]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(-float(mean @ lead[:, axis])), lambda a, b: a + b)

    return rows.select(key, *[project(i).alias(a) for i, a in zip(range(axes), "xyz")])
