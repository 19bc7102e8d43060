"""Similarity clusters by Markov clustering on a graph of grid cells, repeated on the contracted graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from threadlake.plans.lineage import Stages
from threadlake.sources.tables import latest_units, table

STEP = 0.8
LEAST = 8
INFLATION = 2.0
#: Entries below this are pruned from the flow matrix; of the rest a squared column keeps the largest ``KEEP``.
PRUNE = 1e-3
KEEP = 32
#: Rounds after which an unsettled flow is an error, and how far a column may be from settled.
ROUNDS, SETTLED = 100, 1e-3
#: A graph of at most so many links is squared in one task (the matrix then fits it), a larger one by joins.
LOCAL_LINKS = 250_000
#: Products that one step of a local squaring holds.
PRODUCTS = 4_000_000
REPRESENTATIVES = 3
#: Each refinement cuts a box into 8 parts per axis.
REFINE = 8

AXES = ("x", "y", "z")
_LOW, _HIGH, _REP = [f"lo_{a}" for a in AXES], [f"hi_{a}" for a in AXES], [f"at_{a}" for a in AXES]


def _keys(side: float, level: int) -> list:
    """Grid coordinates of a point; scaling by a power of two is exact, so finer boxes nest in coarser ones."""
    return [F.floor(F.col(a) * F.lit(float(REFINE**level)) / F.lit(side)).cast("long").alias(f"k{level}{a}") for a in AXES]


def points_of(units: DataFrame) -> DataFrame:
    """unit_id, x, y, z of the latest rows whose coordinates are all there and finite."""
    at = latest_units(units, "id", "umap_x", "umap_y", "umap_z").select(F.col("id").alias("unit_id"), *[F.col(f"umap_{a}").cast("double").alias(a) for a in AXES])
    for a in AXES:
        at = at.filter(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < 1e12))
    return at


def _box_columns() -> list:
    first = F.min(F.struct(*AXES))
    return [
        *[F.min(a).alias(f"lo_{a}") for a in AXES],
        *[F.max(a).alias(f"hi_{a}") for a in AXES],
        *[first[a].alias(f"at_{a}") for a in AXES],
    ]


def _gap2(a: str, b: str):
    """Squared least distance of two boxes, squared greatest distance, squared distance of their sample points."""
    near, far, real = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for x in AXES:
        lo1, hi1, lo2, hi2 = (F.col(f"{p}.{q}_{x}") for p, q in ((a, "lo"), (a, "hi"), (b, "lo"), (b, "hi")))
        d = F.greatest(lo1 - hi2, lo2 - hi1, F.lit(0.0))
        e = F.greatest(hi1 - lo2, hi2 - lo1)
        r = F.col(f"{a}.at_{x}") - F.col(f"{b}.at_{x}")
        near, far, real = near + d * d, far + e * e, real + r * r
    return near, far, real


def _judged(pairs: DataFrame, step: float) -> DataFrame:
    """a_cell, b_cell, a (box), b (box) with ``link``: true, false, or null if the boxes alone cannot tell."""
    near, far, real = _gap2("a", "b")
    single = (F.col("a.lo_x") == F.col("a.hi_x")) & (F.col("a.lo_y") == F.col("a.hi_y")) & (F.col("a.lo_z") == F.col("a.hi_z"))
    for x in AXES:
        single = single & (F.col(f"b.lo_{x}") == F.col(f"b.hi_{x}"))
    # The sample points decide with the very comparison that defines a step; box bounds get a slack for rounding.
    slack = step * step * 1e-9
    return pairs.withColumn(
        "link", F.when(F.sqrt(real) <= step, True).when(near > step * step + slack, False).when(far < step * step - slack, True).when(single, False)
    )


_BOX = "struct<" + ",".join(f"{c}:double" for c in _LOW + _HIGH + _REP) + ">"
_PAIRS = f"a_cell string, b_cell string, a_box string, b_box string, a {_BOX}, b {_BOX}, link boolean"


def _parts_kernel(step: float):
    """Judges all parts of one box with all of another: a row with ``link`` if any two parts are surely linked, else a row
    for every two parts that their bounds leave open. The same comparisons as ``_judged``, on arrays."""
    slack = step * step * 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for c in ("a", "b"):
                lists = batch.column(c)
                size = np.diff(lists.offsets.to_numpy())
                subs, boxes = lists.flatten().flatten()
                fields = [np.stack([boxes.field(f).to_numpy() for f in names], 1) for names in (_LOW, _HIGH, _REP)]
                sides.append((size, np.cumsum(size) - size, subs, boxes, *fields))
            (na, sa, suba, boxa, loa, hia, ra), (nb, sb, subb, boxb, lob, hib, rb) = sides
            products = np.cumsum(na.astype(np.int64) * nb)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(products, (products[at - 1] if at else 0) + PRODUCTS // 4, "right")))
                k = (na[at:to] * nb[at:to]).astype(np.int64)
                pair = np.repeat(np.arange(at, to), k)
                q = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                i, j = sa[pair] + q // nb[pair], sb[pair] + q % nb[pair]
                at = to
                near = (np.maximum(np.maximum(loa[i] - hib[j], lob[j] - hia[i]), 0) ** 2).sum(1)
                far = (np.maximum(hia[i] - lob[j], hib[j] - loa[i]) ** 2).sum(1)
                d = ra[i] - rb[j]
                real = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
                single = (loa[i] == hia[i]).all(1) & (lob[j] == hib[j]).all(1)
                sure = (real <= step) | ((near <= step * step + slack) & (far < step * step - slack))
                linked = np.unique(pair[sure])
                open_ = np.flatnonzero(~sure & (near <= step * step + slack) & ~single & ~np.isin(pair, linked))
                rows = pa.array(np.concatenate([linked, pair[open_]]))
                x, y = pa.array([*[None] * len(linked), *i[open_].tolist()], pa.int64()), pa.array([*[None] * len(linked), *j[open_].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a_cell").take(rows), batch.column("b_cell").take(rows), suba.take(x), subb.take(y), boxa.take(x), boxb.take(y), pa.array([True] * len(linked) + [None] * len(open_), pa.bool_())],
                    names=["a_cell", "b_cell", "a_box", "b_box", "a", "b", "link"],
                )

    return run


def _linked_cells(points: DataFrame, cells: DataFrame, side: float, step: float, stages: Stages) -> DataFrame:
    """Pairs (a_cell < b_cell) of occupied cells that hold two points within one step.

    Only cells up to two apart per axis are paired (62 half offsets), by an equality join on the shifted grid coordinates.
    Boxes around the cells' points settle most pairs; the rest is refined into sub-boxes, of which a box has at most
    8 * 8 * 8 however many points it holds, until every pair is settled by bounds or by two actual points.
    """
    reach = range(-2, 3)
    offsets = [(i, j, k) for i in reach for j in reach for k in reach if (i, j, k) > (0, 0, 0)]
    box = [F.struct(*_LOW, *_HIGH, *_REP).alias("box")]
    base = cells.select("cell", "k0x", "k0y", "k0z", *box)
    shift = F.explode(F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"d{a}") for o, a in zip(off, AXES)]) for off in offsets])).alias("o")
    left = base.select(F.col("cell").alias("a_cell"), F.col("box").alias("a"), *[F.col(f"k0{x}") for x in AXES], shift)
    left = left.select("a_cell", "a", *[(F.col(f"k0{x}") + F.col(f"o.d{x}")).alias(f"k0{x}") for x in AXES])
    right = base.select(F.col("cell").alias("b_cell"), F.col("box").alias("b"), "k0x", "k0y", "k0z")
    judged = _judged(left.join(right, ["k0x", "k0y", "k0z"]).select("a_cell", "b_cell", "a", "b"), step).filter(F.col("link").isNull() | F.col("link"))
    judged = stages.keep(judged)
    found = [judged.filter("link").select("a_cell", "b_cell")]
    open_ = judged.filter("link is null").select("a_cell", "b_cell", F.col("a_cell").alias("a_box"), F.col("b_cell").alias("b_box"), "a", "b")
    inside = points.select("cell", F.col("cell").alias("box"), *AXES).distinct()
    level = 1
    while not open_.isEmpty():
        wanted = open_.select(F.col("a_box").alias("box")).union(open_.select(F.col("b_box").alias("box"))).distinct()
        inside = stages.keep(
            inside.join(wanted, "box", "left_semi").select("cell", "box", *AXES, F.concat_ws("/", "box", *_keys(side, level)).alias("sub"))
        )
        subs = stages.keep(inside.groupBy("box", "sub").agg(*_box_columns()).select("box", "sub", F.struct(*_LOW, *_HIGH, *_REP).alias("s")))
        pair = ["a_cell", "b_cell", "a_box", "b_box"]
        slack = step * step * (1 + 1e-9)

        # of each box only the parts within a step of the other box can matter: at most REFINE ** 3 a side
        def facing(box: str, other: str) -> DataFrame:
            parts = open_.join(subs.select(F.col("box").alias(f"{box}_box"), "sub", "s"), f"{box}_box").filter(_gap2("s", other)[0] <= slack)
            return parts.groupBy(*pair).agg(F.collect_list(F.struct("sub", "s")).alias(box))

        judged = facing("a", "b").join(facing("b", "a"), pair).select("a_cell", "b_cell", "a", "b").mapInArrow(_parts_kernel(step), _PAIRS)
        judged = stages.keep(judged)
        yes = judged.filter("link").select("a_cell", "b_cell").distinct()
        found.append(yes)
        open_ = stages.keep(judged.filter("link is null").drop("link").join(yes, ["a_cell", "b_cell"], "left_anti"))
        inside = inside.select("cell", F.col("sub").alias("box"), *AXES)
        level += 1
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    low, high = F.least("a_cell", "b_cell"), F.greatest("a_cell", "b_cell")
    return stages.keep(out.select(low.alias("a_cell"), high.alias("b_cell")).distinct())


def _pruned(col: np.ndarray, row: np.ndarray, v: np.ndarray, inflation: float, prune: float, keep: int | None):
    """Entries by column, inflated, small ones pruned, columns normalized; and how far each entry's column is from settled.

    ``row`` need only be comparable: of equal entries the smaller row stays."""
    n = int(col[-1]) + 1 if len(col) else 0
    v = v**inflation
    v = v / np.bincount(col, v, n)[col]
    ok = v >= prune
    order = np.lexsort((row, -v, col))
    size = np.bincount(col, minlength=n)
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
    ok = (ok | (rank == 0)) & ((rank < keep) if keep else True)
    col, row, v = col[ok], row[ok], v[ok]
    v = v / np.bincount(col, v, n)[col]
    top = np.zeros(n)
    np.maximum.at(top, col, v)
    return ok, v, (top - np.bincount(col, v * v, n))[col]


def _columns(rows: DataFrame, inflation: float, prune: float, keep: int | None) -> DataFrame:
    """(col, row, v, chaos) entries, summed per entry before, pruned by ``_pruned``. A column is one short list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, values = b.column("rows"), b.column("vals").flatten().to_numpy()
            names = lists.flatten()
            col = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            ok, v, chaos = _pruned(col, names.to_numpy(zero_copy_only=False).astype(str), values, inflation, prune, keep)
            yield pa.RecordBatch.from_arrays([b.column("col").take(pa.array(col[ok])), names.filter(pa.array(ok)), pa.array(v), pa.array(chaos)], names=["col", "row", "v", "chaos"])

    lists = rows.groupBy("col").agg(F.collect_list("row").alias("rows"), F.collect_list("v").alias("vals"))
    return lists.mapInArrow(run, "col string, row string, v double, chaos double")


def _settle(col: np.ndarray, row: np.ndarray, v: np.ndarray, n: int, inflation: float, prune: float, keep: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and flow of each of ``n`` nodes: squaring, inflation and pruning of a flow matrix until it settles.

    The strongest row of a column is its attractor; attractors of one cluster may point at each other: the smallest names it.
    """
    order = np.lexsort((row, col))
    col, row, v = col[order], row[order], v[order]
    ok, v, _ = _pruned(col, row, v, 1.0, prune, None)
    col, row = col[ok], row[ok]
    for _ in range(rounds):
        size = np.bincount(col, minlength=n)
        start = np.cumsum(size) - size
        cost = np.cumsum(size[row])
        parts, at = [], 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PRODUCTS, "right")))
            if to < len(col):  # whole columns
                to = max(int(start[col[to]]), int(start[col[at]] + size[col[at]]))
            k = size[row[at:to]]
            source = np.repeat(start[row[at:to]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            key, where = np.unique(np.repeat(col[at:to], k) * n + row[source], return_inverse=True)
            c, r = key // n, key % n
            w = np.bincount(where, np.repeat(v[at:to], k) * v[source])
            first = int(c[0])
            ok, w, chaos = _pruned(c - first, r, w, inflation, prune, keep)
            parts.append((c[ok], r[ok], w, chaos))
            at = to
        col, row, v, chaos = (np.concatenate(x) for x in zip(*parts))
        if chaos.max() <= SETTLED:
            break
    else:
        raise RuntimeError(f"the flow has not settled after {rounds} rounds")
    order = np.lexsort((row, np.round(-v, 9), col))
    lead = order[np.flatnonzero(np.r_[True, col[order][1:] != col[order][:-1]])]
    end, low = row[lead], np.minimum(np.arange(n), row[lead])
    for _ in range(max(1, int(n).bit_length())):
        low, end = np.minimum(low, low[end]), end[end]
    return low[end], v[lead]


def _unite(a: np.ndarray, b: np.ndarray, s: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between clusters (a < b) with the summed similarity of the links they hold."""
    x, y = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
    apart = x != y
    if not apart.any():
        return x[:0], y[:0], s[:0]
    key, where = np.unique(np.stack([x[apart], y[apart]], 1), axis=0, return_inverse=True)
    return key[:, 0], key[:, 1], np.bincount(where.ravel(), s[apart])


def _local_levels(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    """node, cluster, flow, part for the nodes of all links (a, b, s, m, n), which fit one task."""
    held = pa.Table.from_batches(list(batches))
    if not held.num_rows:
        return
    names, number = np.unique(np.concatenate([held["a"].to_numpy(zero_copy_only=False).astype(str), held["b"].to_numpy(zero_copy_only=False).astype(str)]), return_inverse=True)
    a, b = number[: held.num_rows], number[held.num_rows :]
    s, mass = held["s"].to_numpy(), np.ones(len(names))
    if weighted:
        mass[a], mass[b] = held["m"].to_numpy(), held["n"].to_numpy()
    own = np.arange(len(names))
    part, cluster, flow, inflation = own.copy(), None, None, INFLATION
    while len(a):
        nodes = np.unique(np.concatenate([a, b]))
        x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        if cluster is None and weighted:
            loop = np.sqrt(mass[nodes])
            into_a, into_b = s * np.sqrt(mass[a]), s * np.sqrt(mass[b])
        else:  # a contracted graph: staying weighs as much as the strongest way out
            loop, into_a, into_b = np.zeros(len(nodes)), s, s
            np.maximum.at(loop, x, s)
            np.maximum.at(loop, y, s)
        every = np.arange(len(nodes))
        low, f = _settle(np.concatenate([x, y, every]), np.concatenate([y, x, every]), np.concatenate([into_b, into_a, loop]), len(nodes), inflation, PRUNE, KEEP, ROUNDS)
        label = own.copy()
        label[nodes] = nodes[low]
        if cluster is None:
            cluster, flow = label.copy(), np.ones(len(names))
            flow[nodes] = f
        elif len(np.unique(low)) == len(nodes):
            if inflation < 1.01:
                raise RuntimeError("linked clusters do not merge")
            inflation = 1 + (inflation - 1) / 2  # weaker inflation lets flow reach further
        part = label[part]
        a, b, s = _unite(a, b, s, label)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[cluster]), pa.array(flow), pa.array(names[part])], names=["node", "cluster", "flow", "part"])


def _distributed_flow(links: DataFrame, weighted: bool, inflation: float, stages: Stages) -> DataFrame:
    """node, cluster, flow by squaring with joins. Expansion is one sparse join on the middle index whose products are summed
    map-side before the shuffle; pruning bounds a column, so a round costs at most KEEP * KEEP products a node."""
    into_a, into_b = (F.col("s") * F.sqrt("m"), F.col("s") * F.sqrt("n")) if weighted else (F.col("s"), F.col("s"))
    ways = links.select(F.col("a").alias("col"), F.col("b").alias("row"), into_b.alias("v")).union(links.select("b", "a", into_a))
    if weighted:
        own = links.select(F.col("a").alias("col"), F.sqrt("m").alias("v")).union(links.select("b", F.sqrt("n")))
    else:
        own = ways.select("col", "v")
    loops = own.groupBy("col").agg(F.max("v").alias("v")).select("col", F.col("col").alias("row"), "v")
    flow = stages.keep(_columns(ways.union(loops), 1.0, PRUNE, None))
    for _ in range(ROUNDS):
        left = flow.select(F.col("col").alias("mid"), "row", F.col("v").alias("v1"))
        right = flow.select("col", F.col("row").alias("mid"), F.col("v").alias("v2"))
        squared = right.join(left, "mid").groupBy("col", "row").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))
        seen = Observation()
        new = stages.keep(_columns(squared, inflation, PRUNE, KEEP).observe(seen, F.max("chaos").alias("chaos")))
        stages.drop(flow)
        flow = new
        if (seen.get["chaos"] or 0) <= SETTLED:
            break
    else:
        raise RuntimeError(f"the flow has not settled after {ROUNDS} rounds")
    best = F.max(F.struct(F.round("v", 9).alias("v"), F.col("row"))).alias("x")
    strongest = stages.keep(flow.groupBy("col").agg(best).select(F.col("col").alias("v"), F.col("x.row").alias("to"), F.col("x.v").alias("flow")))
    # several attractors of one cluster may point at each other: follow them to the smallest one
    names = connected(strongest.select(F.col("v").alias("a"), F.col("to").alias("b")).filter("a <> b"), strongest.select("v"), stages)
    return stages.keep(names.join(strongest, "v").select(F.col("v").alias("node"), F.col("label").alias("cluster"), "flow"))


def markov_levels(cells: DataFrame, links: DataFrame, stages: Stages, *, local_links: int = LOCAL_LINKS) -> DataFrame:
    """cell, cluster, flow, group: Markov clustering of the weighted cell graph, and what repeating it leads to.

    The flow matrix starts from Gaussian similarities of the cells' centres, weighted by the mass of the cell that flow
    enters, with a self loop per cell. Expansion (squaring), inflation and pruning alternate until every column has settled;
    the attractor rows define the clusters. Clusters between which links are left are contracted to nodes, linked by the sum
    of those links' similarities, and the flow runs again, until no link is left: a ``group`` is everything that flow brings
    together. A level that merges nothing is repeated with weaker inflation; a flow that does not settle is an error.
    """
    near = cells.select(F.col("cell").alias("a_cell"), F.struct(*AXES, "n").alias("p"))
    far = cells.select(F.col("cell").alias("b_cell"), F.struct(*AXES, "n").alias("q"))
    d2 = F.lit(0.0)
    for x in AXES:
        d2 = d2 + (F.col(f"p.{x}") - F.col(f"q.{x}")) * (F.col(f"p.{x}") - F.col(f"q.{x}"))
    alike = F.exp(-d2 / (2 * STEP * STEP / 4))
    left = stages.keep(
        links.join(near, "a_cell").join(far, "b_cell").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), alike.alias("s"), F.col("p.n").alias("m"), F.col("q.n").alias("n"))
    )
    count, inflation = left.count(), INFLATION
    out, weighted = None, True
    while count:
        if count <= local_links:
            level = left.repartition(1).mapInArrow(lambda batches, w=weighted: _local_levels(batches, w), "node string, cluster string, flow double, part string")
        else:
            level = _distributed_flow(left, weighted, inflation, stages).withColumn("part", F.col("cluster"))
        level = stages.keep(level)
        if out is None:
            out = level.select(F.col("node").alias("cell"), "cluster", "flow", F.col("part").alias("group"))
        else:
            out = out.join(level.select(F.col("node").alias("group"), "part"), "group", "left").select("cell", "cluster", "flow", F.coalesce("part", "group").alias("group"))
        if count <= local_links:
            break
        of = level.select("node", "part")
        between = (
            left.join(of.select(F.col("node").alias("a"), F.col("part").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("part").alias("y")), "b").filter("x <> y")
            .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s"), F.lit(1.0).alias("m"), F.lit(1.0).alias("n"))
        )
        left, before = stages.keep(between), count
        count, weighted = left.count(), False
        if count == before:
            if inflation < 1.01:
                raise RuntimeError("linked clusters do not merge")
            inflation = 1 + (inflation - 1) / 2
    alone = cells.select("cell", F.col("cell").alias("own"))
    if out is None:
        return alone.select("cell", F.col("own").alias("cluster"), F.lit(1.0).alias("flow"), F.col("own").alias("group"))
    return alone.join(out, "cell", "left").select("cell", F.coalesce("cluster", "own").alias("cluster"), F.coalesce("flow", F.lit(1.0)).alias("flow"), F.coalesce("group", "own").alias("group"))


def connected(edges: DataFrame, vertices: DataFrame, stages: Stages) -> DataFrame:
    """v, label: the smallest vertex reachable over the edges.

    Every round takes the smallest label among the neighbours (a map-side combined minimum) and then follows labels of
    labels, so long chains shrink by a factor each round; it ends when no label moves.
    """
    both = stages.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stages.keep(vertices.select("v", F.col("v").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "v", "left").select("v", "label", F.least("label", "heard").alias("new"))
        hop = labels.select(F.col("v").alias("new"), F.col("label").alias("onward"))
        moved = stages.keep(lower.join(hop, "new").select("v", "label", F.least("new", "onward").alias("new")))
        stages.drop(labels)
        labels = moved.select("v", F.col("new").alias("label"))
        if moved.filter("new <> label").isEmpty():
            return labels
        labels = stages.keep(labels)


class Clusters:
    """``members``: unit_id, x, y, z, cell, cluster, flow, group (what the clusters flow together to)."""

    def __init__(self, members: DataFrame):
        self.members = members


def cluster_units(units: DataFrame, *, step: float = STEP) -> Clusters:
    """Markov clusters of the units with coordinates, and the groups that they flow together to.

    Points of one grid cell (side step / sqrt 3) are surely within a step of each other and become one weighted node, so
    the graph grows with occupied space, not with rows: a cell with a third of all rows is one node. Cells that hold two
    points within a step are linked exactly (see ``_linked_cells``). Markov clustering cuts the graph into clusters and,
    repeated on the contracted graph, into groups between which no link is left (``markov_levels``).

    Per id the latest row counts; units with a null, NaN or infinite coordinate, or one beyond 1e12, take no part; equal
    coordinates are fine; an empty table gives empty results; other columns are ignored.
    """
    spark = units.sparkSession
    stages = Stages(spark, "clusters")
    side = step / 3**0.5 * (1 - 1e-9)
    at = stages.keep(points_of(units).select("unit_id", *AXES, *_keys(side, 0)))
    cells = stages.keep(
        at.groupBy("k0x", "k0y", "k0z").agg(F.min("unit_id").alias("cell"), F.count("*").cast("double").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in AXES], *_box_columns())
    )
    points = stages.keep(at.join(cells.select("k0x", "k0y", "k0z", "cell"), ["k0x", "k0y", "k0z"]).select("unit_id", *AXES, "cell"))
    links = _linked_cells(points, cells, side, step, stages)
    centres = cells.select("cell", "n", *[F.col(f"mean_{a}").alias(a) for a in AXES])
    return Clusters(points.join(markov_levels(centres, links, stages), "cell").select("unit_id", *AXES, "cell", "cluster", "flow", "group"))


def found(units: DataFrame, *, step: float = STEP, least: int = LEAST) -> DataFrame:
    """unit_a (smallest id of a group of at least ``least`` units), unit_b (each other member)."""
    members = Stages(units.sparkSession, "members").keep(cluster_units(units, step=step).members.select("unit_id", "group"))
    groups = members.groupBy("group").agg(F.min("unit_id").alias("unit_a"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return members.join(groups, "group").filter(F.col("unit_id") != F.col("unit_a")).select("unit_a", F.col("unit_id").alias("unit_b"))


def summaries(units: DataFrame, *, step: float = STEP, representatives: int = REPRESENTATIVES) -> DataFrame:
    """cluster (smallest unit id), n_units, representatives: the members with the strongest flow into the attractor, the
    nearer to the cluster's centre first, then by id. The best of 64 salted parts of a cluster are found before the whole."""
    members = Stages(units.sparkSession, "members").keep(cluster_units(units, step=step).members)
    centres = members.groupBy("cluster").agg(F.min("unit_id").alias("first_unit"), F.count("*").alias("n_units"), *[F.avg(a).alias(f"c_{a}") for a in AXES])
    d2 = sum(((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in AXES), F.lit(0.0))
    scored = members.join(centres, "cluster").select("first_unit", "n_units", "unit_id", (-F.col("flow")).alias("minus_flow"), d2.alias("d2"))
    cell = F.struct("minus_flow", "d2", "unit_id")
    salt = F.pmod(F.xxhash64("unit_id"), F.lit(64))
    part = Window.partitionBy("first_unit", "salt").orderBy("minus_flow", "d2", "unit_id")
    few = scored.withColumn("salt", salt).withColumn("k", F.row_number().over(part)).filter(F.col("k") <= representatives)
    return few.groupBy("first_unit", "n_units").agg(F.slice(F.array_sort(F.collect_list(cell)), 1, representatives).alias("r")).select(
        F.col("first_unit").alias("cluster"), "n_units", F.to_json("r.unit_id").alias("representatives")
    )


def queries() -> dict:
    return {
        "p4_found": lambda s, d: found(table(s, d, "content_units")),
        "p4_clusters": lambda s, d: summaries(table(s, d, "content_units")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
WITH RECURSIVE u AS (SELECT id, arg_max(struct_pack(x := umap_x, y := umap_y, z := umap_z), built_at) AS p FROM content_units GROUP BY id),
k AS (SELECT id, p.x AS x, p.y AS y, p.z AS z FROM u WHERE p.x IS NOT NULL AND p.y IS NOT NULL AND p.z IS NOT NULL),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.8),
r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT b AS id, min(a) AS unit_a FROM r GROUP BY b),
n AS (SELECT unit_a FROM g GROUP BY unit_a HAVING count(*) >= 8)
SELECT unit_a, id AS unit_b FROM g WHERE unit_a IN (SELECT unit_a FROM n) AND id <> unit_a"""
    }
