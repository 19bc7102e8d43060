"""Percentiles of very large numeric columns: mergeable dyadic-tree counts (q-digests) with deterministic rank error."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.plans.lineage import Stages
from threadlake.sources.tables import table

#: The ordered universe has 2**BITS leaves: the leading bits of a double in order-preserving form.
BITS = 32
#: Greatest rank error as a share of a group's rows.
RANK_ERROR = 0.004
#: Values a task holds before it hands its digests on.
BUFFER = 2_000_000
#: A first merge joins the digests of so many groups of tasks before the last one.
SALTS = 16
STATS = (("iqr_low", 0.25), ("median", 0.5), ("iqr_high", 0.75))
#: A stored percentile may be off by so many percentiles.
TOLERANCE = 0.03
LEAST = 40


def leaves(values: np.ndarray) -> np.ndarray:
    """Order-preserving leaf numbers of doubles without NaN; -0.0 and 0.0 share a leaf."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def leaf_value(leaf: np.ndarray) -> np.ndarray:
    """The least-magnitude double of a leaf: within 2**-20 of every value in it."""
    ordered = np.asarray(leaf, np.int64).astype(np.uint64) << np.uint64(64 - BITS)
    top = np.uint64(1 << 63)
    bits = np.where(ordered >= top, ordered ^ top, ~ordered)
    return np.where(ordered >= top, bits.view(np.float64), (bits & ~np.uint64((1 << (64 - BITS)) - 1)).view(np.float64))


def compress(nodes: np.ndarray, counts: np.ndarray, rank_error: float) -> tuple[np.ndarray, np.ndarray]:
    """Adds equal nodes up and lifts light siblings into their parent, level by level from the leaves.

    Nodes are numbered like a heap: the root is 1, the leaves start at 2**BITS. A parent takes its children over while the
    three together weigh at most floor(n * rank_error / BITS); so any rank is off by at most BITS such weights.
    """
    nodes, inverse = np.unique(nodes, return_inverse=True)
    counts = np.bincount(inverse, counts).astype(np.int64) if len(nodes) else counts
    weight = int(counts.sum() * rank_error / BITS)
    if weight < 1:
        return nodes, counts
    depth = np.frexp(nodes.astype(np.float64))[1] - 1
    by_level = [(nodes[depth == d], counts[depth == d]) for d in range(BITS + 1)]
    for d in range(BITS, 0, -1):
        here, c = by_level[d]
        if not len(here):
            continue
        up, pc = by_level[d - 1]
        parents, inv = np.unique(here >> 1, return_inverse=True)
        total = np.bincount(inv, c).astype(np.int64)
        own = np.zeros(len(parents), np.int64)
        at = np.searchsorted(up, parents)
        hit = (at < len(up)) & (up[np.minimum(at, max(len(up) - 1, 0))] == parents) if len(up) else np.zeros(len(parents), bool)
        own[hit] = pc[at[hit]]
        lift = total + own <= weight
        stay = ~lift[inv]
        by_level[d] = (here[stay], c[stay])
        merged = np.concatenate([up, parents[lift]])
        sums = np.concatenate([pc, total[lift]])
        u, inv2 = np.unique(merged, return_inverse=True)
        by_level[d - 1] = (u, np.bincount(inv2, sums).astype(np.int64) if len(u) else sums)
    return np.concatenate([x for x, _ in by_level]), np.concatenate([x for _, x in by_level])


def spans(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf under each node."""
    up = BITS - (np.frexp(nodes.astype(np.float64))[1] - 1)
    low = (nodes << up) - (1 << BITS)
    return low, low + (np.int64(1) << up) - 1


class Ranks:
    """Sure bounds on counts and order statistics of one digest."""

    def __init__(self, nodes: np.ndarray, counts: np.ndarray):
        low, high = spans(nodes)
        a, b = np.argsort(low), np.argsort(high)
        self.low, self.high = low[a], high[b]
        self.by_low, self.by_high = np.cumsum(counts[a]), np.cumsum(counts[b])
        self.n = int(counts.sum())

    def surely_below(self, leaf: int) -> int:
        """At least so many values lie in lower leaves."""
        i = np.searchsorted(self.high, leaf, "left")
        return int(self.by_high[i - 1]) if i else 0

    def at_most(self, leaf: int) -> int:
        """At most so many values lie in this or lower leaves."""
        i = np.searchsorted(self.low, leaf, "right")
        return int(self.by_low[i - 1]) if i else 0

    def leaf_range(self, rank: int) -> tuple[int, int]:
        """Leaves between which the value of that 0-based rank lies."""
        i, j = np.searchsorted(self.by_low, rank + 1), np.searchsorted(self.by_high, rank + 1)
        return int(self.low[i]), int(self.high[j])

    def quantile_leaf(self, q: float) -> int:
        return self.leaf_range(int(round(q * (self.n - 1))))[1]


def _local(keys: int, rank_error: float):
    """Per task: rows of (keys..., value) into digest nodes (keys..., node, weight)."""

    def flush(held):
        for key, parts in held.items():
            n, c = compress(leaves(np.concatenate(parts)) + (1 << BITS), np.ones(sum(map(len, parts)), np.int64), rank_error)
            yield key, n, c

    def emit(held, names):
        found = list(flush(held))
        if found:
            size = [len(n) for _, n, _ in found]
            cols = [pa.array(np.repeat(np.array([k[i] for k, _, _ in found], object), size), pa.string()) for i in range(keys)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([n for _, n, _ in found])), pa.array(np.concatenate([c for _, _, c in found]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = defaultdict(list), 0
        for b in batches:
            names = [*b.schema.names[:keys], "node", "weight"]
            pdf = b.to_pandas()
            for key, part in pdf.groupby(list(pdf.columns[:keys]), sort=False)[pdf.columns[keys]]:
                held[key].append(part.to_numpy(np.float64))
            rows += b.num_rows
            if rows >= BUFFER:
                yield from emit(held, names)
                held, rows = defaultdict(list), 0
        if rows:
            yield from emit(held, names)

    return run


def _recompress(keys: int, rank_error: float):
    """Rows of (keys..., nodes list, weights list): each list compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, weights, n_out, w_out = b.column(keys), b.column(keys + 1), [], []
            for i in range(b.num_rows):
                n, w = compress(nodes[i].values.to_numpy(), weights[i].values.to_numpy(), rank_error)
                n_out.append(n)
                w_out.append(w)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.array(n_out, kind), pa.array(w_out, kind)], names=b.schema.names)

    return run


def merge(nodes: DataFrame, keys: list[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """Digest nodes (keys..., node, weight) of any number of digests into one digest per key: keys..., nodes, weights.

    Merging is node addition. Equal nodes are summed map-side first. The sums are compressed in two steps, first per key
    and salt, then per key, so that no task gathers the digests of all tasks of a hot key at once; a compressed digest has
    at most 3 * BITS / rank_error nodes, however many rows it stands for.
    """
    schema = ", ".join(f"{k} string" for k in keys)
    added = nodes.groupBy(*keys, "node").agg(F.sum("weight").alias("weight"))
    salted = added.groupBy(*keys, F.pmod(F.col("node"), F.lit(SALTS)).cast("string").alias("_salt")).agg(
        F.collect_list("node").alias("nodes"), F.collect_list("weight").alias("weights")
    )
    first = salted.mapInArrow(_recompress(len(keys) + 1, rank_error / 2), f"{schema}, _salt string, nodes array<long>, weights array<long>")
    flat = first.select(*keys, F.explode(F.arrays_zip("nodes", "weights")).alias("x")).groupBy(*keys).agg(
        F.collect_list("x.nodes").alias("nodes"), F.collect_list("x.weights").alias("weights")
    )
    return flat.mapInArrow(_recompress(len(keys), rank_error), f"{schema}, nodes array<long>, weights array<long>")


def digest(rows: DataFrame, keys: list[str], value: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """One q-digest per key (string columns) over ``value``; null and NaN values and rows with a null key are left out.

    Every task digests its own rows, so what is shuffled grows with the digests, not with the rows of a hot key.
    """
    usable = rows.select(*keys, F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    for k in keys:
        usable = usable.filter(F.col(k).isNotNull())
    schema = ", ".join(f"{k} string" for k in keys) + ", node long, weight long"
    return merge(usable.mapInArrow(_local(len(keys), rank_error / 2), schema), keys, rank_error)


def with_all_months(months: DataFrame, rank_error: float = RANK_ERROR) -> DataFrame:
    """Digests per (group_id, bucket_key), and by node addition over the months one per group as bucket ``all``."""
    months = Stages(months.sparkSession, "digests").keep(months)
    nodes = months.select("group_id", F.explode(F.arrays_zip("nodes", "weights")).alias("x")).select(
        "group_id", F.lit("all").alias("bucket_key"), F.col("x.nodes").alias("node"), F.col("x.weights").alias("weight")
    )
    return months.unionByName(merge(nodes, ["group_id", "bucket_key"], rank_error))


def countable(metrics: DataFrame) -> DataFrame:
    """group_id, bucket_key (month), value: one row per unit and day with views over 0 and a rate neither null nor NaN.

    Repeated rows of a unit and day count once: the greatest countable rate, with its topic. Rows without topic, unit or day are left out.
    """
    good = metrics.select(
        "unit_id", "measured_on", F.col("topic_id").alias("group_id"), F.col("popularity_index").alias("views"), F.col("engagement_rate").cast("double").alias("value")
    ).filter((F.col("views") > 0) & F.col("value").isNotNull() & ~F.isnan("value") & F.col("unit_id").isNotNull() & F.col("measured_on").isNotNull() & F.col("group_id").isNotNull())
    once = good.groupBy("unit_id", "measured_on").agg(F.max(F.struct("value", "group_id")).alias("x"))
    return once.select(F.col("x.group_id").alias("group_id"), F.date_format("measured_on", "yyyy-MM").alias("bucket_key"), F.col("x.value").alias("value"))


def _quantiles(points):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                r = Ranks(b.column("nodes")[i].values.to_numpy(), b.column("weights")[i].values.to_numpy())
                rows.append([r.n, *[float(leaf_value(np.array([r.quantile_leaf(q)]))[0]) for _, q in points]])
            cols = list(zip(*rows)) or [()] * (len(points) + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("group_id"), b.column("bucket_key"), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]],
                names=["group_id", "bucket_key", "n", *[s for s, _ in points]],
            )

    return run


def group_percentiles(metrics: DataFrame, rank_error: float = RANK_ERROR) -> DataFrame:
    """group_id, bucket_key, n, iqr_low, median, iqr_high per topic and month, and combined from the months as ``all``.

    Each value's rank is within ``rank_error`` of the wanted one, and the value within 2**-20 of a value of that rank.
    """
    all_ = with_all_months(digest(countable(metrics), ["group_id", "bucket_key"], "value", rank_error), rank_error)
    return all_.mapInArrow(_quantiles(STATS), "group_id string, bucket_key string, n long, iqr_low double, median double, iqr_high double")


def _judge(tolerance: float, least: int):
    """Stored values against the sure bounds of their digest: verdict yes, no, or unsure with what an exact count needs."""
    points = dict(STATS)

    def verdict(r: Ranks, stat: str, v: float):
        leaf = int(leaves(np.array([v]))[0])
        below, upto = (r.surely_below(leaf), r.at_most(leaf))
        unsure = False
        h = (r.n - 1) * max(points[stat] - tolerance, 0.0)
        f, c = int(np.floor(h)), int(np.ceil(h))
        if upto <= f:
            return "yes"
        unsure |= below < c + 1
        h = (r.n - 1) * min(points[stat] + tolerance, 1.0)
        f, c = int(np.floor(h)), int(np.ceil(h))
        if below >= c + 1:
            return "yes"
        unsure |= upto > f
        return "unsure" if unsure else "no"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = defaultdict(list)
            for g, k, stored, nodes, weights in zip(*[b.column(c) for c in ("group_id", "bucket_key", "stored", "nodes", "weights")]):
                r = Ranks(nodes.values.to_numpy(), weights.values.to_numpy())
                if r.n < least:
                    continue
                for s in stored.as_py():
                    if (y := verdict(r, s["stat"], s["v"])) != "no":
                        for name, x in zip(("group_id", "bucket_key", "stat", "v", "n", "verdict"), (g.as_py(), k.as_py(), s["stat"], s["v"], r.n, y)):
                            out[name].append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string())
            names = ["group_id", "bucket_key", "stat", "v", "n", "verdict"]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds)], names=names)

    return run


def wrong_statistics(metrics: DataFrame, stored: DataFrame, *, rank_error: float = RANK_ERROR, tolerance: float = TOLERANCE, least: int = LEAST) -> DataFrame:
    """group_id, bucket_key, stat of stored quartiles and medians outside the tolerated percentile band of their group.

    The digests of ``digest`` and ``with_all_months`` bound every rank surely, which settles almost all stored values. For
    those whose band edge lies within the bounds an exact check follows: counts and neighbours of the stored value among
    the group's values, as plain map-side combined aggregates.

    Groups with under ``least`` countable values, stored nulls and NaNs, and groups without values give no rows. Repeated
    stored rows count once. Empty tables give an empty result; other columns are ignored.
    """
    values = countable(metrics)
    digests = with_all_months(digest(values, ["group_id", "bucket_key"], "value", rank_error), rank_error)
    names = [s for s, _ in STATS]
    wide = stored.select("group_id", "bucket_key", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in names])).alias("x"))
    kept = wide.filter(F.col("x.v").isNotNull() & ~F.isnan("x.v") & F.col("group_id").isNotNull() & F.col("bucket_key").isNotNull())
    lists = kept.groupBy("group_id", "bucket_key").agg(F.collect_set("x").alias("stored"))
    judged = digests.join(lists, ["group_id", "bucket_key"]).mapInArrow(
        _judge(tolerance, least), "group_id string, bucket_key string, stat string, v double, n long, verdict string"
    )
    judged = Stages(metrics.sparkSession, "judged").keep(judged)
    sure = judged.filter("verdict = 'yes'").select("group_id", "bucket_key", "stat")
    if judged.filter("verdict = 'unsure'").isEmpty():
        return sure.distinct()
    point = F.element_at(F.create_map(*[F.lit(x) for s, q in STATS for x in (s, q)]), F.col("stat"))
    unsure = judged.filter("verdict = 'unsure'").withColumns({"lo": (F.col("n") - 1) * (point - tolerance), "hi": (F.col("n") - 1) * (point + tolerance)})
    salted = unsure.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = values.withColumn("bucket_key", F.explode(F.array("bucket_key", F.lit("all")))).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    key = ["group_id", "bucket_key", "stat", "v"]
    x, v = F.col("value"), F.col("v")
    counted = both.join(salted, ["group_id", "bucket_key", "salt"]).groupBy(*key).agg(
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
        F.count(F.when(x <= v, 1)).alias("le"),
        F.count(F.when(x < v, 1)).alias("lt"),
        F.max(F.when(x <= v, x)).alias("last_le"),
        F.min(F.when(x > v, x)).alias("next_gt"),
        F.max(F.when(x < v, x)).alias("last_lt"),
        F.min(F.when(x >= v, x)).alias("next_ge"),
    )

    def between(h, a, b):
        return a + (h - F.floor(h)) * (b - a)

    lo, hi = F.col("lo"), F.col("hi")
    low_case = (F.col("le") <= F.floor(lo)) | ((F.col("le") == F.floor(lo) + 1) & (F.ceil(lo) > F.floor(lo)) & (v < between(lo, F.col("last_le"), F.col("next_gt"))))
    high_case = (F.col("lt") >= F.ceil(hi) + 1) | ((F.col("lt") == F.floor(hi) + 1) & (F.ceil(hi) > F.floor(hi)) & (v > between(hi, F.col("last_lt"), F.col("next_ge"))))
    exact = counted.filter(F.coalesce(low_case, F.lit(False)) | F.coalesce(high_case, F.lit(False)))
    return sure.unionByName(exact.select("group_id", "bucket_key", "stat")).distinct()


def queries() -> dict:
    return {
        "p6_found": lambda s, d: wrong_statistics(table(s, d, "unit_metrics"), table(s, d, "distribution_stats")),
        "p6_percentiles": lambda s, d: group_percentiles(table(s, d, "unit_metrics")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
WITH m AS (SELECT unit_id, measured_on, max(engagement_rate) AS v, max(topic_id) AS topic_id FROM unit_metrics
           WHERE popularity_index > 0 AND engagement_rate IS NOT NULL AND NOT isnan(engagement_rate) AND topic_id IS NOT NULL GROUP BY unit_id, measured_on),
g AS (SELECT topic_id AS group_id, strftime(measured_on, '%Y-%m') AS bucket_key, v FROM m UNION ALL SELECT topic_id, 'all', v FROM m),
q AS (SELECT group_id, bucket_key, quantile_cont(v, [0.22, 0.28, 0.47, 0.53, 0.72, 0.78]) AS b FROM g GROUP BY ALL HAVING count(*) >= 40),
s AS (SELECT DISTINCT group_id, bucket_key, unnest([{'stat': 'iqr_low', 'v': iqr_low, 'k': 1}, {'stat': 'median', 'v': median, 'k': 3}, {'stat': 'iqr_high', 'v': iqr_high, 'k': 5}]) AS x FROM distribution_stats)
SELECT DISTINCT group_id, bucket_key, x.stat AS stat FROM s JOIN q USING (group_id, bucket_key) WHERE x.v < b[x.k] OR x.v > b[x.k + 1]"""
    }
