"""Comparing labelled partitions: agreement, transitions, identity of clusters over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.plans.lineage import Stages

NOISE = -1


def _pairs(c):
    return c * (c - 1) / 2.0


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """la, lb, n over the units of both partitions (unit_id, label)."""
    return a.select("unit_id", F.col("label").alias("la")).join(b.select("unit_id", F.col("label").alias("lb")), "unit_id").groupBy("la", "lb").agg(F.count("*").alias("n"))


def adjusted_rand(runs: DataFrame) -> DataFrame:
    """run_a, run_b, n, ari of every run and the one before it; noise is a class of its own; degenerate pairs give 1.

    ``runs``: run_id, unit_id, label. All from the contingency table: one equi-join on the unit, then closed form.
    """
    order = runs.select("run_id").distinct().withColumn("next", F.lead("run_id").over(Window.orderBy("run_id")))  # one row per run
    a = runs.join(F.broadcast(order.filter("next is not null")), "run_id").select(F.col("run_id").alias("run_a"), F.col("next").alias("run_b"), "unit_id", F.col("label").alias("la"))
    b = runs.select(F.col("run_id").alias("run_b"), "unit_id", F.col("label").alias("lb"))
    cells = a.join(b, ["run_b", "unit_id"]).groupBy("run_a", "run_b", "la", "lb").agg(F.count("*").alias("n"))
    return rand_of_cells(cells)


def rand_of_cells(cells: DataFrame) -> DataFrame:
    """run_a, run_b, n, ari of contingency tables (run_a, run_b, la, lb, n)."""
    keys = ["run_a", "run_b"]
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("s"))
    for side in ("la", "lb"):
        sums = cells.groupBy(*keys, side).agg(F.sum("n").alias("k")).groupBy(*keys).agg(F.sum(_pairs(F.col("k"))).alias(f"s_{side}"))
        total = total.join(sums, keys)
    expected = F.col("s_la") * F.col("s_lb") / _pairs(F.col("n"))
    most = (F.col("s_la") + F.col("s_lb")) / 2
    ari = F.when((F.col("n") < 2) | (most == expected), 1.0).otherwise((F.col("s") - expected) / (most - expected))
    return total.select(*keys, "n", ari.alias("ari"))


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! by Stirling's series from 16 on, from a table below."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 16)))])
    x = np.maximum(k, 16).astype(float)
    series = (x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(k < 16, small[np.minimum(k, 15)], series)


def _expected_share(a: int, b: int, n: int, step: int = 1_000_000) -> float:
    """What a pair of clusters of a and b of n units adds to the mutual information expected by chance (hypergeometric)."""
    total, first, last = 0.0, max(1, a + b - n), min(a, b)
    fixed = float(np.sum(_log_factorial(np.array([a, b, n - a, n - b]))) - _log_factorial(np.array([n]))[0])
    for low in range(first, last + 1, step):
        k = np.arange(low, min(low + step, last + 1))
        log_p = fixed - _log_factorial(k) - _log_factorial(a - k) - _log_factorial(b - k) - _log_factorial(n - a - b + k)
        total += float((k / n * np.log(n * k / (a * b)) * np.exp(log_p)).sum())
    return total


def adjusted_mutual_information(cells: DataFrame) -> DataFrame:
    """One row ``ami``: mutual information of a contingency table (la, lb, n) over that expected by chance, with the arithmetic
    mean of the entropies as norm; no row for an empty table, 1 for two trivial partitions.

    Sums over clusters run in Spark; the expectation is taken per pair of distinct cluster sizes, spread over tasks.
    """
    rows, cols = cells.groupBy("la").agg(F.sum("n").alias("a")), cells.groupBy("lb").agg(F.sum("n").alias("b"))
    size = cells.agg(F.sum("n").cast("long").alias("t"), F.countDistinct("la").alias("r"), F.countDistinct("lb").alias("c"))
    one = F.broadcast(size)  # one row
    plain = F.col("n") / F.col("t") * F.log(F.col("t") * F.col("n") / (F.col("a") * F.col("b")))
    mi = cells.join(rows, "la").join(cols, "lb").crossJoin(one).agg(F.sum(plain).alias("mi"))
    entropy = [t.crossJoin(one).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(f"h_{c}")) for t, c in ((rows, "a"), (cols, "b"))]
    pairs = rows.groupBy("a").agg(F.count("*").alias("ka")).crossJoin(F.broadcast(cols.groupBy("b").agg(F.count("*").alias("kb")))).crossJoin(one)

    def expect(frames):
        for pdf in frames:
            yield pd.DataFrame({"e": [ka * kb * _expected_share(int(a), int(b), int(n)) for a, b, ka, kb, n in zip(pdf["a"], pdf["b"], pdf["ka"], pdf["kb"], pdf["t"])]}, dtype=float)

    spread = pairs.select("a", "b", "ka", "kb", "t").repartition(4 * cells.sparkSession.sparkContext.defaultParallelism, "a", "b")
    e = spread.mapInPandas(expect, "e double").agg(F.sum("e").alias("e"))
    j = size.filter("t > 0").crossJoin(mi).crossJoin(entropy[0]).crossJoin(entropy[1]).crossJoin(e)
    trivial = ((F.col("r") == 1) & (F.col("c") == 1)) | ((F.col("r") == F.col("t")) & (F.col("c") == F.col("t")))
    gap = (F.col("h_a") + F.col("h_b")) / 2 - F.col("e")
    return j.select(F.when(trivial | (F.abs(gap) < 1e-12), 1.0).otherwise((F.col("mi") - F.col("e")) / gap).alias("ami"))


def transitions(runs: DataFrame) -> DataFrame:
    """run_a, run_b and the units clustered or noise in either run, and those new in the later one."""
    order = runs.select("run_id").distinct().withColumn("next", F.lead("run_id").over(Window.orderBy("run_id"))).filter("next is not null")
    a = runs.join(F.broadcast(order), "run_id").select(F.col("run_id").alias("run_a"), F.col("next").alias("run_b"), "unit_id", (F.col("label") != NOISE).alias("a"))
    b = runs.join(F.broadcast(order.select(F.col("next").alias("run_id"), F.col("run_id").alias("run_a"))), "run_id").select("run_a", F.col("run_id").alias("run_b"), "unit_id", (F.col("label") != NOISE).alias("b"))
    j = a.join(b, ["run_a", "run_b", "unit_id"], "full")
    ca, cb = F.col("a"), F.col("b")
    return j.groupBy("run_a", "run_b").agg(
        F.count_if(ca & cb).alias("stayed"), F.count_if(ca & ~cb).alias("to_noise"), F.count_if(~ca & cb).alias("from_noise"), F.count_if(~ca & ~cb).alias("stayed_noise"), F.count_if(ca.isNull()).alias("new_units")
    )


def distinct_partitions(runs: DataFrame) -> DataFrame:
    """run_id, partition_no, first_run: consecutive runs with identical label maps are one partition (A, B, A are three).

    A run's map enters as a commutative checksum pair of its (unit, label) rows, so no run is gathered anywhere.
    """
    h = F.xxhash64("unit_id", "label")
    prints = runs.groupBy("run_id").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    w = Window.orderBy("run_id")  # one row per run
    same = (F.lag("n").over(w) == F.col("n")) & (F.lag("x").over(w) == F.col("x")) & (F.lag("s").over(w) == F.col("s"))
    out = prints.select("run_id", F.coalesce(same, F.lit(False)).alias("same")).withColumn("partition_no", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("run_id", "partition_no", F.min("run_id").over(Window.partitionBy("partition_no")).alias("first_run"))


def same_partition(cells: DataFrame) -> DataFrame:
    """One row: whether a contingency table is a bijection of labels that keeps noise."""
    one = cells.agg((F.count_distinct("la") == F.count("*")).alias("a"), (F.count_distinct("lb") == F.count("*")).alias("b"), F.coalesce(F.bool_and((F.col("la") == NOISE) == (F.col("lb") == NOISE)), F.lit(True)).alias("noise"))
    return one.select((F.col("a") & F.col("b") & F.col("noise")).alias("same"))


def match_clusters(previous: DataFrame, current: DataFrame) -> DataFrame:
    """cluster, event (kept, merged, split, new), topic: identity of new clusters by two-way strict majority.

    ``previous``: unit_id, topic; ``current``: unit_id, label. Keeping ignores an old topic's units that became noise, merging
    counts them. Overlaps come from one equi-join on the unit; sets are never compared pairwise.
    """
    cur = current.select("unit_id", "label")
    old = previous.select("unit_id", "topic").join(cur, "unit_id")  # members that are still there
    size_new = cur.filter(F.col("label") != NOISE).groupBy("label").agg(F.count("*").alias("cm"))
    size_old = old.groupBy("topic").agg(F.count("*").alias("pm"), F.count_if(F.col("label") != NOISE).alias("pc"))
    o = old.filter(F.col("label") != NOISE).groupBy("topic", "label").agg(F.count("*").alias("k")).join(size_new, "label").join(size_old, "topic")
    o = o.select("topic", "label", (2 * F.col("k") > F.col("cm")).alias("child"), (2 * F.col("k") > F.col("pc")).alias("keeps"), (2 * F.col("k") > F.col("pm")).alias("merges"))
    per = o.groupBy("label").agg(
        F.max(F.when(F.col("child"), F.col("topic"))).alias("src"),
        F.count_if(F.col("merges")).alias("parents"),
        F.bool_or(F.col("child") & F.col("keeps")).alias("two_way"),
        F.max(F.when(F.col("merges"), F.col("topic"))).alias("only_parent"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("merges"), F.col("topic")))), ",").alias("merged_from"),
    )
    per = size_new.select("label").join(per, "label", "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    kept = F.coalesce(F.col("two_way"), F.lit(False)) & ((F.col("parents") == 0) | ((F.col("parents") == 1) & (F.col("only_parent") == F.col("src"))))
    per = per.withColumn("kept", kept)
    kids = per.filter("src is not null").groupBy("src").agg(F.count("*").alias("children"), F.bool_or("kept").alias("any_kept")).withColumnRenamed("src", "_src")
    j = per.join(kids, F.col("src") == F.col("_src"), "left")
    event = F.when(F.col("parents") >= 2, "merged").when(F.col("kept"), "kept").when((F.col("children") >= 2) & ~F.col("any_kept"), "split").otherwise("new")
    j = j.withColumn("event", event)
    return j.select(F.col("label").alias("cluster"), "event", F.when(F.col("event") == "kept", F.col("src")).alias("topic"), F.when(F.col("event") == "merged", F.col("merged_from")).otherwise(F.coalesce("src", F.lit(""))).alias("sources"))


def rescue_by_content(matches: DataFrame, similarities: DataFrame, reference: float) -> DataFrame:
    """Matches in which new and split clusters may take a free old topic whose centroid is nearer than ``reference``.

    ``similarities``: cluster, topic, cosine. The pairs above the reference are given best first, each cluster and topic once. Topics that were kept or merged elsewhere are not free.
    """
    takers = matches.filter(F.col("event").isin("new", "split")).select("cluster")
    kept = matches.filter("event = 'kept'").select("topic").union(matches.filter("event = 'merged'").select(F.explode(F.split("sources", ",")).alias("topic")))
    free = similarities.filter(F.col("cosine") > reference).join(takers, "cluster").join(kept.distinct(), "topic", "left_anti").select("cluster", "topic", "cosine")
    # pairs that are the best of both sides are settled together; what touches them goes, until no pair is left
    stages = Stages(matches.sparkSession, "rescue")
    free, given = stages.keep(free), None
    rank = F.struct("cosine", "cluster", "topic")
    while not free.isEmpty():
        best = free.withColumns({"c": F.max(rank).over(Window.partitionBy("cluster")), "t": F.max(rank).over(Window.partitionBy("topic"))})
        new = stages.keep(best.filter((F.col("c") == rank) & (F.col("t") == rank)).select("cluster", "topic"))
        given = new if given is None else given.unionByName(new)
        free = stages.keep(free.join(new.select("cluster"), "cluster", "left_anti").join(new.select("topic"), "topic", "left_anti"))
    if given is None:
        return matches.select("cluster", "event", "topic", "sources")
    got = given.select("cluster", F.col("topic").alias("_got"))
    return matches.join(got, "cluster", "left").select(
        "cluster", F.when(F.col("_got").isNotNull(), "kept").otherwise(F.col("event")).alias("event"), F.coalesce("_got", "topic").alias("topic"), F.coalesce("_got", "sources").alias("sources")
    )


def best_jaccard(reference: DataFrame, replicate: DataFrame) -> DataFrame:
    """topic, cluster, jaccard, alive: the replicate's cluster with the greatest overlap; lowest label on ties.

    ``reference``: unit_id, topic; ``replicate``: unit_id, label of the units present.
    """
    present = reference.join(replicate, "unit_id")
    pm = present.groupBy("topic").agg(F.count("*").alias("pm"))
    cm = replicate.filter(F.col("label") != NOISE).groupBy("label").agg(F.count("*").alias("cm"))
    k = present.filter(F.col("label") != NOISE).groupBy("topic", "label").agg(F.count("*").alias("k"))
    j = k.join(pm, "topic").join(cm, "label").withColumn("jaccard", F.col("k") / (F.col("pm") + F.col("cm") - F.col("k")))
    best = j.groupBy("topic").agg(F.max(F.struct("jaccard", (-F.col("label")).alias("minus"))).alias("b"))
    topics = reference.select("topic").distinct()
    return topics.join(best, "topic", "left").select("topic", (-F.col("b.minus")).cast("int").alias("cluster"), F.coalesce("b.jaccard", F.lit(0.0)).alias("jaccard"), F.coalesce(F.col("b.jaccard") > 0.5, F.lit(False)).alias("alive"))


def co_cluster_core(runs: DataFrame, members: DataFrame, threshold: float = 0.75) -> DataFrame:
    """topic, unit_id: of each reference topic (members: unit_id, topic) the largest connected part of the graph that links
    units which share a cluster in at least ``threshold`` of the runs that hold both; the smallest id wins ties.

    Units with the same labels in all runs behave alike, so pairs are formed between such signatures, of which a topic has few,
    not between units.
    """
    order = runs.select("run_id").distinct().orderBy("run_id").toPandas().run_id.tolist()  # one row per run
    sig = runs.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "label"))).alias("m"))  # one entry per run
    named = members.join(sig, "unit_id").select("topic", "unit_id", F.array(*[F.coalesce(F.element_at("m", F.lit(r).cast("long")), F.lit(-2)) for r in order]).alias("sig"))
    groups = named.groupBy("topic", "sig").agg(F.count("*").alias("n"), F.min("unit_id").alias("first"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.array(pdf["sig"].tolist())
        there = s != -2
        both = there.astype(int) @ there.T.astype(int)
        together = sum(((s[:, [k]] == s[:, k]) & (s[:, [k]] >= 0)).astype(int) for k in range(s.shape[1]))
        link = (both > 0) & (together >= threshold * both)
        part = np.arange(len(s))
        while True:
            low = np.minimum(part, np.where(link, part[None, :], len(s)).min(axis=1))
            if (low == part).all():
                break
            part = low
        lone = (pdf["n"].to_numpy() == 1) & (link.sum(1) - np.diag(link) == 0)
        alone = (pdf["n"].to_numpy() > 1) & ~np.diag(link) & (link.sum(1) == 0)
        ok = ~(lone | alone)
        best = None
        for p in np.unique(part[ok]):
            rows = np.flatnonzero((part == p) & ok)
            key = (-pdf["n"].to_numpy()[rows].sum(), pdf["first"].to_numpy()[rows].min())
            if best is None or key < best[0]:
                best = (key, rows)
        keep = best[1] if best else []
        return pd.DataFrame({"topic": pdf["topic"].iloc[keep], "sig": pdf["sig"].iloc[keep]})

    core = groups.groupBy("topic").applyInPandas(run, "topic string, sig array<int>")
    return named.join(core, ["topic", "sig"]).select("topic", "unit_id")


def keeping_streak(events: DataFrame) -> DataFrame:
    """topic, runs: length of the unbroken run of ``kept`` events up to the newest run (run_id, topic, event).

    The newest break is a map-side maximum; the streak is what came after it.
    """
    runs = events.agg(F.max("run_id").alias("newest"))
    g = events.groupBy("topic").agg(F.max(F.when(F.col("event") != "kept", F.col("run_id"))).alias("broken"), F.max("run_id").alias("seen"))
    after = events.join(g, "topic").filter(F.col("broken").isNull() | (F.col("run_id") > F.col("broken"))).groupBy("topic").agg(F.count("*").alias("k"))
    return g.crossJoin(F.broadcast(runs)).join(after, "topic", "left").select("topic", F.when(F.col("seen") == F.col("newest"), F.coalesce("k", F.lit(0))).otherwise(0).cast("long").alias("runs"))


def partition_history(partitions: DataFrame, comparisons: DataFrame, alpha: float = 0.05) -> DataFrame:
    """group_id, metric, clusterings, higher, lower, too_few, since over one representative run per partition.

    ``partitions``: run_id, partition_no; ``comparisons``: run_id, run_at, group_id, metric, effect_size, p_value_holm,
    insufficient_data. The representative is a partition's newest compared run.
    """
    compared = comparisons.select("run_id").distinct()
    rep = partitions.join(compared, "run_id", "left_semi").groupBy("partition_no").agg(F.max("run_id").alias("run_id")).select("run_id")
    r = comparisons.join(rep, "run_id", "left_semi")
    few = F.col("insufficient_data") | F.col("p_value_holm").isNull() | F.col("effect_size").isNull()
    low = F.col("p_value_holm") < alpha
    return r.groupBy("group_id", "metric").agg(
        F.count_if(~few).alias("clusterings"), F.count_if(~few & low & (F.col("effect_size") > 0)).alias("higher"), F.count_if(~few & low & (F.col("effect_size") < 0)).alias("lower"),
        F.count_if(few).alias("too_few"), F.min_by("run_at", "run_id").alias("since"),
    )


def display_direction(higher, lower, effect):
    """Direction of a shown history; none without conclusions; with both the sign of the present effect, else the more frequent."""
    return (
        F.when((higher == 0) & (lower == 0), None).when(lower == 0, "higher").when(higher == 0, "lower")
        .when(effect > 0, "higher").when(effect < 0, "lower").when(lower > higher, "lower").otherwise("higher")
    )


def anchor_holds(anchors: DataFrame, members: DataFrame, current: DataFrame, similarities: DataFrame | None = None, reference: float | None = None) -> DataFrame:
    """topic, overlap, n_cluster, n_anchor, holds: whether a topic still holds what it was named for.

    ``anchors``: topic, unit_id (the units at its naming); ``members``: topic, unit_id now; ``current``: unit_id, label. It holds
    if the shared units are more than half of the cluster and more than half of the anchor's units that are no noise now, or if
    the centroids (``similarities``: topic, cosine) are nearer than ``reference``.
    """
    a = anchors.select("topic", "unit_id").distinct()
    placed = a.join(current.filter(F.col("label") != NOISE).select("unit_id").distinct(), "unit_id", "left_semi").groupBy("topic").agg(F.count("*").alias("n_anchor"))
    own = members.select("topic", "unit_id").distinct()
    shared = own.join(a, ["topic", "unit_id"]).groupBy("topic").agg(F.count("*").alias("overlap"))
    j = own.groupBy("topic").agg(F.count("*").alias("n_cluster")).join(placed, "topic", "left").join(shared, "topic", "left").fillna(0, ["n_anchor", "overlap"])
    holds = (2 * F.col("overlap") > F.col("n_cluster")) & (2 * F.col("overlap") > F.col("n_anchor"))
    if similarities is not None and reference is not None:
        j = j.join(similarities.select("topic", "cosine"), "topic", "left")
        holds = holds | F.coalesce(F.col("cosine") > reference, F.lit(False))
    return j.select("topic", "overlap", "n_cluster", "n_anchor", holds.alias("holds"))


def topic_plan(matches: DataFrame, first_new: int, states: DataFrame, drifted: DataFrame) -> DataFrame:
    """cluster, topic_id, event, reason of every new cluster: kept topics keep their id, others get the next numbers by cluster.

    ``states``: topic, current (its name was made with the present settings); ``drifted``: cluster. A kept topic is named again
    (``reason``) if its settings changed or it drifted; any other event is a reason itself. One row per cluster.
    """
    m = matches.select("cluster", "event", "topic")
    number = F.row_number().over(Window.partitionBy(F.col("event") == "kept").orderBy("cluster")) - 1
    j = m.withColumn("_n", number).join(states.select("topic", F.col("current").alias("_now")), "topic", "left").join(drifted.select("cluster", F.lit(True).alias("_far")), "cluster", "left")
    kept = F.col("event") == "kept"
    reason = F.when(~kept, F.col("event")).when(~F.coalesce("_now", F.lit(False)), "config_change").when(F.col("_far"), "drift")
    return j.select("cluster", F.when(kept, F.col("topic")).otherwise(F.concat(F.lit("topic_"), F.col("_n") + first_new)).alias("topic_id"), "event", reason.alias("reason"))


def topic_events(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """topic_id, event of a run: the plan's event, ``relabeled`` for a kept topic with a reason, ``retired`` for a stored one without a cluster."""
    event = F.when((F.col("event") == "kept") & F.col("reason").isNotNull(), "relabeled").otherwise(F.col("event"))
    gone = stored.select("topic_id").distinct().join(plan.select("topic_id"), "topic_id", "left_anti")
    return plan.select("topic_id", event.alias("event")).unionByName(gone.select("topic_id", F.lit("retired").alias("event")))
