"""Partition, identity and vector queries over the stored runs and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import metrics
from threadlake.operators import density
from threadlake.operators import partitions as op
from threadlake.operators import vectors
from threadlake.plans import base
from threadlake.plans.base import WITH
from threadlake.sources.tables import table


def partition_agreement(spark, d):
    return op.adjusted_rand(base.labels(spark, d)).select("run_a", "run_b", "n", F.round("ari", 6).alias("ari"))


def partition_transitions(spark, d):
    return op.transitions(base.labels(spark, d))


def distinct_partitions(spark, d):
    return op.distinct_partitions(base.labels(spark, d))


def _last_two(spark, d):
    lab = base.labels(spark, d)
    runs = lab.select("run_id").distinct().orderBy(F.desc("run_id")).limit(2)
    b = lab.join(F.broadcast(runs.agg(F.max("run_id").alias("run_id"))), "run_id").select("unit_id", "label")
    a = lab.join(F.broadcast(runs.agg(F.min("run_id").alias("run_id"))), "run_id").select("unit_id", "label")
    return a, b


def same_partition(spark, d):
    return op.same_partition(op.contingency(*_last_two(spark, d)))


def cluster_identity(spark, d):
    a, b = _last_two(spark, d)
    previous = a.filter("label >= 0").select("unit_id", F.concat(F.lit("old_"), F.col("label")).alias("topic"))
    return op.match_clusters(previous, b)


def best_jaccard(spark, d):
    a, b = _last_two(spark, d)
    m = op.best_jaccard(a.filter("label >= 0").select("unit_id", F.concat(F.lit("old_"), F.col("label")).alias("topic")), b)
    return m.select("topic", "cluster", F.round("jaccard", 6).alias("jaccard"), "alive")


def common_units(spark, d):
    """Units present in every run, and in any run."""
    lab = base.labels(spark, d)
    runs = lab.agg(F.count_distinct("run_id").alias("runs"))
    per = lab.groupBy("unit_id").agg(F.count("*").alias("k"))
    return per.crossJoin(F.broadcast(runs)).agg(F.count_if(F.col("k") == F.col("runs")).alias("in_all"), F.count("*").alias("in_any"))


def membership_margins(spark, d):
    """Per old topic the share of its present units in its largest new cluster, and the Wilson interval of that share."""
    a, b = _last_two(spark, d)
    j = a.filter("label >= 0").withColumnRenamed("label", "old").join(b, "unit_id")
    k = j.groupBy("old", "label").agg(F.count("*").alias("k"))
    g = k.groupBy("old").agg(F.sum("k").cast("long").alias("n"), F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("k"))), F.lit(0)).alias("most"))
    low, high = metrics.wilson(F.col("most"), F.col("n"))
    return g.select("old", "n", "most", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def co_cluster_cores(spark, d):
    """Units of each newest topic that stay together through the runs."""
    _, b = _last_two(spark, d)
    return op.co_cluster_core(base.labels(spark, d), b.filter("label >= 0").select("unit_id", F.concat(F.lit("topic_"), F.col("label")).alias("topic")))


def topic_streaks(spark, d):
    """How many newest months in a row each stored group kept a sufficient sample."""
    s = table(spark, d, "distribution_stats").filter("bucket_key <> 'all' and group_id is not null").select(F.regexp_replace("bucket_key", "-", "").cast("long").alias("run_id"), F.col("group_id").alias("topic"), F.when(F.col("insufficient_data"), "lost").otherwise("kept").alias("event"))
    once = s.groupBy("run_id", "topic").agg(F.max("event").alias("event"))
    return op.keeping_streak(once)


def embedding_centroids(spark, d):
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def embedding_representatives(spark, d):
    """The three vectors nearest to each label's centroid."""
    n = vectors.nearest(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return n.select("label", "place", "vec_id", F.round("cosine", 6).alias("cosine"))


def centroid_similarities(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return vectors.pairwise(c, "label").select("a", "b", F.round("cosine", 6).alias("cosine"))


def semantic_reference(spark, d):
    """The greatest similarity of two different centroids: nearer than this means the same content."""
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return vectors.pairwise(c, "label").agg(F.round(F.max("cosine"), 6).alias("reference"))


def mutual_information(spark, d):
    """Adjusted mutual information of the two newest runs, from their contingency table (one row per pair of clusters)."""
    return op.adjusted_mutual_information(op.contingency(*_last_two(spark, d))).select(F.round("ami", 6).alias("ami"))


def median_shift(spark, d):
    """Signed-rank p of each topic's engagement against the channel median, from ranks and aggregates: topics may be of any size."""
    from threadlake.operators import significance
    from threadlake.operators.order_statistics import quantiles
    from threadlake.plans.comparisons import _cells

    c = _cells(spark, d).filter("metric = 'engagement'").select("topic_id", "value")
    centre = quantiles(c, [], "value", {"centre": 0.5}).first()
    if centre is None or centre["centre"] is None:
        return spark.createDataFrame([], "topic_id string, n long, p double")
    return significance.signed_ranks(c.filter("topic_id is not null"), "topic_id", "value", centre["centre"])


def density_clusters(spark, d):
    """Density clusters of the units of each topic by their coordinates: how many, and their validity.

    One kernel per topic; a topic beyond the kernel's bound is refused, not cut."""
    from threadlake.plans.threads import _topic_of

    u = base.units(spark, d, "umap_x", "umap_y", "umap_z").filter("umap_x is not null and umap_y is not null and umap_z is not null")
    p = u.join(_topic_of(spark, d).filter("topic_id is not null").select("id", "topic_id"), "id").select("topic_id", F.col("id").alias("unit_id"), F.col("umap_x").alias("x"), F.col("umap_y").alias("y"), F.col("umap_z").alias("z"))
    c = density.cluster(p, "topic_id")
    return c.groupBy("topic_id").agg((F.max("label") + 1).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"), F.round(F.first("validity"), 6).alias("validity"))


def principal_coordinates(spark, d):
    return density.principal_coordinates(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", *[F.round(a, 6).alias(a) for a in "xyz"])


QUERIES = (
    mutual_information, median_shift, density_clusters, principal_coordinates, partition_agreement, partition_transitions, distinct_partitions, same_partition, cluster_identity, best_jaccard, common_units, membership_margins,
    co_cluster_cores, topic_streaks, embedding_centroids, embedding_representatives, centroid_similarities, semantic_reference,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_RUNS = WITH + """,
ro AS (SELECT run_id, lead(run_id) OVER (ORDER BY run_id) AS nx FROM (SELECT DISTINCT run_id FROM cl)),
pr AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.label AS la, b.label AS lb FROM cl a JOIN ro ON ro.run_id = a.run_id JOIN cl b ON b.run_id = ro.nx AND b.unit_id = a.unit_id),
mx AS (SELECT max(run_id) AS hi, (SELECT max(run_id) FROM cl WHERE run_id < (SELECT max(run_id) FROM cl)) AS lo FROM cl),
a AS (SELECT unit_id, label FROM cl, mx WHERE run_id = lo), b AS (SELECT unit_id, label FROM cl, mx WHERE run_id = hi)
"""
_CENT = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM n), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), l AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY 1),
c AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM l)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "mutual_information": _RUNS + """, ce AS (SELECT a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM a JOIN b USING (unit_id) GROUP BY 1, 2), ra AS (SELECT la, sum(n) AS a FROM ce GROUP BY 1), rb AS (SELECT lb, sum(n) AS b FROM ce GROUP BY 1), tt AS (SELECT sum(n) AS t FROM ce),
ha AS (SELECT -sum(a / t * ln(a / t)) AS h FROM ra, tt), hb AS (SELECT -sum(b / t * ln(b / t)) AS h FROM rb, tt), mi AS (SELECT sum(n / t * ln(t * n / (a * b))) AS m FROM ce JOIN ra USING (la) JOIN rb USING (lb), tt),
ks AS (SELECT a, b, t, unnest(generate_series(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT))::DOUBLE AS k FROM ra, rb, tt),
ex AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS e FROM ks)
SELECT round((m - e) / ((ha.h + hb.h) / 2 - e), 6) AS ami FROM mi, ex, ha, hb""",
        "partition_agreement": _RUNS + ", ce AS (SELECT run_a, run_b, la, lb, count(*) AS n FROM pr GROUP BY ALL), st AS (SELECT run_a, run_b, sum(n) AS n, sum(n * (n - 1) / 2.0) AS s FROM ce GROUP BY ALL), sa AS (SELECT run_a, run_b, sum(k * (k - 1) / 2.0) AS s FROM (SELECT run_a, run_b, la, sum(n) AS k FROM ce GROUP BY ALL) GROUP BY ALL), sb AS (SELECT run_a, run_b, sum(k * (k - 1) / 2.0) AS s FROM (SELECT run_a, run_b, lb, sum(n) AS k FROM ce GROUP BY ALL) GROUP BY ALL) SELECT st.run_a, st.run_b, st.n::BIGINT AS n, round((st.s - sa.s * sb.s / (st.n * (st.n - 1) / 2.0)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (st.n * (st.n - 1) / 2.0)), 6)::DOUBLE AS ari FROM st JOIN sa USING (run_a, run_b) JOIN sb USING (run_a, run_b)",
        "partition_transitions": _RUNS + ", f AS (SELECT ro.run_id AS run_a, nx AS run_b, cl.unit_id, label >= 0 AS c, NULL AS d FROM cl JOIN ro ON ro.run_id = cl.run_id WHERE nx IS NOT NULL UNION ALL SELECT ro.run_id, nx, cl.unit_id, NULL, label >= 0 FROM cl JOIN ro ON ro.nx = cl.run_id), g AS (SELECT run_a, run_b, unit_id, bool_or(c) AS c, bool_or(d) AS d FROM f GROUP BY ALL) SELECT run_a, run_b, count(*) FILTER (c AND d) AS stayed, count(*) FILTER (c AND NOT d) AS to_noise, count(*) FILTER (NOT c AND d) AS from_noise, count(*) FILTER (NOT c AND NOT d) AS stayed_noise, count(*) FILTER (c IS NULL) AS new_units FROM g GROUP BY 1, 2",
        "distinct_partitions": _RUNS + ", h AS (SELECT run_id, string_agg(unit_id || ':' || label, ',' ORDER BY unit_id) AS m FROM cl GROUP BY 1), k AS (SELECT run_id, CASE WHEN m = lag(m) OVER (ORDER BY run_id) THEN 0 ELSE 1 END AS s FROM h), q AS (SELECT run_id, (sum(s) OVER (ORDER BY run_id))::BIGINT AS partition_no FROM k) SELECT run_id, partition_no, min(run_id) OVER (PARTITION BY partition_no) AS first_run FROM q",
        "same_partition": _RUNS + ", t AS (SELECT DISTINCT a.label AS la, b.label AS lb FROM a JOIN b USING (unit_id)) SELECT count(DISTINCT la) = count(*) AND count(DISTINCT lb) = count(*) AND coalesce(bool_and((la = -1) = (lb = -1)), true) AS same FROM t",
        "cluster_identity": _RUNS + """, o AS (SELECT 'old_' || a.label AS topic, b.label AS c FROM a JOIN b USING (unit_id) WHERE a.label >= 0), cm AS (SELECT label AS c, count(*) AS cm FROM b WHERE label >= 0 GROUP BY 1),
pm AS (SELECT topic, count(*) AS pm, count(*) FILTER (c >= 0) AS pc FROM o GROUP BY 1), k AS (SELECT topic, c, count(*) AS k FROM o WHERE c >= 0 GROUP BY 1, 2),
x AS (SELECT k.topic, k.c, 2 * k > cm AS child, 2 * k > pc AS keeps, 2 * k > pm AS merges FROM k JOIN cm USING (c) JOIN pm USING (topic)),
y AS (SELECT cm.c, max(topic) FILTER (child) AS src, count(*) FILTER (merges) AS np, coalesce(bool_or(child AND keeps), false) AS two, max(topic) FILTER (merges) AS op, string_agg(topic, ',' ORDER BY topic) FILTER (merges) AS mf FROM cm LEFT JOIN x USING (c) GROUP BY 1),
z AS (SELECT *, two AND (np = 0 OR (np = 1 AND op = src)) AS kept FROM y), w AS (SELECT z.*, count(*) OVER (PARTITION BY src) AS kids, bool_or(kept) OVER (PARTITION BY src) AS ak FROM z),
e AS (SELECT *, CASE WHEN np >= 2 THEN 'merged' WHEN kept THEN 'kept' WHEN src IS NOT NULL AND kids >= 2 AND NOT ak THEN 'split' ELSE 'new' END AS event FROM w)
SELECT c AS cluster, event, CASE WHEN event = 'kept' THEN src END AS topic, CASE WHEN event = 'merged' THEN mf ELSE coalesce(src, '') END AS sources FROM e""",
        "best_jaccard": _RUNS + ", o AS (SELECT 'old_' || a.label AS topic, b.label AS c FROM a JOIN b USING (unit_id) WHERE a.label >= 0), j AS (SELECT topic, c, count(*)::DOUBLE / ((SELECT count(*) FROM o o2 WHERE o2.topic = o.topic) + (SELECT count(*) FROM b WHERE label = c) - count(*)) AS j FROM o WHERE c >= 0 GROUP BY 1, 2)  , rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY j DESC, c) AS n FROM j), t AS (SELECT DISTINCT 'old_' || label AS topic FROM a WHERE label >= 0) SELECT t.topic, c AS cluster, round(coalesce(j, 0), 6) AS jaccard, coalesce(j > 0.5, false) AS alive FROM t LEFT JOIN rk ON rk.topic = t.topic AND n = 1",
        "common_units": WITH + ", k AS (SELECT unit_id, count(*) AS k FROM cl GROUP BY 1) SELECT count(*) FILTER (k = (SELECT count(DISTINCT run_id) FROM cl)) AS in_all, count(*) AS in_any FROM k",
        "membership_margins": _RUNS + ", k AS (SELECT a.label AS old, b.label AS c, count(*) AS k FROM a JOIN b USING (unit_id) WHERE a.label >= 0 GROUP BY 1, 2), g AS (SELECT old, sum(k)::BIGINT AS n, coalesce(max(k) FILTER (c >= 0), 0) AS most FROM k GROUP BY 1), w AS (SELECT *, most / n AS p, 1.96::DOUBLE AS z FROM g) SELECT old, n, most, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 0), 6) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1), 6) AS high FROM w",
        "topic_streaks": "WITH s AS (SELECT replace(bucket_key, '-', '')::BIGINT AS run_id, group_id AS topic, max(CASE WHEN insufficient_data THEN 'lost' ELSE 'kept' END) AS event FROM distribution_stats WHERE bucket_key <> 'all' AND group_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT topic, max(run_id) FILTER (event <> 'kept') AS br, max(run_id) AS seen FROM s GROUP BY 1) SELECT g.topic, CASE WHEN seen = (SELECT max(run_id) FROM s) THEN (SELECT count(*) FROM s WHERE s.topic = g.topic AND (br IS NULL OR run_id > br)) ELSE 0 END AS runs FROM g",
        "embedding_centroids": _CENT + "SELECT label, unnest(range(len(c)))::INT AS i, round(unnest(c), 6) AS x FROM c",
        "embedding_representatives": _CENT + ", s AS (SELECT n.label, vec_id, round(list_dot_product(v, c), 9) AS cosine FROM n JOIN c USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS place FROM s) SELECT label, place::INT AS place, vec_id, round(cosine, 6) AS cosine FROM r WHERE place <= 3",
        "centroid_similarities": _CENT + "SELECT a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c), 6) AS cosine FROM c a JOIN c b ON a.label < b.label",
        "semantic_reference": _CENT + "SELECT round(max(list_dot_product(a.c, b.c)), 6) AS reference FROM c a JOIN c b ON a.label < b.label",
    }
