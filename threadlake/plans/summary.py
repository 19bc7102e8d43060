"""Summaries over several tables: pipeline state, comparison rows, runs held against each other, integrity, languages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlake.functions import metrics
from threadlake.operators import partitions, significance
from threadlake.operators import threads as threads_op
from threadlake.operators.order_statistics import distribution
from threadlake.plans import base, comparisons, identity
from threadlake.plans.base import WITH
from threadlake.plans.comparisons import TAIL, _effects
from threadlake.plans.threads import _ROLES, _TOPIC, _topic_of
from threadlake.sources.tables import table

KINDS = ("topic", "noise", "channel")


def pipeline_summary(spark, d):
    """One row: units, texts, reply roles, the newest reading, the newest run and the engagement of its noise."""
    text = base.units(spark, d, "full_text").agg(F.count("*").alias("content_units"), F.count_if(F.trim(F.coalesce("full_text", F.lit(""))) == "").alias("units_without_text"))
    p = base.posts(spark, d)
    roles = p.select("id").join(threads_op.reply_roles(p).select("id", "role"), "id", "left")
    roles = roles.agg(*[F.count_if(F.coalesce("role", F.lit("unassigned")) == r).alias(r) for r in ("continuation", "answer", "outbound", "unassigned")])
    newest = base.readings(spark, d).agg(F.max("fetched_at").alias("latest_snapshot_at"))
    t = _topic_of(spark, d)
    run = t.agg(F.count("*").alias("n_units"), F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.count_if(F.col("label") == -1).alias("n_noise"))
    ratio = F.when(F.col("n_units") > 0, F.round(F.col("n_noise") / F.col("n_units"), 6)).alias("noise_ratio")
    seen = t.filter("label = -1").select("id").join(base.latest_insights(spark, d).withColumnRenamed("post_id", "id"), "id")
    out = seen.agg(F.count_if(F.coalesce("views", F.lit(0)) <= 0).alias("noise_excluded_no_views"))
    one = spark.createDataFrame([("noise",)], "g string")
    s = distribution(seen.select(F.lit("noise").alias("g"), metrics.engagement_rate().alias("value")), ["g"], "value", groups=one)
    s = s.select(F.col("n").alias("noise_n"), F.round("median", 6).alias("noise_median"), F.round("iqr_low", 6).alias("noise_iqr_low"), F.round("iqr_high", 6).alias("noise_iqr_high"), F.col("insufficient_data").alias("noise_insufficient"))
    # every side is one row
    return text.crossJoin(roles).crossJoin(newest).crossJoin(run.select("*", ratio)).crossJoin(out).crossJoin(s)


def comparison_rows(spark, d):
    """Every topic, noise and the channel per rate: the group's distribution, units left out for want of views, and the same of a
    topic's rest; ``place`` by rate, kind, id."""
    i = base.latest_insights(spark, d).withColumnRenamed("post_id", "id")
    seen = _topic_of(spark, d).select("id", "topic_id").join(i, "id")
    group = F.coalesce("topic_id", F.lit("noise"))
    cells = seen.select(group.alias("g"), *[f().alias(k) for k, f in metrics.RATES.items()])
    both = cells.withColumn("group_id", F.explode(F.array("g", F.lit("channel")))).drop("g")
    values = both.select("group_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics.RATES])).alias("m")).select("group_id", "m.metric", "m.value")
    groups = values.select("group_id", "metric").distinct()
    own = distribution(values, ["group_id", "metric"], "value", groups=groups)
    left_out = values.filter("value is null").groupBy("group_id", "metric").agg(F.count("*").alias("excluded_no_views"))
    j = own.join(left_out, ["group_id", "metric"], "left").withColumn("excluded_no_views", F.coalesce("excluded_no_views", F.lit(0)))
    channel = j.filter("group_id = 'channel'").select("metric", F.col("n").alias("_n"), F.col("excluded_no_views").alias("_x"))
    kind = F.when(F.col("group_id").isin("noise", "channel"), F.col("group_id")).otherwise("topic")
    topic = kind == "topic"
    j = j.join(F.broadcast(channel), "metric")  # a row per rate
    order = [F.array_position(F.array(*map(F.lit, metrics.RATES)), F.col("metric")), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "group_id"]
    return j.select(
        "group_id", kind.alias("kind"), "metric", "n", "excluded_no_views", *[F.round(c, 6).alias(c) for c in ("mean", "median", "iqr_low", "iqr_high")], "insufficient_data",
        F.when(topic, F.col("_n") - F.col("n")).alias("rest_n"), F.when(topic, F.col("_x") - F.col("excluded_no_views")).alias("rest_excluded"),
    ).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # a row per group and rate


def _run_cells(spark, d):
    """run_id, cluster (null for noise), metric, value of every measured unit of every run."""
    i = base.latest_insights(spark, d).withColumnRenamed("post_id", "id")
    lab = base.labels(spark, d).select("run_id", F.col("unit_id").alias("id"), F.when(F.col("label") >= 0, F.col("label")).cast("string").alias("cluster"))
    rates = base.rates(lab.join(i, "id")).select("run_id", "cluster", "metric", F.round("value", 6).alias("value"))
    return rates.withColumn("key", F.concat_ws(":", "run_id", "metric"))


def _run_verdicts(spark, d):
    """run_id, cluster, metric, delta, p_holm, insufficient_data, verdict: every run's clusters against their rest; Holm per run."""
    r = significance.rank_sums(_run_cells(spark, d), "cluster", "key", "value")
    r = r.withColumn("p", F.round(metrics.normal_tail(F.col("z")), 9)).withColumns({"run_id": F.split("key", ":")[0].cast("long"), "metric": F.split("key", ":")[1]})
    h = significance.holm(r, "p", ["run_id"])
    delta = F.round("delta", 6)
    return h.select("run_id", "cluster", "metric", delta.alias("delta"), F.round("p_holm", 6).alias("p_holm"), "insufficient_data", metrics.verdict(F.col("p_holm"), delta, F.col("insufficient_data")).alias("verdict"))


def run_verdicts(spark, d):
    return _run_verdicts(spark, d)


def comparison_history(spark, d):
    """How often each cluster number and rate stood out, over one run per distinct partition (numbers stand for themselves here)."""
    v = _run_verdicts(spark, d).select(
        "run_id", F.col("run_id").cast("string").alias("run_at"), F.col("cluster").alias("group_id"), "metric", F.col("delta").alias("effect_size"), F.col("p_holm").alias("p_value_holm"), "insufficient_data"
    )
    return partitions.partition_history(partitions.distinct_partitions(base.labels(spark, d)), v)


def masked_comparisons(spark, d):
    """Comparisons made from the run before the newest: effects are withheld, for their clusters are no longer the present ones."""
    v = _run_verdicts(spark, d)
    j = v.crossJoin(F.broadcast(base.labels(spark, d).agg(F.max("run_id").alias("newest"))))
    before = j.filter(F.col("run_id") < F.col("newest")).agg(F.max("run_id").alias("used"))
    stale = F.col("newest") > F.col("used")
    j = j.crossJoin(F.broadcast(before)).filter(F.col("run_id") == F.coalesce("used", "newest"))
    shown = F.coalesce(stale, F.lit(False))
    return j.select("run_id", "cluster", "metric", shown.alias("stale"), F.when(~shown, F.col("delta")).alias("delta"), F.when(~shown, F.col("p_holm")).alias("p_holm"))


def conclusion_stability(spark, d):
    """Per newest topic, rate and direction: in how many of the other runs the conclusion held, and whether that is enough."""
    lab = base.labels(spark, d)
    newest = F.broadcast(lab.agg(F.max("run_id").alias("newest")))
    v = _run_verdicts(spark, d).crossJoin(newest)
    own = v.filter("run_id = newest").select(F.col("cluster").alias("topic"), "metric", F.col("verdict").alias("reference"))
    marked = lab.crossJoin(newest)
    members = marked.filter("run_id = newest and label >= 0").select("unit_id", F.col("label").cast("string").alias("topic"))
    # the best cluster per run: run and topic make one key
    runs = marked.filter("run_id < newest").select("run_id", "unit_id", "label")
    present = members.join(runs, "unit_id")
    size = runs.filter("label >= 0").groupBy("run_id", "label").agg(F.count("*").alias("cm"))
    pm = present.groupBy("run_id", "topic").agg(F.count("*").alias("pm"))
    k = present.filter("label >= 0").groupBy("run_id", "topic", "label").agg(F.count("*").alias("k")).join(size, ["run_id", "label"]).join(pm, ["run_id", "topic"])
    k = k.withColumn("jaccard", F.col("k") / (F.col("pm") + F.col("cm") - F.col("k")))
    best = k.groupBy("run_id", "topic").agg(F.max(F.struct("jaccard", (-F.col("label")).alias("minus"))).alias("b"))
    alive = best.select("run_id", "topic", (-F.col("b.minus")).cast("string").alias("cluster"), (F.col("b.jaccard") > 0.5).alias("alive"))
    found = alive.join(v.select("run_id", "cluster", "metric", "verdict", "delta"), ["run_id", "cluster"])
    kept = found.groupBy("topic", "metric").agg(*[F.count_if(metrics.held(x, F.col("alive"), F.col("verdict"), F.col("delta"))).alias(x) for x in ("higher", "lower")])
    total = runs.agg(F.countDistinct("run_id").alias("total"))
    j = own.join(kept, ["topic", "metric"], "left").crossJoin(F.broadcast(total))
    j = j.select("topic", "metric", "reference", "total", F.explode(F.array(*[F.struct(F.lit(x).alias("direction"), F.coalesce(x, F.lit(0)).alias("kept")) for x in ("higher", "lower")])).alias("x"))
    return j.select("topic", "metric", "x.direction", "reference", "x.kept", "total", metrics.passes(F.col("reference"), F.col("x.direction"), F.col("x.kept"), F.col("total")).alias("passes"))


def agreement_summary(spark, d):
    """Median and quartiles of the adjusted Rand index: of the other runs with the newest, and of all pairs of the others."""
    lab = base.labels(spark, d)
    cells = lab.select(F.col("run_id").alias("run_a"), "unit_id", F.col("label").alias("la")).join(lab.select(F.col("run_id").alias("run_b"), "unit_id", F.col("label").alias("lb")), "unit_id").filter("run_a < run_b")
    cells = cells.groupBy("run_a", "run_b", "la", "lb").agg(F.count("*").alias("n"))
    newest = F.broadcast(lab.agg(F.max("run_id").alias("newest")))
    a = partitions.rand_of_cells(cells).crossJoin(newest).withColumn("arm", F.when(F.col("run_b") == F.col("newest"), "vs_newest").otherwise("pairwise"))
    s = distribution(a.select("arm", F.col("ari").alias("value")), ["arm"], "value")
    return s.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("median", "iqr_low", "iqr_high")])


def reference_integrity(spark, d):
    """Rows whose reference finds nothing, per relation; a relation without any counts 0."""
    t = {n: table(spark, d, n) for n in ("posts", "content_units", "post_spans", "insights_snapshots", "cluster_labels", "topics", "unit_metrics", "distribution_stats", "subject_labels", "documents", "subject_areas")}
    representatives = t["topics"].select(F.explode(F.from_json("representative_ids_json", "array<string>")).alias("unit_id"))
    relations = {
        "posts.replied_to_id": (base.posts(spark, d).select(F.col("parent").alias("k")), t["posts"].select(F.col("id").alias("k"))),
        "insights_snapshots.post_id": (t["insights_snapshots"].select(F.col("post_id").alias("k")), t["posts"].select(F.col("id").alias("k"))),
        "post_spans.unit_id": (t["post_spans"].select(F.col("unit_id").alias("k")), t["content_units"].select(F.col("id").alias("k"))),
        "cluster_labels.unit_id": (t["cluster_labels"].select(F.col("unit_id").alias("k")), t["content_units"].select(F.col("id").alias("k"))),
        "cluster_labels.topic": (_topic_of(spark, d).select(F.col("topic_id").alias("k")), t["topics"].select(F.col("id").alias("k"))),
        "topics.representatives": (representatives.select(F.col("unit_id").alias("k")), t["content_units"].select(F.col("id").alias("k"))),
        "unit_metrics.topic_id": (t["unit_metrics"].select(F.col("topic_id").alias("k")), t["topics"].select(F.col("id").alias("k"))),
        "distribution_stats.group_id": (t["distribution_stats"].select(F.col("group_id").alias("k")), t["topics"].select(F.col("id").alias("k"))),
        "subject_labels.doc_id": (t["subject_labels"].select(F.col("doc_id").cast("string").alias("k")), t["documents"].select(F.col("doc_id").cast("string").alias("k"))),
        "subject_labels.subject": (t["subject_labels"].select(F.col("subject").alias("k")), t["subject_areas"].select(F.col("subject").alias("k"))),
    }
    out = None
    for name, (child, parent) in relations.items():
        known = parent.filter("k is not null").distinct().withColumn("there", F.lit(True))
        # keys are counted before they are looked up, so a hot key is one row
        part = child.filter("k is not null").groupBy("k").agg(F.count("*").alias("c")).join(known, "k", "left").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("references"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("c"))), F.lit(0)).alias("orphans"))
        part = part.select(F.lit(name).alias("relation"), "references", "orphans")
        out = part if out is None else out.unionByName(part)
    return out


def _anchors(spark, d):
    """The units that a topic held in the run before the newest: those of the cluster its present units mostly came from."""
    a, b = identity._last_two(spark, d)
    return a.filter("label >= 0").select("unit_id", F.concat(F.lit("old_"), F.col("label")).alias("topic")), b


def anchor_checks(spark, d):
    """Of every cluster that kept its topic: whether it still holds what the topic was named for (its units one run before)."""
    previous, current = _anchors(spark, d)
    kept = partitions.match_clusters(previous, current).filter("event = 'kept'").select(F.col("cluster").alias("label"), "topic")
    members = current.join(kept, "label").select("topic", "unit_id")
    return partitions.anchor_holds(previous.join(kept.select("topic"), "topic", "left_semi"), members, current)


def topic_plan(spark, d):
    """Ids and events of the newest run's clusters against the run before; kept topics count as named with the present settings."""
    previous, current = _anchors(spark, d)
    matches = partitions.match_clusters(previous, current)
    first = table(spark, d, "topics").agg(F.max(F.regexp_extract("id", r"^topic_(\d+)$", 1).try_cast("long"))).first()[0]
    states = previous.select("topic", F.lit(True).alias("current")).distinct()
    drifted = anchor_checks(spark, d).filter(~F.col("holds")).join(matches.filter("event = 'kept'").select("topic", "cluster"), "topic").select("cluster")
    return partitions.topic_plan(matches, 1 + (-1 if first is None else first), states, drifted)


def topic_events(spark, d):
    """What became of every topic in the newest run, retired ones too."""
    previous, _ = _anchors(spark, d)
    return partitions.topic_events(topic_plan(spark, d), previous.select(F.col("topic").alias("topic_id")))


def post_rates(spark, d):
    """The three rates of every measured root as numbers: 0 where there was no view."""
    m = base.measured_roots(spark, d)
    return m.select("id", *[F.round(f(unmeasured=0.0), 6).alias(k) for k, f in metrics.RATES.items()])


def dst_posts(spark, d):
    """Posts per author month and whether daylight saving time held."""
    p = base.posts(spark, d).filter("posted_at is not null")
    return p.groupBy(metrics.local_month(F.col("posted_at")).alias("month"), metrics.is_dst(F.col("posted_at"), metrics.AUTHOR_ZONE).alias("dst")).agg(F.count("*").alias("posts"))


#: A token tells a language if it was met so often, and one language has at least this share of its rates.
LEAST_MET, LEAST_SHARE, LEAST_CONFIDENCE = 3, 0.6, 0.5


def _tokens(x):
    return F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), F.lit(0))


def language_info(spark, d):
    """Per text: primary language (null under half of the known tokens), the languages of its tokens, confidence, mix score.

    A token's language comes from a profile of the labelled texts: how often each language uses it, relative to that language's
    size. Tokens are counted per text and per label before they meet, so a frequent word is one row per text.
    """
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", "lang", _tokens(F.col("text")).alias("t"))
    per_text = x.select("doc_id", F.explode("t").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("c"))
    code = F.regexp_extract(F.lower(F.trim("lang")), "^(vi|fr|en)(?:$|[-_])", 1)
    labelled = x.select(code.alias("code"), F.explode("t").alias("token")).filter("code <> ''").groupBy("code", "token").agg(F.count("*").alias("c"))
    size = labelled.groupBy("code").agg(F.sum("c").alias("size"))  # a row per language
    rate = labelled.join(F.broadcast(size), "code").select("token", "code", "c", (F.col("c") / F.col("size")).alias("rate"))
    best = rate.groupBy("token").agg(F.sum("c").alias("met"), F.sum("rate").alias("all"), F.max(F.struct("rate", "code")).alias("b"))
    known = best.filter((F.col("met") >= LEAST_MET) & (F.col("b.rate") >= LEAST_SHARE * F.col("all"))).select("token", F.col("b.code").alias("code"))
    tagged = per_text.join(known, "token", "left").groupBy("doc_id", "code").agg(F.sum("c").alias("c"))
    g = tagged.groupBy("doc_id").agg(
        F.sum(F.when(F.col("code").isNotNull(), F.col("c"))).alias("n"), F.max(F.when(F.col("code").isNotNull(), F.struct("c", "code"))).alias("b"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("detected")
    )
    share = F.col("b.c") / F.col("n")
    j = x.select("doc_id").distinct().join(g, "doc_id", "left")
    return j.select(
        "doc_id", F.when(share >= LEAST_CONFIDENCE, F.col("b.code")).alias("primary_language"), F.coalesce("detected", F.lit("")).alias("detected"),
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("confidence"), F.round(F.coalesce(100.0 * (1 - share), F.lit(0.0)), 6).alias("mix_score"),
    )


QUERIES = (
    pipeline_summary, comparison_rows, run_verdicts, comparison_history, masked_comparisons, conclusion_stability, agreement_summary, reference_integrity, anchor_checks, topic_plan, topic_events,
    post_rates, dst_posts, language_info,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_RATE = "100.0::DOUBLE * ({}) / views"
_THREE = {"engagement": "coalesce(likes, 0) + coalesce(replies, 0) + coalesce(reposts, 0) + coalesce(quotes, 0)", "share_rate": "coalesce(reposts, 0) + coalesce(quotes, 0)", "conversation": "coalesce(replies, 0)"}


def _metrics_sql(rate: str) -> str:
    return ", ".join(f"struct_pack(metric := '{k}', value := {rate.format(e)})" for k, e in _THREE.items())


def _verdicts() -> str:
    cells = f"SELECT cluster AS topic_id, run_id || ':' || w.metric AS metric, round(w.value, 6) AS value FROM (SELECT run_id, CASE WHEN label >= 0 THEN label::VARCHAR END AS cluster, unnest([{_metrics_sql(_RATE)}]) AS w FROM cl JOIN l ON l.post_id = cl.unit_id WHERE views > 0)"
    return WITH + _effects(cells) + f""",
pp AS (SELECT split_part(metric, ':', 1)::BIGINT AS run_id, topic_id AS cluster, split_part(metric, ':', 2) AS metric, round(delta, 6) AS delta, insufficient_data, round({TAIL}, 9) AS p FROM ef),
st AS (SELECT *, least(p * (count(p) OVER (PARTITION BY run_id) - row_number() OVER (PARTITION BY run_id ORDER BY p, cluster, metric) + 1), 1) AS step FROM pp),
hh AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(step) OVER (PARTITION BY run_id ORDER BY p, cluster, metric ROWS UNBOUNDED PRECEDING) END AS ph FROM st),
rv AS (SELECT run_id, cluster, metric, delta, round(ph, 6) AS p_holm, insufficient_data, CASE WHEN ph IS NULL OR delta IS NULL THEN 'not tested' WHEN insufficient_data THEN 'too few posts' WHEN ph >= 0.05 THEN 'not distinguishable' WHEN delta > 0 THEN 'higher' ELSE 'lower' END AS verdict FROM hh)
"""


def oracle_sql() -> dict[str, str]:
    runs, of = identity.oracle_sql(), _TOPIC
    plan = runs["cluster_identity"] + """),
nx AS (SELECT coalesce(max(try_cast(regexp_extract(id, '^topic_(\\d+)$', 1) AS BIGINT)), -1) + 1 AS first FROM topics),
me AS (SELECT i.topic, b.unit_id FROM idn i JOIN b ON b.label = i.cluster WHERE event = 'kept'), an AS (SELECT DISTINCT 'old_' || a.label AS topic, unit_id FROM a WHERE label >= 0),
ac AS (SELECT topic, count(*) AS n_cluster, count(*) FILTER (EXISTS (SELECT 1 FROM an WHERE an.topic = me.topic AND an.unit_id = me.unit_id)) AS overlap FROM me GROUP BY 1),
ap AS (SELECT topic, count(*) AS n_anchor FROM an JOIN b ON b.unit_id = an.unit_id AND b.label >= 0 GROUP BY 1),
ah AS (SELECT ac.topic, overlap, n_cluster, coalesce(n_anchor, 0) AS n_anchor, 2 * overlap > n_cluster AND 2 * overlap > coalesce(n_anchor, 0) AS holds FROM ac LEFT JOIN ap USING (topic)),
pl AS (SELECT i.cluster, CASE WHEN event = 'kept' THEN i.topic ELSE 'topic_' || (row_number() OVER (PARTITION BY event = 'kept' ORDER BY i.cluster) - 1 + first) END AS topic_id, event, CASE WHEN event <> 'kept' THEN event WHEN NOT holds THEN 'drift' END AS reason FROM idn i LEFT JOIN ah ON ah.topic = i.topic AND event = 'kept', nx)
"""
    head, sep, tail = plan.rpartition("SELECT c AS cluster, event")
    plan = head + ", idn AS (SELECT c AS cluster, event" + tail
    relation = "SELECT '{0}' AS relation, count(*) AS references, count(*) FILTER (k NOT IN (SELECT {2} FROM {1} WHERE {2} IS NOT NULL)) AS orphans FROM ({3}) q WHERE k IS NOT NULL"
    relations = [
        ("posts.replied_to_id", "posts", "id", "SELECT parent AS k FROM p"), ("insights_snapshots.post_id", "posts", "id", "SELECT post_id AS k FROM insights_snapshots"),
        ("post_spans.unit_id", "content_units", "id", "SELECT unit_id AS k FROM post_spans"), ("cluster_labels.unit_id", "content_units", "id", "SELECT unit_id AS k FROM cluster_labels"),
        ("cluster_labels.topic", "topics", "id", "SELECT topic_id AS k FROM tp"), ("topics.representatives", "content_units", "id", "SELECT k FROM rj"),
        ("unit_metrics.topic_id", "topics", "id", "SELECT topic_id AS k FROM unit_metrics"), ("distribution_stats.group_id", "topics", "id", "SELECT group_id AS k FROM distribution_stats"),
        ("subject_labels.doc_id", "documents", "doc_id", "SELECT doc_id AS k FROM subject_labels"), ("subject_labels.subject", "subject_areas", "subject", "SELECT subject AS k FROM subject_labels"),
    ]
    rj = ", rj AS (SELECT id AS topic_id, unnest(from_json(representative_ids_json, '[\"VARCHAR\"]')) AS k FROM topics WHERE json_valid(representative_ids_json) AND json_type(representative_ids_json) = 'ARRAY')"
    ari = "(s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0))"
    return {
        "pipeline_summary": _ROLES + """, tp AS (SELECT unit_id AS id, label FROM cl WHERE run_id = (SELECT max(run_id) FROM cl)), u AS (SELECT id, arg_max(full_text, built_at) AS t FROM content_units GROUP BY id),
rl AS (SELECT coalesce(role, 'unassigned') AS role FROM p LEFT JOIN ro USING (id)), nz AS (SELECT l.* FROM tp JOIN l ON l.post_id = tp.id WHERE label = -1), nr AS (SELECT 100.0::DOUBLE * (coalesce(likes, 0) + coalesce(replies, 0) + coalesce(reposts, 0) + coalesce(quotes, 0)) / views AS r FROM nz WHERE views > 0)
SELECT (SELECT count(*) FROM u) AS content_units, (SELECT count(*) FROM u WHERE trim(coalesce(t, '')) = '') AS units_without_text, (SELECT count(*) FROM rl WHERE role = 'continuation') AS continuation, (SELECT count(*) FROM rl WHERE role = 'answer') AS answer,
(SELECT count(*) FROM rl WHERE role = 'outbound') AS outbound, (SELECT count(*) FROM rl WHERE role = 'unassigned') AS unassigned, (SELECT max(fetched_at) FROM s) AS latest_snapshot_at, (SELECT count(*) FROM tp) AS n_units,
(SELECT count(DISTINCT label) FROM tp WHERE label >= 0) AS n_clusters, (SELECT count(*) FROM tp WHERE label = -1) AS n_noise, (SELECT round(count(*) FILTER (label = -1) / count(*), 6) FROM tp) AS noise_ratio, (SELECT count(*) FROM nz WHERE coalesce(views, 0) <= 0) AS noise_excluded_no_views,
(SELECT count(*) FROM nr) AS noise_n, coalesce((SELECT round(quantile_cont(r, 0.5), 6) FROM nr), 0) AS noise_median, coalesce((SELECT round(quantile_cont(r, 0.25), 6) FROM nr), 0) AS noise_iqr_low, coalesce((SELECT round(quantile_cont(r, 0.75), 6) FROM nr), 0) AS noise_iqr_high, (SELECT count(*) < 5 FROM nr) AS noise_insufficient""",
        "comparison_rows": of + f""", g AS (SELECT coalesce(topic_id, 'noise') AS g, l.* FROM tp JOIN l ON l.post_id = tp.id), k AS (SELECT unnest([g, 'channel']) AS group_id, g.* EXCLUDE g FROM g), w AS (SELECT group_id, unnest([{_metrics_sql("CASE WHEN views > 0 THEN " + _RATE + " END")}]) AS c FROM k),
a AS (SELECT group_id, c.metric AS metric, count(c.value) AS n, count(*) - count(c.value) AS excluded_no_views, coalesce(round(avg(c.value), 6), 0) AS mean, coalesce(round(quantile_cont(c.value, 0.5), 6), 0) AS median, coalesce(round(quantile_cont(c.value, 0.25), 6), 0) AS iqr_low, coalesce(round(quantile_cont(c.value, 0.75), 6), 0) AS iqr_high, count(c.value) < 5 AS insufficient_data FROM w GROUP BY 1, 2),
b AS (SELECT a.*, CASE WHEN group_id IN ('noise', 'channel') THEN group_id ELSE 'topic' END AS kind FROM a)
SELECT b.group_id, kind, b.metric, b.n, b.excluded_no_views, b.mean, b.median, b.iqr_low, b.iqr_high, b.insufficient_data, CASE WHEN kind = 'topic' THEN c.n - b.n END AS rest_n, CASE WHEN kind = 'topic' THEN c.excluded_no_views - b.excluded_no_views END AS rest_excluded,
(row_number() OVER (ORDER BY list_position(['engagement', 'share_rate', 'conversation'], b.metric), list_position(['topic', 'noise', 'channel'], kind), b.group_id))::INT AS place FROM b JOIN a c ON c.group_id = 'channel' AND c.metric = b.metric""",
        "run_verdicts": _verdicts() + "SELECT * FROM rv",
        "comparison_history": _verdicts() + """, h AS (SELECT run_id, string_agg(unit_id || ':' || label, ',' ORDER BY unit_id) AS m FROM cl GROUP BY 1), hk AS (SELECT run_id, CASE WHEN m = lag(m) OVER (ORDER BY run_id) THEN 0 ELSE 1 END AS s FROM h), hq AS (SELECT run_id, sum(s) OVER (ORDER BY run_id) AS pn FROM hk),
rp AS (SELECT max(run_id) AS run_id FROM hq WHERE run_id IN (SELECT run_id FROM rv) GROUP BY pn), z AS (SELECT rv.*, insufficient_data OR p_holm IS NULL OR delta IS NULL AS few FROM rv WHERE run_id IN (SELECT run_id FROM rp))
SELECT cluster AS group_id, metric, count(*) FILTER (NOT few) AS clusterings, count(*) FILTER (NOT few AND p_holm < 0.05 AND delta > 0) AS higher, count(*) FILTER (NOT few AND p_holm < 0.05 AND delta < 0) AS lower, count(*) FILTER (few) AS too_few, arg_min(run_id, run_id)::VARCHAR AS since FROM z GROUP BY 1, 2""",
        "masked_comparisons": _verdicts() + "SELECT run_id, cluster, metric, true AS stale, NULL::DOUBLE AS delta, NULL::DOUBLE AS p_holm FROM rv WHERE run_id = (SELECT max(run_id) FROM rv WHERE run_id < (SELECT max(run_id) FROM cl))",
        "conclusion_stability": _verdicts() + """, nw AS (SELECT max(run_id) AS n FROM cl), mb AS (SELECT unit_id, label::VARCHAR AS topic FROM cl, nw WHERE run_id = n AND label >= 0), ru AS (SELECT cl.* FROM cl, nw WHERE run_id < n),
pr AS (SELECT ru.run_id, topic, label, count(*) AS k FROM mb JOIN ru USING (unit_id) GROUP BY ALL), pm AS (SELECT run_id, topic, sum(k) AS pm FROM pr GROUP BY 1, 2), cm AS (SELECT run_id, label, count(*) AS cm FROM ru GROUP BY 1, 2),
jc AS (SELECT run_id, topic, label, k / (pm + cm - k) AS j FROM pr JOIN pm USING (run_id, topic) JOIN cm USING (run_id, label) WHERE label >= 0), bs AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY j DESC, label) AS r FROM jc),
kp AS (SELECT topic, metric, count(*) FILTER (j > 0.5 AND verdict = 'higher' AND delta > 0) AS higher, count(*) FILTER (j > 0.5 AND verdict = 'lower' AND delta < 0) AS lower FROM bs JOIN rv ON rv.run_id = bs.run_id AND rv.cluster = bs.label::VARCHAR WHERE r = 1 GROUP BY 1, 2),
ow AS (SELECT cluster AS topic, metric, verdict AS reference FROM rv, nw WHERE run_id = n), tt AS (SELECT count(DISTINCT run_id) AS total FROM ru), dd AS (SELECT unnest(['higher', 'lower']) AS direction),
ff AS (SELECT ow.topic, ow.metric, direction, reference, coalesce(CASE WHEN direction = 'higher' THEN higher ELSE lower END, 0) AS kept, total FROM ow LEFT JOIN kp ON kp.topic = ow.topic AND kp.metric = ow.metric, dd, tt)
SELECT *, reference = direction AND kept * 100 >= total * 75 AS passes FROM ff""",
        "agreement_summary": WITH + f""", ce AS (SELECT a.run_id AS ra, b.run_id AS rb, a.label AS la, b.label AS lb, count(*) AS n FROM cl a JOIN cl b ON a.unit_id = b.unit_id AND a.run_id < b.run_id GROUP BY ALL),
tt AS (SELECT ra, rb, sum(n) AS n, sum(n * (n - 1) / 2.0) AS s FROM ce GROUP BY 1, 2), xa AS (SELECT ra, rb, sum(k * (k - 1) / 2.0) AS sa FROM (SELECT ra, rb, la, sum(n) AS k FROM ce GROUP BY ALL) GROUP BY 1, 2), xb AS (SELECT ra, rb, sum(k * (k - 1) / 2.0) AS sb FROM (SELECT ra, rb, lb, sum(n) AS k FROM ce GROUP BY ALL) GROUP BY 1, 2),
ar AS (SELECT CASE WHEN rb = (SELECT max(run_id) FROM cl) THEN 'vs_newest' ELSE 'pairwise' END AS arm, ({ari})::DOUBLE AS ari FROM tt JOIN xa USING (ra, rb) JOIN xb USING (ra, rb))
SELECT arm, count(*) AS n, round(quantile_cont(ari, 0.5), 6) AS median, round(quantile_cont(ari, 0.25), 6) AS iqr_low, round(quantile_cont(ari, 0.75), 6) AS iqr_high FROM ar GROUP BY 1""",
        "reference_integrity": of + rj + " " + " UNION ALL ".join(relation.format(*x) for x in relations),
        "anchor_checks": plan + "SELECT * FROM ah",
        "topic_plan": plan + "SELECT * FROM pl",
        "topic_events": plan + "SELECT topic_id, CASE WHEN event = 'kept' AND reason IS NOT NULL THEN 'relabeled' ELSE event END AS event FROM pl UNION ALL SELECT DISTINCT topic, 'retired' FROM an WHERE topic NOT IN (SELECT topic_id FROM pl)",
        "post_rates": WITH + "SELECT id, " + ", ".join(f"CASE WHEN views > 0 THEN round({_RATE.format(e)}, 6) ELSE 0 END AS {k}" for k, e in _THREE.items()) + " FROM r",
        "dst_posts": WITH + "SELECT strftime(timezone('Europe/Paris', posted_at), '%Y-%m') AS month, epoch(timezone('Europe/Paris', posted_at)) - epoch(timezone('UTC', posted_at)) > 3600 AS dst, count(*) AS posts FROM p WHERE posted_at IS NOT NULL GROUP BY 1, 2",
        "language_info": """WITH x AS (SELECT doc_id, regexp_extract(lower(trim(lang)), '^(vi|fr|en)(?:$|[-_])', 1) AS code, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM documents WHERE text IS NOT NULL), tk AS (SELECT doc_id, code, unnest(t) AS token FROM x),
lb AS (SELECT code, token, count(*) AS c FROM tk WHERE code <> '' GROUP BY 1, 2), sz AS (SELECT code, sum(c) AS size FROM lb GROUP BY 1), rt AS (SELECT token, code, c, c / size AS rate FROM lb JOIN sz USING (code)),
bt AS (SELECT token, sum(c) AS met, sum(rate) AS al, max(struct_pack(rate := rate, code := code)) AS b FROM rt GROUP BY 1), kn AS (SELECT token, b.code AS code FROM bt WHERE met >= 3 AND b.rate >= 0.6 * al),
tg AS (SELECT doc_id, kn.code, count(*) AS c FROM tk LEFT JOIN kn USING (token) GROUP BY 1, 2), g AS (SELECT doc_id, sum(c) FILTER (code IS NOT NULL) AS n, max(struct_pack(c := c, code := code)) FILTER (code IS NOT NULL) AS b, string_agg(code, ',' ORDER BY code) AS detected FROM tg GROUP BY 1)
SELECT x.doc_id, CASE WHEN b.c / n >= 0.5 THEN b.code END AS primary_language, coalesce(detected, '') AS detected, round(coalesce(b.c / n, 0), 6)::DOUBLE AS confidence, round(coalesce(100.0::DOUBLE * (1 - b.c / n), 0), 6)::DOUBLE AS mix_score FROM (SELECT DISTINCT doc_id FROM x) x LEFT JOIN g USING (doc_id)""",
    }
