"""Thread, unit and topic-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import metrics
from threadlake.operators import threads as op
from threadlake.operators.order_statistics import distribution
from threadlake.plans import base
from threadlake.plans.base import WITH
from threadlake.sources.tables import table


def reply_roles(spark, d):
    return op.reply_roles(base.posts(spark, d)).select("id", "role")


def role_counts(spark, d):
    """Posts per role; roots are unassigned."""
    roles = op.reply_roles(base.posts(spark, d)).select("id", "role")
    return base.posts(spark, d).select("id").join(roles, "id", "left").groupBy(F.coalesce("role", F.lit("unassigned")).alias("role")).agg(F.count("*").alias("posts"))


def thread_units(spark, d):
    """Units rebuilt from the posts."""
    u = op.content_units(base.posts(spark, d))
    return u.select("id", F.array_join("continuation_ids", ",").alias("continuation_ids"), "full_text", F.sha2("full_text", 256).alias("content_hash"))


def unique_repliers(spark, d):
    return op.audience(base.posts(spark, d)).select("root", "unique_repliers", F.round("early_replies_per_hour", 6).alias("early_replies_per_hour"))


def reply_depth(spark, d):
    return op.reply_depth(base.posts(spark, d))


def author_reply_events(spark, d):
    """Own replies that are no continuation of their thread."""
    p = base.posts(spark, d)
    cont = op.reply_roles(p).filter("role = 'continuation'").select("id")
    return p.filter("is_reply and own").join(cont, "id", "left_anti").select("id", F.col("root_ref").alias("root"))


def _topic_of(spark, d):
    """unit, topic of the newest run; noise has no topic."""
    lab = base.labels(spark, d)
    last = lab.agg(F.max("run_id").alias("run_id"))
    return lab.join(F.broadcast(last), "run_id").select(F.col("unit_id").alias("id"), F.when(F.col("label") >= 0, F.concat(F.lit("topic_"), F.col("label"))).alias("topic_id"), "label")


def content_units(spark, d):
    """Every unit with metrics (null where unmeasured), topic and coordinates."""
    u = base.units(spark, d, "language_primary", "language_mix_score", "umap_x", "umap_y", "umap_z")
    i = base.latest_insights(spark, d).withColumnRenamed("post_id", "id")
    t = table(spark, d, "topics").select(F.col("id").alias("topic_id"), "label_en")
    j = u.join(i, "id", "left").join(_topic_of(spark, d), "id", "left").join(t, "topic_id", "left")
    return j.select("id", F.col("views").alias("popularity_index"), *[F.round(f(), 6).alias(k) for k, f in metrics.RATES.items()], "topic_id", "label_en", "language_primary", F.round("umap_x", 6).alias("x"), F.round("umap_y", 6).alias("y"), F.round("umap_z", 6).alias("z"))


def orphan_labels(spark, d):
    """Clustered units of the newest run whose topic is not stored: the integrity check of the label join."""
    t = table(spark, d, "topics").select(F.col("id").alias("topic_id")).distinct()
    return _topic_of(spark, d).filter(F.col("topic_id").isNotNull()).join(t, "topic_id", "left_anti").select("id", "topic_id")


def topic_profiles(spark, d):
    """Distributions of the three rates per topic of the newest run, of noise, and of the channel."""
    i = base.latest_insights(spark, d).withColumnRenamed("post_id", "id")
    cells = base.rates(_topic_of(spark, d).join(i, "id").withColumn("group_id", F.explode(F.array(F.coalesce("topic_id", F.lit("noise")), F.lit("channel")))))
    s = distribution(cells, ["group_id", "metric"], "value")
    return s.select("group_id", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "iqr_low", "iqr_high")], "insufficient_data")


def topic_totals(spark, d):
    """Views per topic and in all by grouping sets: topic rows and the channel row."""
    i = base.latest_insights(spark, d).withColumnRenamed("post_id", "id")
    j = _topic_of(spark, d).join(i, "id").withColumn("topic", F.coalesce("topic_id", F.lit("noise")))
    out = j.groupingSets([[F.col("topic")], []], F.col("topic")).agg(F.sum("views").cast("long").alias("views"), F.count("*").alias("units"))
    return out.select(F.coalesce("topic", F.lit("channel")).alias("group_id"), "views", "units")


def unit_listing(spark, d):
    """The first page of the unit list: topics in order of size, nearest to the topic's mean coordinates first, nulls last."""
    from pyspark.sql import Window

    u = base.units(spark, d, "umap_x", "umap_y", "umap_z").join(_topic_of(spark, d).filter("label >= 0"), "id")
    c = u.groupBy("topic_id").agg(*[F.avg(f"umap_{a}").alias(f"c{a}") for a in "xyz"], F.count("*").alias("size"))
    d2 = sum(((F.col(f"umap_{a}") - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    page = u.join(c, "topic_id").select("id", "topic_id", "size", F.round(F.sqrt(d2), 6).alias("distance"))
    top = page.orderBy(F.desc("size"), "topic_id", F.col("distance").asc_nulls_last(), "id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "topic_id", F.col("distance").asc_nulls_last(), "id"))).select("place", "id", "topic_id", "distance")


def json_lists(spark, d):
    """Topics with their parsed keywords and representatives; malformed or missing lists are empty."""
    t = table(spark, d, "topics")

    def parsed(c):
        return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))

    return t.select("id", F.size(parsed("keywords_json")).alias("keywords"), F.array_join(parsed("representative_ids_json"), ",").alias("representatives"))


def next_topic_number(spark, d):
    """One more than the greatest topic number in use or ever assigned (a distinct union)."""
    ids = table(spark, d, "topics").select("id").union(table(spark, d, "unit_metrics").filter("topic_id is not null").select(F.col("topic_id").alias("id"))).distinct()
    return ids.agg((F.max(F.regexp_extract("id", r"^topic_(\d+)$", 1).try_cast("long")) + 1).alias("next_number"))


QUERIES = (
    reply_roles, role_counts, thread_units, unique_repliers, reply_depth, author_reply_events, content_units, orphan_labels, topic_profiles, topic_totals,
    unit_listing, json_lists, next_topic_number,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_ROLES = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """,
rt AS (SELECT id FROM p WHERE NOT is_reply),
ch AS (SELECT id, id AS root, [] ::STRUCT(t TIMESTAMPTZ, i VARCHAR)[] AS key FROM rt
       UNION ALL SELECT p.id, ch.root, list_append(ch.key, struct_pack(t := p.posted_at, i := p.id)) FROM p JOIN ch ON p.parent = ch.id AND p.root_ref = ch.root WHERE p.is_reply AND p.own),
ro AS (SELECT id, root_ref AS root, CASE WHEN id IN (SELECT id FROM ch) THEN 'continuation' WHEN root_ref IS NULL OR root_ref NOT IN (SELECT id FROM rt) THEN 'outbound' ELSE 'answer' END AS role FROM p WHERE is_reply)
"""
_TOPIC = WITH + """,
tp AS (SELECT unit_id AS id, CASE WHEN label >= 0 THEN 'topic_' || label END AS topic_id, label FROM cl WHERE run_id = (SELECT max(run_id) FROM cl)),
u AS (SELECT id, arg_max(struct_pack(lang := language_primary, x := umap_x, y := umap_y, z := umap_z), built_at) AS q FROM content_units GROUP BY id)
"""


def oracle_sql() -> dict[str, str]:
    rate = "CASE WHEN views > 0 THEN round(100.0::DOUBLE * ({}) / views, 6) END AS {}"
    three = ", ".join(rate.format(e, n) for e, n in (("coalesce(likes, 0) + coalesce(replies, 0) + coalesce(reposts, 0) + coalesce(quotes, 0)", "engagement"), ("coalesce(reposts, 0) + coalesce(quotes, 0)", "share_rate"), ("coalesce(replies, 0)", "conversation")))
    return {
        "reply_roles": _ROLES + "SELECT id, role FROM ro",
        "role_counts": _ROLES + "SELECT coalesce(role, 'unassigned') AS role, count(*) AS posts FROM p LEFT JOIN ro USING (id) GROUP BY 1",
        "thread_units": _ROLES + ", un AS (SELECT root AS id, coalesce(string_agg(ch.id, ',' ORDER BY key) FILTER (ch.id <> root), '') AS continuation_ids, coalesce(string_agg(p.text, ' ' ORDER BY key) FILTER (p.text <> ''), '') AS full_text FROM ch JOIN p ON p.id = ch.id GROUP BY root) SELECT *, sha256(full_text) AS content_hash FROM un",
        "unique_repliers": WITH + ", a AS (SELECT r.id AS root, count(DISTINCT coalesce(c.username, c.id)) AS unique_repliers, count(c.id) FILTER (epoch_us(c.posted_at) - epoch_us(r.posted_at) BETWEEN 0 AND 86400000000) AS k FROM p r LEFT JOIN p c ON c.root_ref = r.id AND c.is_reply AND NOT c.own WHERE NOT r.is_reply GROUP BY r.id) SELECT root, unique_repliers, round(k / 24.0, 6)::DOUBLE AS early_replies_per_hour FROM a",
        "reply_depth": WITH.replace("WITH ", "WITH RECURSIVE ", 1) + ", q AS (SELECT a.id, a.root_ref AS root, b.id AS parent FROM p a LEFT JOIN p b ON a.parent = b.id AND b.is_reply AND b.root_ref = a.root_ref WHERE a.is_reply AND a.root_ref IS NOT NULL), dp AS (SELECT id, root, 1 AS depth FROM q WHERE parent IS NULL UNION ALL SELECT q.id, q.root, dp.depth + 1 FROM q JOIN dp ON q.parent = dp.id) SELECT p.id AS root, coalesce(max(depth), 0)::INT AS depth FROM p LEFT JOIN dp ON dp.root = p.id WHERE NOT is_reply GROUP BY p.id",
        "author_reply_events": _ROLES + "SELECT p.id, root_ref AS root FROM p JOIN ro USING (id) WHERE own AND role <> 'continuation'",
        "content_units": _TOPIC + f"SELECT u.id, views AS popularity_index, {three}, topic_id, label_en, q.lang AS language_primary, round(q.x, 6) AS x, round(q.y, 6) AS y, round(q.z, 6) AS z FROM u LEFT JOIN l ON l.post_id = u.id LEFT JOIN tp ON tp.id = u.id LEFT JOIN topics t ON t.id = tp.topic_id",
        "orphan_labels": _TOPIC + "SELECT id, topic_id FROM tp WHERE topic_id IS NOT NULL AND topic_id NOT IN (SELECT id FROM topics)",
        "topic_profiles": _TOPIC + ", g AS (SELECT tp.id, topic_id, l.* FROM tp JOIN l ON l.post_id = tp.id WHERE views > 0), k AS (SELECT unnest([coalesce(topic_id, 'noise'), 'channel']) AS group_id, g.* FROM g), w AS (SELECT group_id, unnest([struct_pack(metric := 'engagement', value := 100.0::DOUBLE * (coalesce(likes, 0) + coalesce(replies, 0) + coalesce(reposts, 0) + coalesce(quotes, 0)) / views), struct_pack(metric := 'share_rate', value := 100.0::DOUBLE * (coalesce(reposts, 0) + coalesce(quotes, 0)) / views), struct_pack(metric := 'conversation', value := 100.0::DOUBLE * coalesce(replies, 0) / views)]) AS c FROM k) SELECT group_id, c.metric AS metric, count(*) AS n, round(avg(c.value), 6) AS mean, round(quantile_cont(c.value, 0.5), 6) AS median, round(quantile_cont(c.value, 0.25), 6) AS iqr_low, round(quantile_cont(c.value, 0.75), 6) AS iqr_high, count(*) < 5 AS insufficient_data FROM w GROUP BY 1, 2",
        "topic_totals": _TOPIC + "SELECT CASE WHEN grouping(g) = 1 THEN 'channel' ELSE g END AS group_id, sum(views)::BIGINT AS views, count(*) AS units FROM (SELECT coalesce(topic_id, 'noise') AS g, views FROM tp JOIN l ON l.post_id = tp.id) GROUP BY GROUPING SETS ((g), ())",
        "unit_listing": _TOPIC + ", a AS (SELECT u.id, tp.topic_id, q.x AS x, q.y AS y, q.z AS z FROM u JOIN tp ON tp.id = u.id WHERE label >= 0), c AS (SELECT topic_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS size FROM a GROUP BY 1), k AS (SELECT id, a.topic_id, size, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 6) AS distance FROM a JOIN c USING (topic_id)) SELECT (row_number() OVER (ORDER BY size DESC, topic_id, distance NULLS LAST, id))::INT AS place, id, topic_id, distance FROM k ORDER BY place LIMIT 50",
        "json_lists": "SELECT id, coalesce(CASE WHEN json_valid(keywords_json) AND json_type(keywords_json) = 'ARRAY' THEN json_array_length(keywords_json) END, 0)::INT AS keywords, coalesce(CASE WHEN json_valid(representative_ids_json) AND json_type(representative_ids_json) = 'ARRAY' THEN array_to_string(from_json(representative_ids_json, '[\"VARCHAR\"]'), ',') END, '') AS representatives FROM topics",
        "next_topic_number": "SELECT max(try_cast(regexp_extract(id, '^topic_(\\d+)$', 1) AS BIGINT)) + 1 AS next_number FROM (SELECT id FROM topics UNION SELECT topic_id FROM unit_metrics WHERE topic_id IS NOT NULL)",
    }
