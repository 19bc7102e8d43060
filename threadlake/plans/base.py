"""The entities most queries start from, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import metrics
from threadlake.sources.tables import latest_units, merged_posts, table

COUNTERS = ("views", "likes", "replies", "reposts", "quotes")
#: No reading can be later than this.
UNTIL = "2026-07-01 00:00:00"


def posts(spark: SparkSession, d: str) -> DataFrame:
    """Merged posts: id, text, posted_at, media_type, is_reply, own, root_ref, parent, username."""
    raw = merged_posts(table(spark, d, "posts"), "id", "text", "posted_at", "media_type", "is_reply", "is_reply_owned_by_me", "root_post_id", "replied_to_id", "username")
    return raw.select(
        "id", "text", "posted_at", "media_type", F.coalesce("is_reply", F.lit(False)).alias("is_reply"), F.coalesce("is_reply_owned_by_me", F.lit(False)).alias("own"),
        F.col("root_post_id").alias("root_ref"), F.col("replied_to_id").alias("parent"), "username",
    )


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with post, possible time and views."""
    return table(spark, d, "insights_snapshots").filter(
        F.col("post_id").isNotNull() & F.col("fetched_at").isNotNull() & (F.col("fetched_at") < F.lit(UNTIL).cast("timestamp")) & F.col("views").isNotNull()
    )


def latest_insights(spark: SparkSession, d: str) -> DataFrame:
    """The latest reading of each post: a map-side combined maximum instead of a lookup per post."""
    best = F.max(F.struct("fetched_at", *COUNTERS)).alias("x")
    return readings(spark, d).groupBy("post_id").agg(best).select("post_id", "x.*")


def measured_roots(spark: SparkSession, d: str) -> DataFrame:
    """Root posts with their latest reading: id, posted_at, media_type, fetched_at and the counters."""
    roots = posts(spark, d).filter(~F.col("is_reply") & F.col("parent").isNull()).select("id", "posted_at", "media_type", "text")
    return roots.join(latest_insights(spark, d).withColumnRenamed("post_id", "id"), "id")


def rates(df: DataFrame) -> DataFrame:
    """One row per post and rate: id, metric, value. Posts without measurement are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), f().alias("value")) for k, f in metrics.RATES.items()])
    return df.select(*[c for c in df.columns if c not in COUNTERS], F.explode(pairs).alias("r")).select(
        *[c for c in df.columns if c not in COUNTERS], "r.metric", "r.value"
    ).filter(F.col("value").isNotNull())


def units(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_units(table(spark, d, "content_units"), "id", *columns)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """run_id, unit_id, label: one label per run and unit (repeated rows count once, the greatest of contradicting ones)."""
    raw = table(spark, d, "cluster_labels").filter(F.col("run_id").isNotNull() & F.col("unit_id").isNotNull() & F.col("label").isNotNull())
    return raw.groupBy("run_id", "unit_id").agg(F.max("label").alias("label"))


SQL = r"""
p AS (SELECT id, max(text) AS text, max(posted_at) AS posted_at, max(media_type) AS media_type, coalesce(bool_or(is_reply), false) AS is_reply,
        coalesce(bool_or(is_reply_owned_by_me), false) AS own,
        max(nullif(regexp_replace(root_post_id, '^\s+|\s+$', '', 'g'), '')) AS root_ref,
        max(nullif(regexp_replace(replied_to_id, '^\s+|\s+$', '', 'g'), '')) AS parent, max(username) AS username
      FROM posts WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT * FROM insights_snapshots WHERE post_id IS NOT NULL AND fetched_at < TIMESTAMPTZ '2026-07-01 00:00:00+00' AND views IS NOT NULL),
l AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY fetched_at DESC, views DESC, likes DESC, replies DESC, reposts DESC, quotes DESC) AS k FROM s) WHERE k = 1),
r AS (SELECT p.id, p.posted_at, p.media_type, p.text, l.fetched_at, views, coalesce(likes, 0) AS likes, coalesce(replies, 0) AS replies, coalesce(reposts, 0) AS reposts, coalesce(quotes, 0) AS quotes
      FROM p JOIN l ON p.id = l.post_id WHERE NOT is_reply AND parent IS NULL),
m AS (SELECT *, 100.0::DOUBLE * (likes + replies + reposts + quotes) / views AS engagement, 100.0::DOUBLE * (reposts + quotes) / views AS share_rate,
        100.0::DOUBLE * replies / views AS conversation FROM r WHERE views > 0),
v AS (SELECT id, posted_at, 'engagement' AS metric, engagement AS value FROM m UNION ALL SELECT id, posted_at, 'share_rate', share_rate FROM m
      UNION ALL SELECT id, posted_at, 'conversation', conversation FROM m),
cl AS (SELECT run_id, unit_id, max(label) AS label FROM cluster_labels WHERE run_id IS NOT NULL AND unit_id IS NOT NULL AND label IS NOT NULL GROUP BY run_id, unit_id)
"""
WITH = "WITH " + SQL
