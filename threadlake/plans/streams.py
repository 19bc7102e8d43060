"""Queries that drive a stream over the tables to its end and give the resulting table."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.plans import base
from threadlake.plans.base import COUNTERS, WITH
from threadlake.sources import sinks
from threadlake.sources.tables import table
from threadlake.streaming import readings as st


def _stream(spark, d, name):
    t = table(spark, d, name)
    return st.stream(spark, f"{d}/{name}.parquet", t.schema), t


def stream_latest(spark, d):
    """Latest reading per post, kept up by a stream in update mode through an idempotent keyed sink."""
    s, _ = _stream(spark, d, "insights_snapshots")
    valid = s.filter(F.col("post_id").isNotNull() & F.col("fetched_at").isNotNull() & (F.col("fetched_at") < F.lit(base.UNTIL).cast("timestamp")) & F.col("views").isNotNull())
    out = st.work_folder(spark, "stream-latest")
    sink = st.upsert_sink(f"{out}/table", ["post_id"], "fetched_at")
    st.run_available(st.latest_state(valid.select("post_id", "fetched_at", *COUNTERS)).writeStream.outputMode("update").foreachBatch(sink), f"{out}/checkpoint")
    return sinks.KeyedTable(spark, f"{out}/table", ["post_id"], "fetched_at").read().select("post_id", "fetched_at", "views")


def stream_hourly(spark, d):
    """Events per hour and type from a complete-mode stream: equal to the batch aggregate."""
    s, _ = _stream(spark, d, "events")
    out = st.work_folder(spark, "stream-hourly")
    windows = s.withColumn("at", F.col("ts").cast("timestamp"))

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/table")

    q = windows.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
    st.run_available(q.writeStream.outputMode("complete").foreachBatch(write), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


def upserted_posts(spark, d):
    """Content units upserted by build time: the older half of the rows, then the newer."""
    u = table(spark, d, "content_units").select("id", "built_at", "language_primary").filter("id is not null")
    half = F.pmod(F.xxhash64("built_at"), F.lit(2)) == 0
    a, b = u.filter(half), u.filter(~half | half.isNull())
    return sinks.upsert(sinks.upsert(a.limit(0), a, ["id"], "built_at"), b, ["id"], "built_at").select("id", "built_at")


def kept_topics(spark, d):
    """Stored topics without any unit in the newest run: what a replacement would delete."""
    from threadlake.plans.threads import _topic_of

    used = _topic_of(spark, d).filter("topic_id is not null").select(F.col("topic_id").alias("id"))
    return sinks.keep_only(table(spark, d, "topics").select("id"), used, "id")[1]


def stale_results(spark, d):
    s = table(spark, d, "cluster_labels")
    return st.is_stale(s.filter("label >= 0").select("run_id"), s.select("run_id"))


QUERIES = (stream_latest, stream_hourly, upserted_posts, kept_topics, stale_results)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_latest": WITH + "SELECT post_id, fetched_at, views FROM l",
        "stream_hourly": "SELECT date_trunc('hour', ts)::TIMESTAMPTZ AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "upserted_posts": "SELECT id, max(built_at) AS built_at FROM content_units WHERE id IS NOT NULL GROUP BY id",
        "kept_topics": WITH + "SELECT id FROM topics WHERE id NOT IN (SELECT 'topic_' || label FROM cl WHERE label >= 0 AND run_id = (SELECT max(run_id) FROM cl))",
        "stale_results": "SELECT max(run_id) FILTER (label >= 0) AS done, max(run_id) AS newest, max(run_id) FILTER (label >= 0) < max(run_id) AS stale FROM cluster_labels",
    }
