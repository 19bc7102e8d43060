"""Channel overview: rates, distributions, top lists, windows, daily views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import metrics
from threadlake.operators.order_statistics import distribution, quantiles
from threadlake.plans import base
from threadlake.plans.base import WITH
from threadlake.sources.tables import table

START, END = "2025-06-01", "2025-12-31"
TOP = 10


def _r(c, n: int = 6):
    return F.round(c, n)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: _r(F.col(c)) for c in names})


def post_metrics(spark, d):
    """Every root post with a reading: the four metrics and a standard error; null rates where nothing was measured."""
    m = base.measured_roots(spark, d)
    out = m.select("id", F.col("views").alias("popularity_index"), *[_r(f()).alias(k) for k, f in metrics.RATES.items()], metrics.engagement_rate().alias("e"))
    return out.withColumn("engagement_se", _r(metrics.rate_standard_error(F.col("e"), F.col("popularity_index")))).drop("e")


def freshness(spark, d):
    """Weight of each root post by its age at its latest reading."""
    m = base.measured_roots(spark, d)
    age = (F.unix_micros("fetched_at") - F.unix_micros("posted_at")) / 3.6e9
    return m.select("id", _r(metrics.freshness(age)).alias("weight"))


def measurable_split(spark, d):
    """Posts kept and dropped by the rule that zero views are no measurement."""
    return base.measured_roots(spark, d).agg(F.count_if(F.col("views") > 0).alias("kept"), F.count_if(F.col("views") <= 0).alias("excluded_no_views"))


def overview_distributions(spark, d):
    stats = distribution(base.rates(base.measured_roots(spark, d)), ["metric"], "value")
    return _rounded(stats, "mean", "median", "iqr_low", "iqr_high")


def _by_bucket(spark, d, bucket):
    m = base.measured_roots(spark, d).filter(F.col("views") > 0)
    zones = F.explode(F.array(F.lit(metrics.AUTHOR_ZONE), F.lit(metrics.METRIC_ZONE))).alias("zone")
    cells = m.select(zones, "posted_at", metrics.engagement_rate().alias("value")).select("zone", bucket(F.expr("from_utc_timestamp(posted_at, zone)")).alias("bucket"), "value")
    return _rounded(distribution(cells, ["zone", "bucket"], "value"), "mean", "median", "iqr_low", "iqr_high")


def engagement_by_hour(spark, d):
    return _by_bucket(spark, d, F.hour)


def engagement_by_weekday(spark, d):
    """Monday is 0."""
    return _by_bucket(spark, d, F.weekday)


def top_posts(spark, d):
    """The ten highest of each rate among posts with at least the lower quartile of views; ties by id.

    The floor is one value per query; the top list is taken per metric from per-task top lists (rank limit pushed down).
    """
    m = base.measured_roots(spark, d).filter(F.col("views") > 0)
    floor = quantiles(m.withColumn("views", F.col("views").cast("double")), [], "views", {"floor": 0.25})
    kept = base.rates(m.withColumn("seen", F.col("views"))).crossJoin(F.broadcast(floor)).filter(F.col("seen") >= F.coalesce("floor", F.lit(0.0)))
    w = Window.partitionBy("metric").orderBy(F.desc(_r(F.col("value"))), "id")
    return kept.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= TOP).select("metric", F.col("k").alias("place"), "id", _r(F.col("value")).alias("value"))


def views_floor(spark, d):
    m = base.measured_roots(spark, d).filter(F.col("views") > 0).select(F.col("views").cast("double").alias("views"))
    return quantiles(m, [], "views", {"views_floor": 0.25})


def window_summary(spark, d):
    """Roots posted between two author days, inclusive: totals (zero-view posts count) and medians of the rates."""
    m = base.measured_roots(spark, d)
    day = metrics.local_day(F.col("posted_at"), metrics.AUTHOR_ZONE)
    inside = m.filter(day.between(F.lit(START).cast("date"), F.lit(END).cast("date")))
    totals = inside.agg(F.count("*").alias("posts"), F.coalesce(F.sum(metrics.interactions()), F.lit(0)).cast("long").alias("interactions"), F.coalesce(F.sum("views"), F.lit(0)).cast("long").alias("views"), F.count_if(F.col("views") <= 0).alias("excluded_no_views"))
    med = distribution(base.rates(inside), ["metric"], "value")
    return med.crossJoin(F.broadcast(totals)).select("metric", "posts", "interactions", "views", "excluded_no_views", "n", _r(F.col("median")).alias("median"))


def _daily(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.groupBy(metrics.local_day(F.col("ts").cast("timestamp"), metrics.METRIC_ZONE).alias("day")).agg(F.count("*").alias("views"))


def daily_views(spark, d):
    """View events per day of the metric zone."""
    return _daily(spark, d)


def peak_week(spark, d):
    """The earliest seven consecutive rows of the daily series with the greatest sum. One row per calendar day: the series is bounded by time."""
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-6, 0)
    sums = _daily(spark, d).select("day", F.sum("views").over(w).alias("views"), F.count("*").over(w).alias("k"), F.min("day").over(w).alias("first_day")).filter("k = 7")
    return sums.orderBy(F.desc("views"), "day").limit(1).select("first_day", F.col("day").alias("last_day"), "views")


def day_mismatch(spark, d):
    """Root posts whose author day is not their metric day, and those posted in summer time of the author zone."""
    at = F.col("posted_at")
    return base.measured_roots(spark, d).agg(
        F.count_if(metrics.local_day(at, metrics.AUTHOR_ZONE) != metrics.local_day(at, metrics.METRIC_ZONE)).alias("mismatches"),
        F.count_if(metrics.is_dst(at, metrics.AUTHOR_ZONE)).alias("in_summer_time"),
        F.count("*").alias("posts"),
    )


def documents_per_month(spark, d):
    docs = table(spark, d, "documents").filter(F.col("posted_at").isNotNull())
    return docs.groupBy(metrics.local_month(F.col("posted_at")).alias("month")).agg(F.count("*").alias("documents"))


def media_counts(spark, d):
    """Posts per media type of the fixed list, zero-filled; an unknown or missing type counts as UNKNOWN."""
    kinds = ["AUDIO", "CAROUSEL_ALBUM", "IMAGE", "REPOST_FACADE", "TEXT_POST", "UNKNOWN", "VIDEO"]
    domain = spark.createDataFrame([(k,) for k in kinds], "media_type string")
    known = F.when(F.col("media_type").isin(kinds), F.col("media_type")).otherwise("UNKNOWN")
    counts = base.posts(spark, d).groupBy(known.alias("media_type")).agg(F.count("*").alias("n"))
    return domain.join(counts, "media_type", "left").select("media_type", F.coalesce("n", F.lit(0)).cast("long").alias("posts"))


def rank_among_others(spark, d):
    """Per root post: posts with a lower engagement, other posts, floor percent below."""
    from threadlake.operators.order_statistics import value_ranks

    m = base.measured_roots(spark, d).filter(F.col("views") > 0).select("id", _r(metrics.engagement_rate()).alias("value"))
    ranks = value_ranks(m, [], "value").withColumnRenamed("_before", "below")
    return m.join(ranks, "value").select("id", "below", (F.col("_n") - 1).alias("others"), F.when(F.col("_n") > 1, F.floor(100 * F.col("below") / (F.col("_n") - 1))).cast("long").alias("percent_below"))


def scaled_coordinates(spark, d):
    """Coordinates scaled to 0-100 over all units; a span of 0 counts as 1."""
    u = base.units(spark, d, "umap_x", "umap_y", "umap_z").filter("umap_x is not null and umap_y is not null and umap_z is not null")
    bounds = u.agg(*[f(F.col(f"umap_{a}")).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    j = u.crossJoin(F.broadcast(bounds))
    span = {a: F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"}
    return j.select("id", *[_r(100 * (F.col(f"umap_{a}") - F.col(f"lo_{a}")) / F.when(span[a] == 0, 1.0).otherwise(span[a])).alias(f"s{a}") for a in "xyz"])


QUERIES = (
    post_metrics, freshness, measurable_split, overview_distributions, engagement_by_hour, engagement_by_weekday, top_posts, views_floor, window_summary,
    daily_views, peak_week, day_mismatch, documents_per_month, media_counts, rank_among_others, scaled_coordinates,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_STATS = "count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS iqr_low, round(quantile_cont(value, 0.75), 6) AS iqr_high, count(*) < 5 AS insufficient_data"


def _bucket(expr: str) -> str:
    return WITH + f", z AS (SELECT unnest(['Europe/Paris', 'America/Los_Angeles']) AS zone) SELECT zone, {expr} AS bucket, {_STATS} FROM (SELECT zone, timezone(zone, posted_at) AS t, value FROM v, z WHERE metric = 'engagement') GROUP BY zone, bucket"


_DAILY = "WITH dv AS (SELECT timezone('America/Los_Angeles', timezone('UTC', ts))::DATE AS day, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "post_metrics": WITH + "SELECT id, views AS popularity_index, CASE WHEN views > 0 THEN round(100.0::DOUBLE * (likes + replies + reposts + quotes) / views, 6) END AS engagement, CASE WHEN views > 0 THEN round(100.0::DOUBLE * (reposts + quotes) / views, 6) END AS share_rate, CASE WHEN views > 0 THEN round(100.0::DOUBLE * replies / views, 6) END AS conversation, CASE WHEN views > 0 THEN round(100 * sqrt(greatest((likes + replies + reposts + quotes)::DOUBLE / views * (1 - (likes + replies + reposts + quotes)::DOUBLE / views), 0) / views), 6) END AS engagement_se FROM r",
        "freshness": WITH + "SELECT id, round(CASE WHEN a <= 12 THEN 1.0 ELSE pow(0.5, (a - 12) / 48) END, 6)::DOUBLE AS weight FROM (SELECT id, greatest((epoch_us(fetched_at) - epoch_us(posted_at)) / 3.6e9, 0) AS a FROM r)",
        "measurable_split": WITH + "SELECT count(*) FILTER (views > 0) AS kept, count(*) FILTER (views <= 0) AS excluded_no_views FROM r",
        "overview_distributions": WITH + f"SELECT metric, {_STATS} FROM v GROUP BY metric",
        "engagement_by_hour": _bucket("hour(t)::INT"),
        "engagement_by_weekday": _bucket("(isodow(t) - 1)::INT"),
        "top_posts": WITH + ", f AS (SELECT quantile_cont(views, 0.25) AS floor FROM m) SELECT metric, place::INT AS place, id, value FROM (SELECT v.metric, v.id, round(v.value, 6) AS value, row_number() OVER (PARTITION BY v.metric ORDER BY round(v.value, 6) DESC, v.id) AS place FROM v JOIN m USING (id), f WHERE m.views >= floor) WHERE place <= 10",
        "views_floor": WITH + "SELECT quantile_cont(views::DOUBLE, 0.25) AS views_floor FROM m",
        "window_summary": WITH + ", w AS (SELECT * FROM r WHERE timezone('Europe/Paris', posted_at)::DATE BETWEEN DATE '2025-06-01' AND DATE '2025-12-31'), t AS (SELECT count(*) AS posts, coalesce(sum(likes + replies + reposts + quotes), 0)::BIGINT AS interactions, coalesce(sum(views), 0)::BIGINT AS views, count(*) FILTER (views <= 0) AS excluded_no_views FROM w) SELECT metric, posts, interactions, t.views, excluded_no_views, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM v JOIN w USING (id), t GROUP BY ALL",
        "daily_views": _DAILY + " SELECT day, views FROM dv",
        "peak_week": _DAILY + ", q AS (SELECT day, sum(views) OVER w AS views, count(*) OVER w AS k, min(day) OVER w AS first_day FROM dv WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT first_day, day AS last_day, views::BIGINT AS views FROM q WHERE k = 7 ORDER BY views DESC, day LIMIT 1",
        "day_mismatch": WITH + "SELECT count(*) FILTER (timezone('Europe/Paris', posted_at)::DATE <> timezone('America/Los_Angeles', posted_at)::DATE) AS mismatches, count(*) FILTER (epoch(timezone('Europe/Paris', posted_at)) - epoch(posted_at) > 3600) AS in_summer_time, count(*) AS posts FROM r",
        "documents_per_month": "SELECT strftime(timezone('Europe/Paris', posted_at), '%Y-%m') AS month, count(*) AS documents FROM documents WHERE posted_at IS NOT NULL GROUP BY 1",
        "media_counts": WITH + ", k AS (SELECT unnest(['AUDIO', 'CAROUSEL_ALBUM', 'IMAGE', 'REPOST_FACADE', 'TEXT_POST', 'UNKNOWN', 'VIDEO']) AS media_type), c AS (SELECT coalesce((SELECT media_type FROM k WHERE k.media_type = p.media_type), 'UNKNOWN') AS media_type FROM p) SELECT k.media_type, count(c.media_type) AS posts FROM k LEFT JOIN c ON k.media_type = c.media_type GROUP BY 1",
        "rank_among_others": WITH + "SELECT id, rank() OVER (ORDER BY e) - 1 AS below, count(*) OVER () - 1 AS others, CASE WHEN count(*) OVER () > 1 THEN floor(100 * (rank() OVER (ORDER BY e) - 1) / (count(*) OVER () - 1))::BIGINT END AS percent_below FROM (SELECT id, round(engagement, 6) AS e FROM m)",
        "scaled_coordinates": "WITH u AS (SELECT id, arg_max(struct_pack(x := umap_x, y := umap_y, z := umap_z), built_at) AS q FROM content_units GROUP BY id), c AS (SELECT id, q.x AS x, q.y AS y, q.z AS z FROM u WHERE q.x IS NOT NULL AND q.y IS NOT NULL AND q.z IS NOT NULL), b AS (SELECT min(x) AS lx, max(x) - min(x) AS dx, min(y) AS ly, max(y) - min(y) AS dy, min(z) AS lz, max(z) - min(z) AS dz FROM c) SELECT id, round(100 * (x - lx) / CASE WHEN dx = 0 THEN 1 ELSE dx END, 6) AS sx, round(100 * (y - ly) / CASE WHEN dy = 0 THEN 1 ELSE dy END, 6) AS sy, round(100 * (z - lz) / CASE WHEN dz = 0 THEN 1 ELSE dz END, 6) AS sz FROM c, b",
    }
