"""Reach, velocity and reading-coverage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators import reach as op
from threadlake.operators.order_statistics import value_ranks
from threadlake.operators.sessions import gap_batches
from threadlake.plans import base
from threadlake.plans.base import WITH


def _measured(spark, d) -> DataFrame:
    m = base.measured_roots(spark, d).filter(F.col("views") > 0)
    return m.select("id", "posted_at", "views", ((F.unix_micros("fetched_at") - F.unix_micros("posted_at")) / 8.64e10).alias("age_days"))


#: What a post's reach can be.
STATUSES = ("no_baseline", "maturity_unknown", "still_growing", "top_20", "above_median", "below_median")


def _times(spark, d) -> DataFrame:
    roots = base.posts(spark, d).filter(~F.col("is_reply") & F.col("parent").isNull())
    return op.maturity_times(base.readings(spark, d), roots)


def relative_reach(spark, d):
    out = op.relative_reach(_measured(spark, d))
    return out.select("id", F.col("position").cast("long").alias("position"), F.round("baseline", 6).alias("baseline"), F.round("ratio", 6).alias("ratio"), F.round("span_days", 6).alias("span_days"))


def maturity(spark, d):
    return op.maturity(_times(spark, d)).select(F.round("days", 6).alias("days"), "n_curves")


def reach_tiers(spark, d):
    return op.tiers(_measured(spark, d), op.maturity(_times(spark, d)))[0].select("id", F.round("ratio", 6).alias("ratio"), "status")


def reach_cutoffs(spark, d):
    c = op.tiers(_measured(spark, d), op.maturity(_times(spark, d)))[1]
    return c.select(*[F.round(x, 6).alias(x) for x in ("p50_ratio", "p80_ratio", "p50_views", "p80_views")], "n_tiered", "insufficient_data")


def reach_tier_counts(spark, d):
    """Posts per status; a status that no post has counts 0."""
    counts = reach_tiers(spark, d).groupBy("status").agg(F.count("*").alias("posts"))
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(counts, "status", "left").select("status", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"))


def view_velocity(spark, d):
    """Per post the change per hour between its two latest readings: views, and reposts with quotes.

    The two latest readings come from a bounded map-side merge (maximum, then maximum below it), not from a window over
    all readings of a post.
    """
    r = base.readings(spark, d).select("post_id", "fetched_at", "views", F.coalesce(F.col("reposts"), F.lit(0)).alias("reposts"), F.coalesce(F.col("quotes"), F.lit(0)).alias("quotes"))
    once = r.groupBy("post_id", "fetched_at").agg(F.max(F.struct("views", "reposts", "quotes")).alias("x"))
    last = once.groupBy("post_id").agg(F.max("fetched_at").alias("t2"))
    before = once.join(last, "post_id").filter(F.col("fetched_at") < F.col("t2")).groupBy("post_id").agg(F.max("fetched_at").alias("t1"))
    a = once.withColumnRenamed("fetched_at", "t2").join(last, ["post_id", "t2"]).select("post_id", "t2", F.col("x").alias("b"))
    b = before.join(once.select("post_id", F.col("fetched_at").alias("t1"), F.col("x").alias("a")), ["post_id", "t1"])
    hours = (F.unix_micros("t2") - F.unix_micros("t1")) / 3.6e9
    return a.join(b, "post_id").select(
        "post_id", F.round((F.col("b.views") - F.col("a.views")) / hours, 6).alias("views_per_hour"),
        F.round((F.col("b.reposts") + F.col("b.quotes") - F.col("a.reposts") - F.col("a.quotes")) / hours, 6).alias("amplification_per_hour"),
    )


def window_velocity(spark, d):
    """Least-squares slope of views over hours of all readings of a post, from three readings on; a mergeable aggregate."""
    roots = base.posts(spark, d).select(F.col("id").alias("post_id"), "posted_at")
    r = base.readings(spark, d).filter("views > 0").join(roots, "post_id").filter(F.col("fetched_at") >= F.col("posted_at"))
    hours = (F.unix_micros("fetched_at") - F.unix_micros("posted_at")) / 3.6e9
    out = r.groupBy("post_id").agg(F.regr_slope(F.col("views").cast("double"), hours).alias("slope"), F.count("*").alias("n"))
    return out.filter((F.col("n") >= 3) & F.col("slope").isNotNull()).select("post_id", F.round("slope", 4).alias("views_per_hour"), "n")


def snapshot_batches(spark, d):
    """Polling batches: a new one where no reading came for ten minutes or more; start, end, readings, posts."""
    b = gap_batches(base.readings(spark, d).select(F.col("fetched_at").alias("ts"), "post_id"), 600)
    return b.groupBy("batch").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("readings"), F.count_distinct("post_id").alias("posts")).drop("batch")


def readings_per_hour(spark, d):
    """Readings per author-zone hour of day."""
    return base.readings(spark, d).groupBy(F.hour(F.from_utc_timestamp("fetched_at", "Europe/Paris")).alias("hour")).agg(F.count("*").alias("readings"))


def long_gaps(spark, d):
    """Where no reading came for eight hours or more since the channel's first post: last reading before, hours."""
    began = base.posts(spark, d).agg(F.min("posted_at").alias("began"))
    r = base.readings(spark, d).crossJoin(F.broadcast(began)).filter(F.col("fetched_at") >= F.col("began")).select(F.col("fetched_at").alias("ts"))
    b = gap_batches(r, 8 * 3600).groupBy("batch").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    # one row per stretch without a long gap
    nxt = b.select("ended", F.lead("started").over(Window.orderBy("batch")).alias("next")).filter("next is not null")
    return nxt.select(F.col("ended").alias("last_reading"), F.round((F.unix_micros("next") - F.unix_micros("ended")) / 3.6e9, 4).alias("hours"))


def early_points(spark, d):
    """Root posts and how many distinct polling batches (``snapshot_batches``) read them in their first 24 hours."""
    roots = base.posts(spark, d).filter(~F.col("is_reply") & F.col("parent").isNull()).select("id", "posted_at")
    r = gap_batches(base.readings(spark, d).select(F.col("post_id").alias("id"), F.col("fetched_at").alias("ts")), 600)
    age = F.unix_micros("ts") - F.unix_micros("posted_at")
    inside = roots.join(r, "id").filter((age >= 0) & (age < F.lit(86_400_000_000))).groupBy("id").agg(F.count_distinct("batch").alias("k"))
    return roots.join(inside, "id", "left").groupBy(F.coalesce("k", F.lit(0)).cast("long").alias("points")).agg(F.count("*").alias("posts"))


def smallest_batches(spark, d):
    """The three batches with the fewest readings, earlier first on ties."""
    return snapshot_batches(spark, d).orderBy("readings", "started").limit(3).select("started", "readings")


def curve_shares(spark, d):
    """Backward as-of values: the views at ages 1, 3, 7 and 14 days (last reading not later) as a share of the latest."""
    roots = base.posts(spark, d).filter(~F.col("is_reply") & F.col("parent").isNull()).select(F.col("id").alias("post_id"), "posted_at")
    age = (F.unix_micros("fetched_at") - F.unix_micros("posted_at")) / 8.64e10
    r = base.readings(spark, d).filter("views > 0").join(roots, "post_id").select("post_id", age.alias("age"), "views").filter("age >= 0")
    asof = [F.max(F.when(F.col("age") <= n, F.struct("age", "views"))).alias(f"d{n}") for n in (1, 3, 7, 14)]
    g = r.groupBy("post_id").agg(F.max(F.struct("age", "views")).alias("last"), *asof)
    return g.select("post_id", *[F.round(F.col(f"d{n}.views") / F.col("last.views"), 6).alias(f"day_{n}") for n in (1, 3, 7, 14)])


def age_reach_spearman(spark, d):
    """Spearman correlation of views and age over measured root posts: correlation of mid-ranks."""
    m = _measured(spark, d).select("id", F.col("views").cast("double").alias("views"), F.round("age_days", 6).alias("age"))

    def mid(c):
        return value_ranks(m.select(c), [], c).select(F.col(c).alias(f"_{c}"), (F.col("_before") + (F.col("_c") - 1) / 2).alias(f"r_{c}"))

    both = m.join(mid("views"), F.col("views") == F.col("_views")).join(mid("age"), F.col("age") == F.col("_age"))
    return both.agg(F.round(F.corr("r_views", "r_age"), 6).alias("rho"), F.count("*").alias("n"))


QUERIES = (
    relative_reach, maturity, reach_tiers, reach_cutoffs, reach_tier_counts, view_velocity, window_velocity, snapshot_batches, readings_per_hour, long_gaps,
    early_points, smallest_batches, curve_shares, age_reach_spearman,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_REACH = WITH + """,
o AS (SELECT id, posted_at, views, (epoch_us(fetched_at) - epoch_us(posted_at)) / 8.64e10 AS age_days, row_number() OVER (ORDER BY posted_at, id) - 1 AS position FROM m),
b AS (SELECT a.id, a.position, a.posted_at, a.views, a.age_days, CASE WHEN a.position >= 10 THEN quantile_cont(b.views, 0.5) END AS baseline, min(b.posted_at) AS first_at
      FROM o a LEFT JOIN o b ON b.position BETWEEN a.position - 20 AND a.position - 1 GROUP BY a.id, a.position, a.posted_at, a.views, a.age_days),
q AS (SELECT *, views / baseline AS ratio, CASE WHEN position >= 10 THEN (epoch_us(posted_at) - epoch_us(first_at)) / 8.64e10 END AS span_days FROM b),
ag AS (SELECT post_id, (epoch_us(s.fetched_at) - epoch_us(p.posted_at)) / 8.64e10 AS age, views FROM s JOIN p ON p.id = s.post_id WHERE NOT is_reply AND parent IS NULL),
e AS (SELECT post_id, min(age) AS first_age, max(age) AS last_age, arg_max(views, (age, views)) AS last_views FROM ag GROUP BY post_id),
t AS (SELECT ag.post_id, min(age) AS days FROM ag JOIN e USING (post_id) WHERE first_age < 1 AND last_age >= 14 AND last_views > 0 AND ag.views >= 0.9::DOUBLE * last_views GROUP BY ag.post_id),
mt AS (SELECT quantile_cont(days, 0.9) AS days, count(*) AS n_curves FROM t),
ab AS (SELECT q.* FROM q, mt WHERE ratio IS NOT NULL AND days IS NOT NULL AND age_days >= days),
c AS (SELECT quantile_cont(ratio, 0.5) AS p50_ratio, quantile_cont(ratio, 0.8) AS p80_ratio, quantile_cont(views::DOUBLE, 0.5) AS p50_views, quantile_cont(views::DOUBLE, 0.8) AS p80_views, count(*) AS n_tiered, count(*) < 5 AS insufficient_data FROM ab),
z AS (SELECT id, ratio, CASE WHEN ratio IS NULL THEN 'no_baseline' WHEN days IS NULL THEN 'maturity_unknown' WHEN age_days < days THEN 'still_growing'
        WHEN ratio >= p80_ratio THEN 'top_20' WHEN ratio >= p50_ratio THEN 'above_median' ELSE 'below_median' END AS status FROM q, mt, c)
"""
_BATCH = WITH + """,
g AS (SELECT fetched_at, post_id, CASE WHEN epoch_us(fetched_at) - epoch_us(lag(fetched_at) OVER (ORDER BY fetched_at)) >= 600000000 THEN 1 ELSE 0 END AS brk FROM s),
h AS (SELECT *, sum(brk) OVER (ORDER BY fetched_at ROWS UNBOUNDED PRECEDING) AS batch FROM g),
bt AS (SELECT min(fetched_at) AS started, max(fetched_at) AS ended, count(*) AS readings, count(DISTINCT post_id) AS posts FROM h GROUP BY batch)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "relative_reach": _REACH + "SELECT id, position, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio, round(span_days, 6) AS span_days FROM q",
        "maturity": _REACH + "SELECT round(days, 6) AS days, n_curves FROM mt",
        "reach_tiers": _REACH + "SELECT id, round(ratio, 6) AS ratio, status FROM z",
        "reach_cutoffs": _REACH + "SELECT round(p50_ratio, 6) AS p50_ratio, round(p80_ratio, 6) AS p80_ratio, round(p50_views, 6) AS p50_views, round(p80_views, 6) AS p80_views, n_tiered, insufficient_data FROM c",
        "reach_tier_counts": _REACH + "SELECT w.status, count(z.id) AS posts FROM (SELECT unnest(['no_baseline', 'maturity_unknown', 'still_growing', 'top_20', 'above_median', 'below_median']) AS status) w LEFT JOIN z ON z.status = w.status GROUP BY 1",
        "view_velocity": WITH + ", o AS (SELECT post_id, fetched_at, max(struct_pack(v := views, p := coalesce(reposts, 0), q := coalesce(quotes, 0))) AS x FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY fetched_at DESC) AS n FROM o) SELECT b.post_id, round((b.x.v - a.x.v) / ((epoch_us(b.fetched_at) - epoch_us(a.fetched_at)) / 3.6e9), 6) AS views_per_hour, round((b.x.p + b.x.q - a.x.p - a.x.q) / ((epoch_us(b.fetched_at) - epoch_us(a.fetched_at)) / 3.6e9), 6) AS amplification_per_hour FROM k b JOIN k a ON a.post_id = b.post_id AND b.n = 1 AND a.n = 2",
        "window_velocity": WITH + ", w AS (SELECT post_id, regr_slope(views::DOUBLE, (epoch_us(s.fetched_at) - epoch_us(p.posted_at)) / 3.6e9) AS slope, count(*) AS n FROM s JOIN p ON p.id = s.post_id WHERE views > 0 AND s.fetched_at >= p.posted_at GROUP BY post_id HAVING count(*) >= 3 AND count(DISTINCT s.fetched_at) > 1) SELECT post_id, round(slope, 4) AS views_per_hour, n FROM w WHERE slope IS NOT NULL",
        "snapshot_batches": _BATCH + "SELECT * FROM bt",
        "readings_per_hour": WITH + "SELECT hour(timezone('Europe/Paris', fetched_at))::INT AS hour, count(*) AS readings FROM s GROUP BY 1",
        "long_gaps": WITH + ", q AS (SELECT fetched_at AS a, lead(fetched_at) OVER (ORDER BY fetched_at) AS b FROM s WHERE fetched_at >= (SELECT min(posted_at) FROM p)) SELECT a AS last_reading, round((epoch_us(b) - epoch_us(a)) / 3.6e9, 4) AS hours FROM q WHERE epoch_us(b) - epoch_us(a) >= 28800000000",
        "early_points": _BATCH + ", k AS (SELECT p.id, count(DISTINCT h.batch) FILTER (h.fetched_at >= p.posted_at AND epoch_us(h.fetched_at) - epoch_us(p.posted_at) < 86400000000) AS k FROM p LEFT JOIN h ON h.post_id = p.id WHERE NOT is_reply AND parent IS NULL GROUP BY p.id) SELECT k AS points, count(*) AS posts FROM k GROUP BY k",
        "smallest_batches": _BATCH + "SELECT started, readings FROM bt ORDER BY readings, started LIMIT 3",
        "curve_shares": WITH + ", a AS (SELECT s.post_id, (epoch_us(s.fetched_at) - epoch_us(p.posted_at)) / 8.64e10 AS age, views FROM s JOIN p ON p.id = s.post_id WHERE views > 0 AND NOT is_reply AND parent IS NULL AND s.fetched_at >= p.posted_at), g AS (SELECT post_id, arg_max(views, (age, views)) AS last, arg_max(views, (age, views)) FILTER (age <= 1) AS a1, arg_max(views, (age, views)) FILTER (age <= 3) AS a3, arg_max(views, (age, views)) FILTER (age <= 7) AS a7, arg_max(views, (age, views)) FILTER (age <= 14) AS a14 FROM a GROUP BY post_id) SELECT post_id, round(a1 / last, 6) AS day_1, round(a3 / last, 6) AS day_3, round(a7 / last, 6) AS day_7, round(a14 / last, 6) AS day_14 FROM g",
        "age_reach_spearman": WITH + ", a AS (SELECT views, round((epoch_us(fetched_at) - epoch_us(posted_at)) / 8.64e10, 6) AS age FROM m), k AS (SELECT rank() OVER (ORDER BY views) + (count(*) OVER (PARTITION BY views) - 1) / 2.0 AS rv, rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0 AS ra FROM a) SELECT round(corr(rv, ra), 6) AS rho, count(*) AS n FROM k",
    }
