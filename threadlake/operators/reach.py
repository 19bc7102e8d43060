"""Growth-adjusted reach: baselines over preceding posts, maturity, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.metrics import SMALL_N
from threadlake.operators.order_statistics import quantiles, ranked

#: Fixed values of the method.
BASELINE_WINDOW, BASELINE_MIN_PRIOR = 20, 10
MATURITY_SHARE, MATURITY_QUANTILE = 0.9, 0.9
FIRST_READING_DAYS, SETTLED_DAYS = 1.0, 14.0
BLOCK = 4096


def relative_reach(posts: DataFrame, window: int = BASELINE_WINDOW, min_prior: int = BASELINE_MIN_PRIOR) -> DataFrame:
    """posts (id, posted_at, views, ...) with position, baseline, ratio, span_days.

    The baseline is the median views of up to ``window`` posts published just before (itself excluded), null with fewer than
    ``min_prior``. Rows need views over 0. Order is by posted_at, then id.

    The publish order is cut into blocks of ``BLOCK`` positions; each block also gets the last ``window`` rows of the one
    before it, so windows are computed per block and no task sees the whole order.
    """
    rows = ranked(posts, [], [F.col("posted_at"), F.col("id")]).withColumnRenamed("_rank", "position").drop("_n")
    blocks = F.explode(F.array_distinct(F.array(F.floor(F.col("position") / BLOCK), F.floor((F.col("position") + window) / BLOCK)))).alias("block")
    spread = rows.select("*", blocks)
    w = Window.partitionBy("block").orderBy("position").rowsBetween(-window, -1)
    known = F.col("position") >= min_prior
    out = spread.select(
        "*",
        F.when(known, F.expr("percentile(views, 0.5)").over(w)).alias("baseline"),
        F.when(known, (F.unix_micros("posted_at") - F.unix_micros(F.first("posted_at").over(w))) / 8.64e10).alias("span_days"),
    )
    own = out.filter(F.floor(F.col("position") / BLOCK) == F.col("block")).drop("block")
    return own.withColumn("ratio", F.col("views") / F.col("baseline"))


def maturity_times(readings: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, days until 90 % of the latest views, of curves seen within a day and for at least 14 days.

    ``readings``: post_id, fetched_at, views; ``posts``: id, posted_at. The target is joined back per post, so a post with
    very many readings only yields partial minima.
    """
    aged = readings.join(posts.select(F.col("id").alias("post_id"), "posted_at"), "post_id").select(
        "post_id", ((F.unix_micros("fetched_at") - F.unix_micros("posted_at")) / 8.64e10).alias("age"), "views"
    )
    ends = aged.groupBy("post_id").agg(F.min("age").alias("first_age"), F.max(F.struct("age", "views")).alias("x")).select("post_id", "first_age", F.col("x.age").alias("last_age"), F.col("x.views").alias("last_views"))
    good = ends.filter((F.col("first_age") < FIRST_READING_DAYS) & (F.col("last_age") >= SETTLED_DAYS) & (F.col("last_views") > 0))
    return aged.join(good, "post_id").filter(F.col("views") >= MATURITY_SHARE * F.col("last_views")).groupBy("post_id").agg(F.min("age").alias("days"))


def maturity(times: DataFrame) -> DataFrame:
    """days (90th percentile, null without a curve), n_curves: one row."""
    return quantiles(times, [], "days", {"days": MATURITY_QUANTILE}).crossJoin(times.agg(F.count("*").alias("n_curves")))


def tiers(posts: DataFrame, maturity_row: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with status, cutoffs): top_20, above_median, below_median, still_growing, no_baseline, maturity_unknown.

    ``posts`` needs id, posted_at, views, age_days (at the reading). The status is the first of: no baseline, unknown
    maturity, not mature, then the tier by the 80th and 50th percentile of the ratio over all mature posts.
    """
    reach = relative_reach(posts).crossJoin(F.broadcast(maturity_row.withColumnRenamed("days", "maturity_days")))  # one row
    from threadlake.plans.lineage import Stages

    reach = Stages(posts.sparkSession, "reach").keep(reach)
    able = reach.filter(F.col("ratio").isNotNull() & F.col("maturity_days").isNotNull() & (F.col("age_days") >= F.col("maturity_days")))
    points = {"p50": 0.5, "p80": 0.8}
    by_ratio = quantiles(able, [], "ratio", {f"{k}_ratio": q for k, q in points.items()})
    by_views = quantiles(able.withColumn("views", F.col("views").cast("double")), [], "views", {f"{k}_views": q for k, q in points.items()})
    n = able.agg(F.count("*").alias("n_tiered"), (F.count("*") < SMALL_N).alias("insufficient_data"))
    cutoffs = by_ratio.crossJoin(by_views).crossJoin(n)  # one row each
    status = (
        F.when(F.col("ratio").isNull(), "no_baseline")
        .when(F.col("maturity_days").isNull(), "maturity_unknown")
        .when(F.col("age_days") < F.col("maturity_days"), "still_growing")
        .when(F.col("ratio") >= F.col("p80_ratio"), "top_20")
        .when(F.col("ratio") >= F.col("p50_ratio"), "above_median")
        .otherwise("below_median")
    )
    return reach.crossJoin(F.broadcast(cutoffs)).withColumn("status", status), cutoffs
