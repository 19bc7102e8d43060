"""Topic against rest: rank sums, Holm families, permutation tests, simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import metrics
from threadlake.operators import significance as op
from threadlake.plans import base
from threadlake.plans.base import WITH
from threadlake.plans.lineage import Stages
from threadlake.plans.threads import _TOPIC, _topic_of


def _cells(spark, d):
    i = base.latest_insights(spark, d).withColumnRenamed("post_id", "id")
    return base.rates(_topic_of(spark, d).select("id", "topic_id").join(i, "id")).select("topic_id", "metric", F.round("value", 6).alias("value"))


def topic_effects(spark, d):
    """Cliff's delta, Mann-Whitney u and z of every topic and rate against the rest (noise is in the rest)."""
    r = op.rank_sums(_cells(spark, d), "topic_id", "metric", "value")
    return r.select("topic_id", "metric", "n", "n_rest", F.round("delta", 6).alias("delta"), F.round("u", 3).alias("u"), F.round("z", 6).alias("z"), "insufficient_data", metrics.win_share(F.round("delta", 6)).alias("win_share"))


def holm_verdicts(spark, d):
    """Holm over the family of all topics and rates on the normal Mann-Whitney p, and the verdict of each."""
    r = op.rank_sums(_cells(spark, d), "topic_id", "metric", "value").withColumn("p", F.round(metrics.normal_tail(F.col("z")), 9))
    h = op.holm(r, "p", [])
    return h.select("topic_id", "metric", "p", F.round("p_holm", 6).alias("p_holm"), metrics.verdict(F.col("p_holm"), F.col("delta"), F.col("insufficient_data")).alias("verdict"))


def topic_comparisons(spark, d):
    """The full comparison with the permutation test and its Holm family."""
    c = Stages(spark, "comparisons").keep(op.compare_groups(_cells(spark, d), "topic_id", "metric", "value"))
    return op.holm(c, "p", []).withColumn("verdict", metrics.verdict(F.col("p_holm"), F.col("delta"), F.col("insufficient_data")))


def replier_comparison(spark, d):
    """Roots whose author answered in the thread against the others, per rate: delta and z."""
    from threadlake.plans.threads import author_reply_events

    answered = author_reply_events(spark, d).select(F.col("root").alias("id")).distinct().withColumn("g", F.lit("answered"))
    rates = base.rates(base.measured_roots(spark, d)).select("id", "metric", F.round("value", 6).alias("value"))
    r = op.rank_sums(rates.join(answered, "id", "left"), "g", "metric", "value")
    return r.select("metric", "n", "n_rest", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"))


def spread_ratio(spark, d):
    """Interquartile range of each topic and rate over that of the whole channel."""
    from threadlake.operators.order_statistics import quantiles

    c = _cells(spark, d)
    points = {"q1": 0.25, "q3": 0.75}
    own = quantiles(c.filter("topic_id is not null"), ["topic_id", "metric"], "value", points)
    all_ = quantiles(c, ["metric"], "value", {"a1": 0.25, "a3": 0.75})
    return own.join(all_, "metric").select("topic_id", "metric", F.when(F.col("a3") > F.col("a1"), F.round((F.col("q3") - F.col("q1")) / (F.col("a3") - F.col("a1")), 6)).alias("ratio"))


def calibration(spark, d):
    """Rejections of the permutation test under the null with equal and unequal spread, and at a shift."""
    out = None
    for name, shift, spread in (("null", 0.0, 1.0), ("unequal_spread", 0.0, 3.0), ("shifted", 1.0, 1.0)):
        part = op.simulate_rejections(spark, 64, 8, 20, shift, spread).agg(F.count("*").alias("sims"), F.count_if("rejected").alias("rejections")).select(F.lit(name).alias("scenario"), "sims", "rejections")
        out = part if out is None else out.unionByName(part)
    low, high = metrics.wilson(F.col("rejections"), F.col("sims"))
    return out.select("*", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


QUERIES = (topic_effects, holm_verdicts, topic_comparisons, replier_comparison, spread_ratio, calibration)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: The normal tail of z by the same series, its terms from the gamma function.
TAIL = "CASE WHEN z IS NULL THEN NULL WHEN z = 0 THEN 1.0::DOUBLE ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 140), lambda i: exp(-least(z * z / 2, 36) + (2 * i + 1) * ln(least(abs(z) / sqrt(2.0::DOUBLE), 6)) + 2 * i * ln(2.0::DOUBLE) + lgamma(i + 1) - lgamma(2 * i + 2))))) END"


def _effects(cells: str) -> str:
    return f""",
e AS ({cells}),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY metric) AS total FROM e),
ti AS (SELECT metric, sum(t * t * t - t) AS tie_sum FROM (SELECT metric, value, count(*)::DOUBLE AS t FROM e GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT k.metric, topic_id, count(*) AS n, max(total) - count(*) AS m, max(total) AS total, sum(mid) - count(*) * (count(*) + 1) / 2.0 AS u, max(tie_sum) AS tie_sum FROM k JOIN ti ON ti.metric = k.metric WHERE topic_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, n * m / 12.0::DOUBLE * ((total + 1) - tie_sum / (total * (total - 1))) AS var, u - n * m / 2.0::DOUBLE AS dev FROM g),
ef AS (SELECT topic_id, metric, n, m AS n_rest, CASE WHEN m > 0 THEN 2 * u / (n * m)::DOUBLE - 1 END AS delta, CASE WHEN m > 0 THEN u END AS u,
         CASE WHEN m > 0 AND var > 0 THEN sign(dev) * greatest(abs(dev) - 0.5, 0) / sqrt(var) END AS z, least(n, m) < 5 AS insufficient_data FROM f)
"""


_CELLS = "SELECT topic_id, w.metric AS metric, round(w.value, 6) AS value FROM (SELECT topic_id, unnest([struct_pack(metric := 'engagement', value := 100.0::DOUBLE * (coalesce(likes, 0) + coalesce(replies, 0) + coalesce(reposts, 0) + coalesce(quotes, 0)) / views), struct_pack(metric := 'share_rate', value := 100.0::DOUBLE * (coalesce(reposts, 0) + coalesce(quotes, 0)) / views), struct_pack(metric := 'conversation', value := 100.0::DOUBLE * coalesce(replies, 0) / views)]) AS w FROM tp JOIN l ON l.post_id = tp.id WHERE views > 0)"


def oracle_sql() -> dict[str, str]:
    from threadlake.plans.threads import _ROLES

    effects = _TOPIC + _effects(_CELLS)
    return {
        "topic_effects": effects + "SELECT topic_id, metric, n, n_rest, round(delta, 6) AS delta, round(u, 3)::DOUBLE AS u, round(z, 6) AS z, insufficient_data, floor(100 * (1 + round(delta, 6)) / 2 + 0.5)::BIGINT AS win_share FROM ef",
        "holm_verdicts": effects + f", pp AS (SELECT *, round({TAIL}, 9) AS p FROM ef), hh AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(least(p * (count(p) OVER () - row_number() OVER (ORDER BY p, topic_id, metric) + 1), 1)) OVER (ORDER BY p, topic_id, metric ROWS UNBOUNDED PRECEDING) END AS p_holm FROM (SELECT * FROM pp) q) SELECT topic_id, metric, p, round(p_holm, 6) AS p_holm, CASE WHEN p_holm IS NULL OR delta IS NULL THEN 'not tested' WHEN insufficient_data THEN 'too few posts' WHEN p_holm >= 0.05 THEN 'not distinguishable' WHEN delta > 0 THEN 'higher' ELSE 'lower' END AS verdict FROM hh".replace("max(least(p * (count(p) OVER () - row_number() OVER (ORDER BY p, topic_id, metric) + 1), 1)) OVER (ORDER BY p, topic_id, metric ROWS UNBOUNDED PRECEDING)", "max(step) OVER (ORDER BY p, topic_id, metric ROWS UNBOUNDED PRECEDING)").replace("FROM (SELECT * FROM pp) q)", "FROM (SELECT *, least(p * (count(p) OVER () - row_number() OVER (ORDER BY p, topic_id, metric) + 1), 1) AS step FROM pp) q)"),
        "replier_comparison": _ROLES + ", an AS (SELECT DISTINCT root_ref AS id FROM p JOIN ro USING (id) WHERE own AND role <> 'continuation')" + _effects("SELECT CASE WHEN v.id IN (SELECT id FROM an) THEN 'answered' END AS topic_id, metric, round(value, 6) AS value FROM v") + "SELECT metric, n, n_rest, round(delta, 6) AS delta, round(z, 6) AS z FROM ef",
        "spread_ratio": _TOPIC + f", e AS ({_CELLS}), a AS (SELECT metric, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM e GROUP BY 1) SELECT topic_id, e.metric, CASE WHEN max(w) > 0 THEN round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / max(w), 6) END AS ratio FROM e JOIN a ON a.metric = e.metric WHERE topic_id IS NOT NULL GROUP BY 1, 2",
    }
