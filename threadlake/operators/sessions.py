"""Batches of events separated by gaps, over an order of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.plans.lineage import Stages


def gap_batches(events: DataFrame, gap_seconds: int) -> DataFrame:
    """``events`` (with column ``ts``) and ``batch``: a new batch begins where the gap to the event before is at least
    ``gap_seconds`` (Spark's session windows would still merge events exactly that far apart).

    Only distinct seconds with their first and last instant enter the ordering: events of a second are at most a second
    apart, so gaps can only lie between seconds. Those are range-partitioned; each range finds its own breaks, and the
    breaks at range borders follow from one row per range. Rows without ``ts`` are left out.
    """
    if gap_seconds < 1:
        raise ValueError("a gap shorter than a second is not supported")
    stages = Stages(events.sparkSession, "batches")
    timed = events.filter(F.col("ts").isNotNull()).withColumn("_s", F.unix_seconds("ts"))
    seconds = timed.groupBy("_s").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ranged = stages.keep(seconds.repartitionByRange("_s").withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range").agg(F.max("hi").alias("range_hi"))
    border = ends.select("_range", F.max("range_hi").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("border"))  # one row per range
    w = Window.partitionBy("_range").orderBy("_s")
    marked = ranged.join(F.broadcast(border), "_range")
    before = F.coalesce(F.lag("hi").over(w), F.col("border"))
    flagged = marked.select("_range", "_s", F.when(before.isNotNull() & (F.unix_micros("lo") - F.unix_micros(before) >= gap_seconds * 1_000_000), 1).otherwise(0).alias("brk"))
    inside = stages.keep(flagged.select("_range", "_s", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("k")))
    per_range = inside.groupBy("_range").agg(F.max("k").alias("n"))
    offset = per_range.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    numbers = inside.join(F.broadcast(offset), "_range").select("_s", (F.col("k") + F.col("off")).alias("batch"))
    return timed.join(numbers, "_s").drop("_s")
