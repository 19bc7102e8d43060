"""Exact ranks and quantiles of groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.metrics import SMALL_N
from threadlake.plans.lineage import Stages


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_rank`` (from 0, within the keys, by ``order``) and ``_n`` (rows of the key).

    Rows are range-partitioned by keys, order and the hash of the row, so a hot key and a hot value are spread over as many
    tasks as they need; each task sorts its range and numbers it. The ranks follow from the counts per (range, key), a table of
    at most ranges + keys rows. Where only values matter, ``value_ranks`` does with one row per distinct value.
    """
    stages = Stages(df.sparkSession, "ranked")
    names = [*[F.col(k) for k in keys], *order, F.xxhash64(*[F.col(c) for c in df.columns])]
    # Spark numbers the rows of a partition in the order it holds them
    numbered = stages.keep(df.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_m", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_range", F.shiftright("_m", 33))
    parts = numbered.groupBy("_range", *keys).agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = parts.select(
        "_range",
        *keys,
        "_first",
        (F.sum("_c").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
        F.sum("_c").over(by_key).alias("_n"),
    )
    offsets = offsets.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", "_before", "_n")
    cond = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(offsets, cond).select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("_rank"), "_n")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, ``_c`` (rows with the value), ``_before`` (rows of the key with a smaller one), ``_n`` (rows of the key).

    Rows are counted per distinct value map-side, so a value that half of all rows share is one row; the counts are summed up
    over a range partitioning of (key, value), within ranges first. Null values take no part.
    """
    stages = Stages(df.sparkSession, "values")
    names = [F.col(k) for k in keys]
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cells = stages.keep(cells.repartitionByRange(*names, F.col(value)).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy(*keys or [F.lit(0)])
    ranges = cells.groupBy("_range", *keys).agg(F.sum("_c").alias("_s"))
    ranges = ranges.select(
        F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_s",
        F.sum("_s").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_s").over(by_key).alias("_n"),
    )
    cond = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    before = F.sum("_c").over(inside) - F.col("_c")
    return cells.withColumn("_in", before).join(ranges, cond).select(*keys, value, "_c", (F.col("_upto") - F.col("_s") + F.col("_in")).alias("_before"), "_n")


def _point(value: str, q: float) -> Column:
    h = (F.col("_n") - 1) * F.lit(float(q))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")), F.col(value)))

    a, b = at(F.floor(h)), at(F.ceil(h))
    return a + (F.max(h) - F.max(F.floor(h))) * (b - a)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """keys and one column per point: linear interpolation between order statistics (type 7). Null values take no part."""
    return value_ranks(df.select(*keys, value), keys, value).groupBy(*keys).agg(*[_point(value, q).alias(name) for name, q in points.items()])


def distribution(df: DataFrame, keys: Sequence[str], value: str, small_n: int = SMALL_N, groups: DataFrame | None = None) -> DataFrame:
    """keys, n, mean, median, iqr_low, iqr_high, insufficient_data of the non-null values of each group.

    Groups without a value have no row, unless ``groups`` (keys) names them: they get zeros and the flag. All of it is one
    map-side combined aggregate over the counted values.
    """
    points = {"median": 0.5, "iqr_low": 0.25, "iqr_high": 0.75}
    n = F.sum("_c")
    out = value_ranks(df.select(*keys, value), keys, value).groupBy(*keys).agg(
        n.alias("n"), (F.sum(F.col(value) * F.col("_c")) / n).alias("mean"), *[_point(value, q).alias(k) for k, q in points.items()], (n < small_n).alias("insufficient_data")
    )
    if groups is None:
        return out
    named = groups.select(*keys).distinct()
    cond = [named[k].eqNullSafe(out[k]) for k in keys]
    filled = [F.coalesce(out[c], F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in ("n", "mean", *points)]
    return named.join(out, cond, "left").select(*[named[k] for k in keys], *filled, F.coalesce(out["insufficient_data"], F.lit(True)).alias("insufficient_data"))
