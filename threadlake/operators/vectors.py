"""Vectors: centroids, representatives, similarities, in JVM array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: renormalised mean of the unit vectors. One map-side combined sum per dimension, so a hot group
    costs a task one partial row per dimension."""
    parts = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(group, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg("x").alias("m"))
    lists = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))  # one entry per dimension
    return lists.select(group, unit(F.col("s.m")).alias("centroid"))


def nearest(vectors: DataFrame, group: str, key: str, vector: str, k: int = 3) -> DataFrame:
    """group, place, key, cosine: the k members nearest to their group's centroid; ties by key.

    The best k are taken per salted part first, so no window sees a whole hot group.
    """
    from pyspark.sql import Window

    c = centroids(vectors, group, vector)
    scored = vectors.join(c, group).select(group, key, F.round(dot(unit(F.col(vector)), F.col("centroid")), 9).alias("cosine"), F.pmod(F.xxhash64(key), F.lit(32)).alias("salt"))
    order = [F.desc("cosine"), F.col(key)]
    few = scored.withColumn("k", F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order))).filter(F.col("k") <= k)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= k).select(group, "place", key, "cosine")


def pairwise(centroid_table: DataFrame, group: str) -> DataFrame:
    """a, b, cosine of every pair of groups: a table of groups, not of members."""
    a = centroid_table.select(F.col(group).alias("a"), F.col("centroid").alias("va"))
    b = centroid_table.select(F.col(group).alias("b"), F.col("centroid").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", dot(F.col("va"), F.col("vb")).alias("cosine"))
