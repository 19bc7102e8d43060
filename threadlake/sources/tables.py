"""Reading the parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a DataFrame; the schema comes from the parquet footer, never inferred from rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_units(units: DataFrame, *columns: str) -> DataFrame:
    """One row per content unit: that of the latest ``built_at``.

    Uses a map-side combinable ``max(struct)``, so a unit delivered very often costs one row per task.
    Ties on ``built_at`` go to the greatest remaining columns; rows without id are left out; a row without
    ``built_at`` loses against any row with one.
    """
    rest = [c for c in columns if c not in ("id", "built_at")]
    picked = F.max(F.struct(F.col("built_at"), *[F.col(c) for c in rest])).alias("_u")
    return (
        units.select("id", "built_at", *rest)
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(picked)
        .select("id", *[F.col("_u")[c].alias(c) for c in columns if c != "id"])
    )


_SPACE = r"(?U)^\s+|\s+$"


def trimmed(column) -> F.Column:
    """A reference id without surrounding white space; an empty one is null."""
    return F.nullif(F.regexp_replace(column, _SPACE, ""), F.lit(""))


def merged_posts(posts: DataFrame, *columns: str) -> DataFrame:
    """One row per post id from repeated deliveries: a null is filled from another delivery.

    Deliveries never contradict each other, so ``max`` (which skips nulls and combines map-side) picks the value.
    ``replied_to_id`` and ``root_post_id`` come out trimmed. Rows without id are left out.
    """
    def value(c):
        return trimmed(F.col(c)) if c in ("replied_to_id", "root_post_id") else F.col(c)

    rest = [c for c in columns if c != "id"]
    return (
        posts.select("id", *[value(c).alias(c) for c in rest])
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(*[F.max(c).alias(c) for c in rest] or [F.lit(1).alias("_one")])
        .select("id", *rest)
    )
