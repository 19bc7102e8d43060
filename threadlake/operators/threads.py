"""Reply threads: roles, pre-order, units, depth, audience."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.hierarchy import build_forest, reached_paths
from threadlake.plans.lineage import Stages


def _own_chains(posts: DataFrame, with_paths: bool = False) -> DataFrame:
    """Forest rows (id, top, depth[, path]) of the roots and the author's own replies linked within one thread."""
    roots = posts.filter(~F.col("is_reply")).select("id", F.col("id").alias("root"), F.lit(None).cast("string").alias("parent"))
    own = posts.filter(F.col("is_reply") & F.col("own") & F.col("root_ref").isNotNull()).select("id", F.col("root_ref").alias("root"), "parent")
    nodes = roots.unionByName(own)
    inside = nodes.select(F.col("id").alias("parent"), F.col("root").alias("parent_root"))
    links = nodes.join(inside, "parent", "left").select(
        "id", F.when(F.col("parent_root") == F.col("root"), F.col("parent")).alias("replied_to_id"), F.col("root").alias("root_post_id"), (F.col("id") != F.col("root")).alias("is_reply")
    )
    return reached_paths(links) if with_paths else build_forest(links).reached.select("id", "top", "depth")


def reply_roles(posts: DataFrame) -> DataFrame:
    """id, root, role of every reply: continuation, answer or outbound.

    A continuation is the author's own reply whose parents are the author's own replies of the same root up to the root; a
    reply whose root is unknown is outbound; any other is an answer. Time plays no part. The chains come from the forest of
    own replies, whose rounds double their reach; circles are never reached.
    """
    roots = posts.filter(~F.col("is_reply")).select(F.col("id").alias("root"), F.lit(True).alias("known"))
    chains = _own_chains(posts).filter("depth > 0").select("id", "top")
    replies = posts.filter("is_reply").select("id", F.col("root_ref").alias("root"))
    marked = replies.join(roots, "root", "left").join(chains, "id", "left")
    chained = F.col("known") & (F.col("top") == F.col("root"))
    role = F.when(chained, "continuation").when(F.col("known").isNull(), "outbound").otherwise("answer")
    return marked.select("id", "root", role.alias("role"))


def content_units(posts: DataFrame) -> DataFrame:
    """id (root), continuation_ids in thread pre-order (siblings by time, then id), full_text (non-empty texts joined by a space).

    The sort key of a post is the list of (posted_at, id) from below the root down to it; lists compare element by element,
    which is exactly pre-order. Keys are gathered per post and posts per unit: a unit is one text in the end.
    """
    stages = Stages(posts.sparkSession, "units")
    roots = posts.filter(~F.col("is_reply")).select(F.col("id").alias("top"))
    paths = stages.keep(_own_chains(posts, with_paths=True).join(roots, "top", "left_semi").select("id", "top", "path"))
    steps = paths.select("id", F.posexplode(F.slice("path", 2, F.size("path"))).alias("k", "step"))
    when = posts.select(F.col("id").alias("step"), "posted_at")
    keys = steps.join(when, "step").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.struct("posted_at", "step").alias("at")))).alias("s")).select("id", F.col("s.at").alias("key"))
    rows = paths.select("id", "top").join(keys, "id", "left").join(posts.select("id", "text"), "id")
    none = F.array().cast("array<struct<posted_at:timestamp,step:string>>")
    parts = rows.groupBy("top").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("key", none).alias("key"), "id", "text"))).alias("p"))
    texts = F.filter("p.text", lambda t: t.isNotNull() & (t != ""))
    return parts.select(F.col("top").alias("id"), F.slice("p.id", 2, F.size("p")).alias("continuation_ids"), F.array_join(texts, " ").alias("full_text"))


def audience(posts: DataFrame, window_hours: float = 24.0) -> DataFrame:
    """root, unique_repliers, early_replies_per_hour of every root post; the author's own replies never count.

    A replier without a name counts by post id. Both are map-side combined; a hot root only yields partial sets.
    """
    if window_hours <= 0:
        raise ValueError("window_hours must be over 0")
    roots = posts.filter(~F.col("is_reply")).select(F.col("id").alias("root"), F.col("posted_at").alias("root_at"))
    replies = posts.filter(F.col("is_reply") & ~F.col("own")).select(F.col("root_ref").alias("root"), F.coalesce("username", "id").alias("who"), "posted_at")
    hours = (F.unix_micros("posted_at") - F.unix_micros("root_at")) / 3.6e9
    counted = replies.join(roots, "root").groupBy("root").agg(F.count_distinct("who").alias("u"), F.count_if((hours >= 0) & (hours <= window_hours)).alias("k"))
    return roots.join(counted, "root", "left").select("root", F.coalesce("u", F.lit(0)).cast("long").alias("unique_repliers"), (F.coalesce("k", F.lit(0)) / window_hours).alias("early_replies_per_hour"))


def reply_depth(posts: DataFrame) -> DataFrame:
    """root, depth: the longest chain of replies of the same root; a reply whose parent is outside its thread starts at 1.

    Chains through a circle never reach a start and add nothing.
    """
    replies = posts.filter("is_reply and root_ref is not null").select("id", "parent", "root_ref")
    inside = replies.select(F.col("id").alias("parent"), F.col("root_ref").alias("parent_root"))
    links = replies.join(inside, "parent", "left").select(
        "id", F.when(F.col("parent_root") == F.col("root_ref"), F.col("parent")).alias("replied_to_id"), F.col("root_ref").alias("root_post_id"), F.lit(True).alias("is_reply")
    )
    depth = build_forest(links).reached.select("id", "depth").join(replies.select("id", "root_ref"), "id").groupBy(F.col("root_ref").alias("root")).agg((F.max("depth") + 1).alias("depth"))
    roots = posts.filter(~F.col("is_reply")).select(F.col("id").alias("root"))
    return roots.join(depth, "root", "left").select("root", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
