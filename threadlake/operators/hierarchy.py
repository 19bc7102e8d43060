"""Parent-child links to full hierarchies: paths, depths, tops, descendants, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.plans.lineage import Stages
from threadlake.sources.tables import merged_posts


class Forest:
    """What ``build_forest`` found.

    ``reached``: id, top, depth, root_ref, true_root (the top is no reply and names no parent) of every node whose chain ends.
    ``cyclic``: id, top (smallest id on the circle), on_cycle of every node that no top reaches.
    """

    def __init__(self, reached: DataFrame, cyclic: DataFrame):
        self.reached, self.cyclic = reached, cyclic


def _circles(jump: DataFrame, stages: Stages) -> DataFrame:
    """id, top, on_cycle for nodes that each have exactly one successor inside the set.

    ``jump``: id, up (a successor some steps on), low (smallest id on the way, the node's own included). The table is
    squared until its image stops shrinking and no minimum moves: what is left of the image are the circles, and their
    nodes have seen the smallest id of their circle.
    """
    image = None
    while True:
        hop = jump.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("low").alias("low2"))
        squared = jump.join(hop, "up").select("id", F.col("far").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        squared = stages.keep(squared)
        now = squared.agg(F.count_distinct("up").alias("image"), F.count_if("moved").alias("moved")).first()
        jump = squared.drop("moved")
        if now["image"] == image and not now["moved"]:
            break
        image = now["image"]
    circle = jump.select(F.col("up").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    ends = jump.join(circle, "id").select(F.col("id").alias("up"), F.col("low").alias("top"))
    return jump.join(ends, "up").join(circle, "id", "left").select("id", "top", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _frontiers(tops: DataFrame, rest: DataFrame, stages: Stages, carried: list[str], segment: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Frontier joins from the tops downwards: what they reach, and what they do not.

    ``tops``: id, depth 0 and ``carried`` (what a node takes over from the node above it); ``rest``: id, up (the parent) and
    own columns. After round r every node less than 2**r levels deep is reached, and every other node points 2**r levels up:
    a node whose pointer meets a reached node is the next frontier, the others take over the pointer of the node they point
    at. One row per node and no pairs: a forest of n nodes and depth d costs at most n log2 d rows, and a round reads the
    reached rows and what is left (most nodes sit in the first levels). A round that reaches nothing ends it.
    ``segment`` names an array column of ``rest`` that grows along (the ids from below the node pointed at to the node).
    What is not reached keeps its pointer ``up`` and ``low``, the smallest id on the way there.
    """
    own = [c for c in rest.columns if c not in ("id", "up", segment)]
    reached, left, stride = [tops], rest.withColumn("low", F.col("id")), 1
    while True:
        above = [t.select(F.col("id").alias("up"), "depth", *carried, *([F.col("path").alias("_seg")] if segment else []), F.lit(None).cast("string").alias("_next"), F.lit(None).cast("string").alias("_low")) for t in reached]
        beside = left.select(F.col("id").alias("_id"), "low", *([F.col(segment).alias("_seg")] if segment else []), F.col("up").alias("_next"))
        none = [F.lit(None).cast(tops.schema[c].dataType).alias(c) for c in ("depth", *carried)]
        beside = beside.select(F.col("_id").alias("up"), *none, *(["_seg"] if segment else []), "_next", F.col("low").alias("_low"))
        known = beside
        for t in above:
            known = known.unionByName(t)
        found = left.join(known, "up").select(
            "id", (F.col("depth") + F.lit(stride)).cast("int").alias("depth"), *carried, *own, F.col("_next").alias("up"), F.least("low", "_low").alias("low"),
            *([F.concat("_seg", segment).alias("path")] if segment else []),
        )
        found, seen = stages.keep_and_count(found, new=F.count_if(F.col("up").isNull()), left=F.count_if(F.col("up").isNotNull()))
        if seen["new"]:
            reached.append(found.filter("up is null").drop("up", "low"))
        if not seen["new"] or not seen["left"]:
            break
        left = found.filter("up is not null").select("id", "up", "low", *own, *([F.col("path").alias(segment)] if segment else []))
        stride *= 2
    done = reached[0]
    for r in reached[1:]:
        done = done.unionByName(r)
    return done, found.filter("up is not null").select("id", "up", "low")


def build_forest(posts: DataFrame) -> Forest:
    """Tops, depths and circles of the reply chains, by frontier joins from the tops (``_frontiers``).

    A top is a node without a parent among the nodes. Nodes that no frontier reaches lie on a circle or run into one.

    Repeated deliveries of an id are merged first (see ``merged_posts``); ids are compared without surrounding white
    space, an empty parent is none; rows without id are left out; a post that replies to itself is a circle of one; empty
    tables give empty results. A null ``is_reply`` counts as false. Columns besides those named are ignored.

    Joins look a child's parent up, so a parent with a third of all children only makes one large probe partition, which
    adaptive execution splits; no group of children is ever gathered.
    """
    spark = posts.sparkSession
    stages = Stages(spark, "forest")
    merged = merged_posts(posts, "id", "replied_to_id", "root_post_id", "is_reply")
    base = stages.keep(
        merged.select("id", F.col("replied_to_id").alias("parent"), F.coalesce("is_reply", F.lit(False)).alias("is_reply"), F.col("root_post_id").alias("root_ref"))
    )
    ids = base.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = stages.keep(base.join(ids, "parent", "left").select("id", "parent", "is_reply", "root_ref", F.coalesce("known", F.lit(False)).alias("known")))
    true_root = F.col("parent").isNull() & ~F.col("is_reply")
    tops = nodes.filter(~F.col("known")).select("id", F.lit(0).alias("depth"), F.col("id").alias("top"), true_root.alias("true_root"), "root_ref")
    rest = nodes.filter("known").select("id", F.col("parent").alias("up"), "root_ref")
    reached, lost = _frontiers(tops, rest, stages, ["top", "true_root"])
    if lost.isEmpty():
        cyclic = spark.createDataFrame([], "id string, top string, on_cycle boolean")
    else:
        cyclic = _circles(lost, stages)
    return Forest(reached, cyclic)


def reached_paths(posts: DataFrame) -> DataFrame:
    """id, top, depth, path (array from the top to the node) of every node that a top reaches.

    Circular nodes are found first and left out, so every path that grows belongs to the result.
    """
    forest = build_forest(posts)
    stages = Stages(posts.sparkSession, "paths")
    parents = merged_posts(posts, "id", "replied_to_id").select("id", F.col("replied_to_id").alias("up"))
    tops = forest.reached.filter("depth = 0").select("id", "depth", F.col("id").alias("top"), F.array("id").alias("path"))
    rest = forest.reached.filter("depth > 0").select("id").join(parents, "id").select("id", "up", F.array("id").alias("seg"))
    return _frontiers(stages.keep(tops), stages.keep(rest), stages, ["top"], "seg")[0].select("id", "top", "depth", "path")


def chain_findings(posts: DataFrame) -> DataFrame:
    """post_id, kind, top_id, tree_depth of every post whose chain is broken, circular or labelled with a wrong root."""
    forest = build_forest(posts)
    right = F.col("root_ref").eqNullSafe(F.col("top")) | ((F.col("depth") == 0) & F.col("root_ref").isNull())
    broken = forest.reached.select(
        F.col("id").alias("post_id"),
        F.when(~F.col("true_root"), "lost_parent").when(~right, "wrong_root").alias("kind"),
        F.col("top").alias("top_id"),
        F.col("depth").alias("tree_depth"),
    ).filter(F.col("kind").isNotNull())
    circular = forest.cyclic.select(
        F.col("id").alias("post_id"), F.when(F.col("on_cycle"), "cycle").otherwise("into_cycle").alias("kind"), F.col("top").alias("top_id"), F.lit(-1).alias("tree_depth")
    )
    return broken.unionByName(circular)


def full_tree(posts: DataFrame) -> DataFrame:
    """id, top_id, tree_depth, path (ids joined by '/'), n_descendants of every post that a top reaches.

    Descendants are counted from ancestor pairs, pre-aggregated map-side, so a hot top costs one partial count per task.
    """
    reached = reached_paths(posts)
    below = reached.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("id")).groupBy("id").agg(F.count("*").alias("n_descendants"))
    return reached.join(below, "id", "left").select(
        "id", F.col("top").alias("top_id"), F.col("depth").alias("tree_depth"), F.array_join("path", "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants")
    )


def descendants(posts: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance: every pair along a chain that a top reaches (the sum of all depths)."""
    pairs = reached_paths(posts).select("id", "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("k", "ancestor_id"))
    return pairs.select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("k")).cast("int").alias("distance"))
