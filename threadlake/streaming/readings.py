"""Structured Streaming over readings: latest state, late corrections, batches, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.plans.lineage import shared_folder
from threadlake.sources.sinks import KeyedTable, upsert

#: Corrections of a daily value arrive for so long.
LATE = "7 days"


def stream(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    """A folder of parquet files (or one file) as a stream; files are taken in bounded groups."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(folder)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def run_available(query_writer, checkpoint: str) -> None:
    """Runs what has arrived and ends; the checkpoint makes a rerun continue where it stopped."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def append_readings(readings: DataFrame, out: str, checkpoint: str) -> None:
    """The append-only snapshot table; a reading delivered again within the watermark is written once."""
    once = readings.withWatermark("fetched_at", LATE).dropDuplicatesWithinWatermark(["post_id", "fetched_at"])
    run_available(once.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def latest_state(readings: DataFrame) -> DataFrame:
    """The newest reading per post, for update mode: the state is one row per post."""
    counters = [c for c in readings.columns if c not in ("post_id", "fetched_at")]
    return readings.groupBy("post_id").agg(F.max(F.struct("fetched_at", *counters)).alias("x")).select("post_id", "x.*")


def hourly_totals(events: DataFrame, time: str, key: str) -> DataFrame:
    """Counts per hour window and key; a window is emitted once it can no longer change."""
    return events.withWatermark(time, "2 hours").groupBy(F.window(time, "1 hour"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Gap sessions per key. Spark merges events exactly one gap apart; batch code that must not do so uses ``gap_batches``."""
    return events.withWatermark(time, gap).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_sink(path: str, keys: list[str], newest: str, parts: int = 32):
    """For ``foreachBatch``: merges a micro-batch into a ``KeyedTable``. Only the parts that the batch touches are rewritten;
    a batch that is delivered again, after a crash at any point, changes nothing that it has changed before."""

    def write(batch: DataFrame, epoch: int) -> None:
        KeyedTable(batch.sparkSession, path, keys, newest, parts).apply(batch, epoch)

    return write


def refetch_window(stored: DataFrame, fresh: DataFrame, time: str, keys: list[str], newest: str, days: int = 7) -> DataFrame:
    """The stored rows with those of the last ``days`` taken from a new fetch: late corrections replace what they correct, a row
    that the source no longer gives inside the window goes, and older rows stay as they are."""
    since = fresh.agg((F.max(time) - F.expr(f"INTERVAL {days} DAYS")).alias("_since"))
    both = stored.crossJoin(F.broadcast(since)).filter(F.col("_since").isNull() | (F.col(time) < F.col("_since"))).drop("_since")
    window = fresh.crossJoin(F.broadcast(since)).filter(F.col(time) >= F.col("_since")).drop("_since")
    return upsert(both, window, keys, newest)


def work_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def is_stale(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: whether stored results lag behind the newest run."""
    return results.agg(F.max("run_id").alias("done")).crossJoin(runs.agg(F.max("run_id").alias("newest"))).select("done", "newest", (F.col("done").isNull() | (F.col("done") < F.col("newest"))).alias("stale"))
