"""Cutting lineage through tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (tests, one machine)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lineage-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Stages:
    """Tables of one iterative job. ``keep`` writes a frame once and reads it back: later plans start at files that
    survive the loss of any executor, and their true sizes let the planner choose broadcasts.

    Tables that the job's result still reads must outlive it: they go when the session's application ends, or earlier with
    ``release`` when a caller has written the result. As a context (``with``) a job deletes its tables at the end itself."""

    _open: list["Stages"] = []

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        self.n = 0
        if not Stages._open:
            atexit.register(release)
        Stages._open.append(self)

    def __enter__(self) -> "Stages":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def keep_and_count(self, df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
        """``keep``, and aggregates of the rows that were seen while they were written."""
        seen = Observation()
        out = self.keep(df.observe(seen, *[a.alias(k) for k, a in aggregates.items()]))
        try:
            found = seen.get
        except Exception:  # a plan that turned out empty drops what observes it
            found = {}
        if set(found) != set(aggregates):
            found = out.agg(*[a.alias(k) for k, a in aggregates.items()]).first().asDict()
        return out, found

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in frames:
            if (path := getattr(df, "_stage_path", None)) is not None:
                self._delete(path)

    def close(self) -> None:
        """Deletes every table of the job."""
        self._delete(self.base)
        if self in Stages._open:
            Stages._open.remove(self)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Deletes the tables of all jobs so far; call it once their results are written. Runs at the end of the application too."""
    for stages in list(Stages._open):
        try:
            stages.close()
        except Exception:  # the session is gone: nothing left to delete with
            Stages._open.remove(stages)
