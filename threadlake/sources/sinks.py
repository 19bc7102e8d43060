"""Keyed tables on immutable files: upsert, replacement, append, publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Union in which, per key, the row with the greatest ``newest`` wins (new rows win ties). Combines map-side."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    best = F.max(F.struct(F.col(newest), F.col("_new"), *[F.col(c).alias(f"_{c}") for c in rest])).alias("b")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col("b")[f"_{c}"].alias(c) for c in rest]).select(*old.columns)


def update_columns(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` replaced where the key is in it, also by null."""
    names = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_k"), *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_hit"))
    j = rows.join(c, F.col(key) == F.col("_k"), "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) if n in names else F.col(n) for n in rows.columns])


def keep_only(rows: DataFrame, kept: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is kept, rows to delete): a semi and an anti join."""
    k = kept.select(key).distinct()
    return rows.join(k, key, "left_semi"), rows.join(k, key, "left_anti")


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that the rows name and no others; a rerun gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_snapshot(rows: DataFrame, path: str, at: str = "fetched_at") -> None:
    """Adds readings by day; earlier files are never touched."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def content_digest(rows: DataFrame) -> str:
    """Order-free digest of a table: a checksum of row hashes, computed map-side."""
    h = F.xxhash64(*sorted(rows.columns))
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written under a name readers ignore, then renamed to one that is not yet taken."""
    tmp, fs = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(tmp, _fs(spark, path)[0]):
        raise OSError(f"{path} is already there")


def _read_small(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _states(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the pointers that were published, in order."""
    p, fs = _fs(spark, f"{base}/states")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def _point(spark: SparkSession, base: str, state: dict) -> None:
    numbers = _states(spark, base)
    _fs(spark, base)[1].mkdirs(_fs(spark, f"{base}/states")[0])
    _write_small(spark, f"{base}/states/{(numbers[-1] if numbers else 0) + 1:012d}", json.dumps(state))


def publish(rows: DataFrame, base: str) -> str:
    """Writes a new version beside the old ones, then a numbered pointer to it; the greatest number counts.

    Nothing that a reader may hold is deleted or moved, so readers see either version whole, and a failure at any point
    leaves the last published version in place.
    """
    spark = rows.sparkSession
    version = f"{base}/versions/{uuid.uuid4().hex}"
    rows.write.parquet(version)
    _point(spark, base, {"version": version, "digest": content_digest(spark.read.parquet(version))})
    return version


def published(spark: SparkSession, base: str, digest: str | None = None) -> DataFrame:
    """The published version; with ``digest`` an error if results were made from another one."""
    state = json.loads(_read_small(spark, f"{base}/states/{_states(spark, base)[-1]:012d}"))
    if digest is not None and digest != state["digest"]:
        raise ValueError("the published table is not the one these results were made from")
    return spark.read.parquet(state["version"])


class KeyedTable:
    """A keyed table in parts by key hash, changed batch by batch. A batch writes new files of the parts it touches and then one
    numbered pointer that lists every part's folder and the batch: a crash before the pointer changes nothing, and a batch that
    a pointer already names is skipped when it is replayed."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], newest: str, parts: int = 32):
        self.spark, self.base, self.keys, self.newest, self.parts = spark, base, keys, newest, parts

    def _state(self) -> dict:
        numbers = _states(self.spark, self.base)
        return json.loads(_read_small(self.spark, f"{self.base}/states/{numbers[-1]:012d}")) if numbers else {"parts": {}, "batch": None}

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Merges a batch; False if it was merged before."""
        state = self._state()
        if state["batch"] is not None and number <= state["batch"]:
            return False
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        own = upsert(batch.limit(0), batch, self.keys, self.newest).withColumn("_part", part)
        touched = [r["_part"] for r in own.select("_part").distinct().collect()]  # at most ``parts`` numbers
        held = [state["parts"][str(k)] for k in touched if str(k) in state["parts"]]
        merged = own
        if held:
            merged = upsert(self.spark.read.parquet(*held), own.drop("_part"), self.keys, self.newest).withColumn("_part", part)
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        merged.repartition(F.col("_part")).write.partitionBy("_part").parquet(folder)
        self._publish({"parts": state["parts"] | {str(k): f"{folder}/_part={k}" for k in touched}, "batch": number})
        return True

    def _publish(self, state: dict) -> None:
        _point(self.spark, self.base, state)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self._state()["parts"].values())

    def vacuum(self) -> None:
        """Deletes folders that the last pointer does not name, for when no reader holds an older one."""
        used = {p.rsplit("/", 1)[0] for p in self._state()["parts"].values()}
        p, fs = _fs(self.spark, f"{self.base}/data")
        for f in fs.listStatus(p):
            if not any(u.endswith(f.getPath().getName()) for u in used):
                fs.delete(f.getPath(), True)


def missing_by_hash(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Texts (id, text) without a stored vector (text_hash): one per hash, the first id."""
    h = texts.select(F.sha2("text", 256).alias("text_hash"), "id", "text").groupBy("text_hash").agg(F.min(F.struct("id", "text")).alias("x"))
    return h.join(done.select("text_hash").distinct(), "text_hash", "left_anti").select("text_hash", "x.id", "x.text")
