"""Readers of exchange formats: logs with torn tails, API payloads, bundles, delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class CorruptLog(ValueError):
    """A line before the last one of a log does not parse."""


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of append-only JSON-lines files. The unfinished last line of a file is skipped; any other bad line is an error.

    A torn line is one at the end of a file without a closing line feed: it is the greatest byte offset of its file, found by
    a map-side maximum, so no file is read in one piece.
    """
    bad = "_corrupt_record"
    full = StructType([*schema.fields, StructField(bad, StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    parsed = lines.filter(F.trim("value") != "").select("file", "block", "n", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    broken = parsed.filter(F.col(f"r.{bad}").isNotNull()).groupBy("file").agg(F.count("*").alias("k"), F.max(F.struct("block", "n")).alias("at"))
    last = parsed.groupBy("file").agg(F.max(F.struct("block", "n")).alias("end"))
    wrong = broken.join(last, "file").filter((F.col("k") > 1) | (F.col("at.block") < F.col("end.block")) | (F.col("at.n") < F.col("end.n")))
    if (row := wrong.first()) is not None:
        raise CorruptLog(f"{row['file']}: a line before the last one does not parse")
    return parsed.filter(F.col(f"r.{bad}").isNull()).select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields])


def csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Delimited files with a header, a given schema, and no tolerance for rows that do not fit."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, multiLine=False)


def insight_values(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payload rows with ``metric`` and ``value`` from the four shapes an insights API answers with: a single value, a list of
    dated values (summed), a total, or a total broken down by a dimension (``breakdown`` keeps the parts)."""
    shape = "array<struct<name:string,values:array<struct<value:bigint,end_time:string>>,total_value:struct<value:bigint,breakdowns:array<struct<results:array<struct<dimension_values:array<string>,value:bigint>>>>>,value:bigint>>"
    rest = [c for c in payloads.columns if c != column]
    x = payloads.select(*rest, F.explode(F.from_json(F.coalesce(F.get_json_object(column, "$.data"), F.col(column)), shape)).alias("m"))
    parts = F.flatten(F.transform("m.total_value.breakdowns", lambda b: b["results"]))
    total = F.aggregate("m.values", F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v["value"], F.lit(0)))
    split = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v["value"], F.lit(0)))
    breakdown = F.map_from_entries(F.transform(parts, lambda p: F.struct(F.array_join(p["dimension_values"], "/"), p["value"])))
    return x.select(*rest, F.col("m.name").alias("metric"), F.coalesce("m.value", "m.total_value.value", F.when(F.size("m.values") > 0, total), F.when(F.size(parts) > 0, split)).alias("value"), F.when(F.size(parts) > 0, breakdown).alias("breakdown"))


def daily_points(payloads: DataFrame, column: str = "payload", zone: str = "America/Los_Angeles") -> DataFrame:
    """metric, day, value, off_midnight of dated values, labelled by the zone's day that ends at the stamp."""
    shape = "array<struct<name:string,values:array<struct<value:bigint,end_time:string>>>>"
    x = payloads.select(F.explode(F.from_json(F.coalesce(F.get_json_object(column, "$.data"), F.col(column)), shape)).alias("m"))
    p = x.select(F.col("m.name").alias("metric"), F.explode("m.values").alias("v"))
    local = F.from_utc_timestamp(F.to_timestamp("v.end_time"), zone)
    return p.select("metric", F.date_sub(F.to_date(local), 1).alias("day"), F.col("v.value").alias("value"), ((F.hour(local) != 0) | (F.minute(local) != 0)).alias("off_midnight"))


def post_payloads(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Posts from API pages: nested edges flattened, repeated ids kept once (the row with the most filled fields)."""
    shape = "array<struct<id:string,text:string,timestamp:string,media_type:string,is_reply:boolean,is_reply_owned_by_me:boolean,username:string,root_post:struct<id:string>,replied_to:struct<id:string>,children:struct<data:array<struct<id:string>>>>>"
    p = pages.select(F.explode(F.from_json(F.coalesce(F.get_json_object(column, "$.data"), F.col(column)), shape)).alias("p")).filter("p.id is not null")
    flat = p.select(
        F.col("p.id").alias("id"), F.col("p.text").alias("text"), F.to_timestamp("p.timestamp").alias("posted_at"), F.col("p.media_type").alias("media_type"), F.col("p.is_reply").alias("is_reply"),
        F.col("p.is_reply_owned_by_me").alias("is_reply_owned_by_me"), F.col("p.root_post.id").alias("root_post_id"), F.col("p.replied_to.id").alias("replied_to_id"), F.col("p.username").alias("username"),
        F.transform("p.children.data", lambda c: c["id"]).alias("children"),
    )
    return flat.groupBy("id").agg(*[F.max(c).alias(c) if c != "children" else F.max("children").alias("children") for c in flat.columns if c != "id"])


def checked_bundle(rows: DataFrame, *, unique: list[str], finite: list[str] = (), required: list[str] = ()) -> DataFrame:
    """The rows if every check holds, else an error that names the checks: keys unique, numbers finite, fields filled.

    All checks are one aggregate plus one count per key.
    """
    checks = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in required] + [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"not finite {c}") for c in finite]
    bad = {k: v for k, v in rows.agg(F.count("*").alias("rows"), *checks).first().asDict().items() if k != "rows" and v}
    twice = rows.groupBy(*unique).agg(F.count("*").alias("k")).filter("k > 1").limit(1).count()
    if twice:
        bad["repeated " + ",".join(unique)] = 1
    if bad:
        raise ValueError(f"the bundle fails: {bad}")
    return rows


def json_object_in(text):
    """The text from the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def valid_outputs(outputs: DataFrame, schema: str, *, score: tuple[int, int] = (0, 3), quote_in: str | None = None) -> DataFrame:
    """outputs with ``parsed`` and ``error``: JSON with all fields, a score in range, and, if asked, a quote found verbatim in a column."""
    p = outputs.withColumn("parsed", F.from_json(json_object_in(F.col("output")), schema))
    wrong = F.when(F.col("parsed").isNull() | F.col("parsed.score").isNull(), "no score").when(~F.col("parsed.score").between(*score), "score out of range")
    if quote_in:
        wrong = wrong.when(F.col("parsed.quote").isNotNull() & (F.instr(F.col(quote_in), F.col("parsed.quote")) == 0), "quote not in text")
    return p.withColumn("error", wrong)


def select_outputs(outputs: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (id, version) the newest valid output; ``status`` says ok, missing or invalid."""
    best = outputs.groupBy("id").agg(F.max(F.when(F.col("error").isNull(), F.struct("version", "output"))).alias("b"), F.count("*").alias("k"))
    j = requests.select("id").distinct().join(best, "id", "left")
    return j.select("id", F.col("b.version").alias("version"), F.col("b.output").alias("output"), F.when(F.col("b").isNotNull(), "ok").when(F.col("k").isNull(), "missing").otherwise("invalid").alias("status"))


#: What follower demographics can be broken down by.
BREAKDOWNS = ("age", "city", "country", "gender")


def demographics(payloads: DataFrame, column: str = "payload", breakdown: str = "country") -> DataFrame:
    """value_of (a breakdown's value) and followers, from answers with a broken-down total; other breakdowns are refused."""
    if breakdown not in BREAKDOWNS:
        raise ValueError(f"breakdown must be one of {', '.join(BREAKDOWNS)}")
    return insight_values(payloads, column).filter("breakdown is not null").select(F.explode("breakdown").alias("value_of", "followers")).groupBy("value_of").agg(F.sum("followers").alias("followers"))


def account_totals(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """metric, value: an account's totals over the period asked for, whatever shape each metric's answer has."""
    return insight_values(payloads, column).groupBy("metric").agg(F.sum("value").alias("value"))


def user_info(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """id, username, name, biography, verified of account answers; one row per id."""
    x = payloads.select(F.from_json(column, "id string, username string, name string, threads_biography string, is_verified boolean").alias("u")).filter("u.id is not null")
    return x.select("u.id", "u.username", "u.name", F.col("u.threads_biography").alias("biography"), F.coalesce("u.is_verified", F.lit(False)).alias("verified")).groupBy("id").agg(*[F.max(c).alias(c) for c in ("username", "name", "biography", "verified")])
