"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones are kept in ``_corrupt_record``."""
    full = schema if CORRUPT in schema.names else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes columns in sorted order and returns the number of rows, observed while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["n"]


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted cells may span lines; a byte order mark is dropped from the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_review_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The given columns in their order; missing columns and nulls are empty."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields]
    df.select(*cols).write.mode("overwrite").option("emptyValue", "").csv(path, header=True, quote='"', escape='"')


def union_first_wins(frames: list[DataFrame], keys: list[str], seq: str) -> DataFrame:
    """Rows of several files; of equal keys the row of the earliest file, then the smallest ``seq``."""
    from ..operators.review import first_wins

    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("_file", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_wins(out, keys, ["_file", seq]).drop("_file")


def write_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """Replaces one snapshot and leaves the others: a reload gives the same table."""
    df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


#: Landed forum payload.
FORUM_SCHEMA = ("id bigint, type string, by string, time bigint, title string, text string, url string, parent bigint, score bigint, descendants bigint, kids array<bigint>, deleted boolean, dead boolean, thread bigint")
#: Landed issue payload.
ISSUE_SCHEMA = ("number bigint, title string, body string, html_url string, created_at string, repository_url string, user struct<login:string>, labels array<struct<name:string>>, comments bigint, reactions struct<total_count:bigint>, pull_request struct<url:string>")


def forum_items(raw: DataFrame) -> DataFrame:
    """Raw items from forum payloads: a story is its own thread, a comment that of its thread or parent."""
    return raw.select(
        F.lit("forum").alias("platform"), F.col("id").cast("string").alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"),
        F.coalesce("url", F.concat(F.lit("item?id="), F.col("id"))).alias("url"), F.when(F.col("type") == "story", F.col("id")).otherwise(F.coalesce("thread", "parent")).cast("string").alias("thread_id"),
        F.col("parent").cast("string").alias("parent_id"), F.col("by").alias("author"), F.timestamp_seconds("time").alias("published_at"),
        F.create_map(F.lit("score"), F.coalesce("score", F.lit(0)).cast("double"), F.lit("comments"), F.coalesce("descendants", F.lit(0)).cast("double")).alias("engagement"),
        F.struct("type", "kids", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("dead", F.lit(False)).alias("dead")).alias("metadata"),
    )


def issue_items(raw: DataFrame) -> DataFrame:
    """Raw items from issue payloads; pull requests are left out."""
    return raw.where("pull_request is null").select(
        F.lit("issues").alias("platform"), F.col("number").cast("string").alias("source_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.col("html_url").alias("url"),
        F.coalesce(F.nullif(F.regexp_extract("repository_url", "/repos/(.*)", 1), F.lit("")), F.lit("github")).alias("community_id"), F.col("number").cast("string").alias("thread_id"), F.col("user.login").alias("author"),
        F.to_timestamp("created_at").alias("published_at"), F.transform("labels", lambda x: x["name"]).alias("labels"),
        F.create_map(F.lit("comments"), F.coalesce("comments", F.lit(0)).cast("double"), F.lit("reactions"), F.coalesce("reactions.total_count", F.lit(0)).cast("double")).alias("engagement"),
    )


#: Landed issue comments, with the number of their issue.
COMMENT_SCHEMA = "id bigint, issue_number bigint, body string, html_url string, created_at string, updated_at string, user struct<id:bigint,login:string>, reactions struct<total_count:bigint>"


def comment_items(comments: DataFrame, issues: DataFrame) -> DataFrame:
    """Raw items from comments and the issues they belong to; comments on pull requests, and those without an issue, are left out."""
    of = issues.where("pull_request is null").select(F.col("number").alias("issue_number"), F.col("title").alias("_title"), F.col("html_url").alias("_url"), "repository_url").dropDuplicates(["issue_number", "repository_url"])
    return comments.join(of, "issue_number").select(
        F.lit("issues").alias("platform"), F.col("id").cast("string").alias("source_id"), F.coalesce("_title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("html_url", "_url", F.lit("")).alias("url"),
        F.coalesce(F.nullif(F.regexp_extract("repository_url", "/repos/(.*)", 1), F.lit("")), F.lit("github")).alias("community_id"), F.col("issue_number").cast("string").alias("thread_id"), F.col("issue_number").cast("string").alias("parent_id"),
        F.coalesce(F.col("user.id").cast("string"), F.col("user.login")).alias("author"), F.to_timestamp("created_at").alias("published_at"),
        F.create_map(F.lit("reactions"), F.coalesce("reactions.total_count", F.lit(0)).cast("double")).alias("engagement"), F.struct("issue_number", "updated_at").alias("metadata"),
    )


def methodology(spark: SparkSession, paths: list[str], gates: dict[str, float], examples: int) -> DataFrame:
    """One row: the gates, the number of examples, and the text of each metric file by its name without ending."""
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "value")
    artifacts = files.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("artifacts"))  # a few small files of settings
    return artifacts.select(F.create_map(*[F.lit(x) for kv in gates.items() for x in kv]).alias("gates"), F.lit(examples).alias("examples"), "artifacts")
