"""Verification of segments and blobs: digests, places, repeated ids, missing and orphaned contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.schema import DIGEST_PATTERN
from chronofold.sources import store


def issues(spark: SparkSession, root: str) -> DataFrame:
    """(key, issue): damaged segments, ids that stand in several records, blobs that are missing or damaged."""
    found = store.segments(spark, root)
    damaged = found.select("key", "issue").where("issue IS NOT NULL")
    rows = store.records(found.where("issue IS NULL"))
    return damaged.unionByName(duplicate_ids(rows)).unionByName(blob_issues(rows, store.blobs(spark, root)))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """An issue for each repetition of an id, naming where it stood before."""
    of = Window.partitionBy("id").orderBy("key", "entry_index")
    again = rows.select("key", "id", F.lag("key").over(of).alias("before")).where("before IS NOT NULL")
    return again.select("key", F.concat(F.lit("DUPLICATE_RECORD: "), "id", F.lit(" also in "), "before").alias("issue"))


def blob_issues(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    wanted = rows.where("storage = 'blob'").select(F.col("content_key").alias("wanted"), "content_sha256", "content_size", "id")
    joined = wanted.join(blobs.select("key", "sha256", "size"), wanted["wanted"] == blobs["key"], "left")
    bad = F.when(F.col("key").isNull(), "BLOB_MISSING").when((F.col("sha256") != F.col("content_sha256")) | (F.col("size") != F.col("content_size")), "BLOB_CORRUPT")
    return joined.select(F.col("wanted").alias("key"), F.concat(bad, F.lit(": "), "id").alias("issue")).where("issue IS NOT NULL")


def orphans(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs that no record refers to; they are listed and no fault."""
    return blobs.join(rows.where("storage = 'blob'").select(F.col("content_key").alias("key")), "key", "left_anti").select("key")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """One row: segments, records, blobs, orphans, issues and whether all is well."""
    found = store.segments(spark, root)
    rows, blobs = store.records(found.where("issue IS NULL")), store.blobs(spark, root)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(found, "segments")
    for part in (count(rows, "records"), count(blobs, "blobs"), count(orphans(rows, blobs), "orphans"), count(issues(spark, root), "issues")):
        out = out.join(F.broadcast(part))
    return out.withColumn("ok", F.col("issues") == 0)


def invalid_records(records: DataFrame, pattern: str) -> DataFrame:
    """Records whose ids break the pattern or whose kind has not 1 to 128 bytes."""
    bad = ~F.col("id").rlike(pattern) | ~F.col("conversation_id").rlike(pattern) | ~F.octet_length("kind").between(1, 128)
    return records.where(bad)


def bad_digests(records: DataFrame) -> DataFrame:
    """Records whose content's digest is none or another one."""
    return records.where(~F.col("content_sha256").rlike(DIGEST_PATTERN) | (F.sha2("content", 256) != F.col("content_sha256")))
