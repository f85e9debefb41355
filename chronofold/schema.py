"""Types, limits and errors of the agent-history model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identifiers, and limits in records, bytes and rows.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:@/-]{0,254}$"
DIGEST_PATTERN = r"^[0-9a-f]{64}$"
MAX_CONTENT_BYTES = 10 * 1024 * 1024
INLINE_CONTENT_BYTES = 256 * 1024
MAX_SEGMENT_RECORDS = 1000
MAX_SEGMENT_BYTES = 16 * 1024 * 1024
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
MAX_PREFIX_TERMS = 512
BM25_K1, BM25_B = 1.2, 0.75
SLOW_MS = 1000
#: Name space of this store's own schema versions, tags and attributes.
NAMESPACE = "chronofold"
RECORD_SCHEMA = "chronofold.record.v1"
SEGMENT_SCHEMA = "chronofold.segment.v1"

CONTENT_REF = T.StructType([
    T.StructField("sha256", T.StringType()), T.StructField("size", T.LongType()), T.StructField("media_type", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("storage", T.StringType()), T.StructField("entry_index", T.IntegerType()),
])

RECORD = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("id", T.StringType()), T.StructField("conversation_id", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("occurred_at", T.StringType()), T.StructField("recorded_at", T.StringType()),
    T.StructField("sequence", T.DecimalType(20, 0)), T.StructField("trace_id", T.StringType()), T.StructField("span_id", T.StringType()),
    T.StructField("parent_id", T.StringType()), T.StructField("agent", T.StringType()), T.StructField("tool", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("content", CONTENT_REF), T.StructField("record_sha256", T.StringType()),
])

#: A row of the data frames that operators work on; content is JSON text.
ROW = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("conversation_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()), T.StructField("sequence", T.LongType()), T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("agent", T.StringType()),
    T.StructField("tool", T.StringType()), T.StructField("status", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("content", T.StringType()), T.StructField("content_size", T.LongType()),
])


class HistoryError(Exception):
    """An error with a stable code, such as NOT_FOUND or INVALID_SEARCH."""

    STATUS = {
        "NOT_FOUND": 404, "IDEMPOTENCY_CONFLICT": 409, "DUPLICATE_RECORD": 409, "CONTENT_TOO_LARGE": 413, "SEGMENT_TOO_LARGE": 413,
        "INVALID_JSON": 400, "INVALID_RECORD": 400, "INVALID_BATCH": 400, "INVALID_REQUEST": 400, "INVALID_SEARCH": 400, "SEARCH_PREFIX_TOO_BROAD": 400,
        "RECORD_CORRUPT": 500, "SEGMENT_CORRUPT": 500, "BLOB_CORRUPT": 500, "BLOB_MISSING": 500, "SEARCH_INDEX_FAILED": 503,
    }

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.status = code, self.STATUS.get(code, 422)


def valid_id(value: str | None) -> bool:
    return value is not None and re.match(ID_PATTERN, value) is not None and not value.endswith("\n")


def checked_limit(limit: int | None, code: str = "INVALID_REQUEST") -> int:
    """0 or None means the default; other limits must lie within 1..1000."""
    if not limit:
        return DEFAULT_LIMIT
    if not 1 <= limit <= MAX_LIMIT:
        raise HistoryError(code, f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def time_order() -> list[Column]:
    """Order of a timeline: time, then sequence where there is one, then id."""
    return [F.col("occurred_at").asc(), F.col("sequence").asc_nulls_last(), F.col("id").asc()]


def order_key() -> Column:
    """The same order as one comparable value."""
    return F.struct("occurred_at", F.col("sequence").isNull(), "sequence", "id")
