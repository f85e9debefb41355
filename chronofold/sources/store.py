"""Objects that are created once: keys, a local store, immutable segments and content-addressed blobs.

One segment holds up to 1000 records of one conversation. Writing a segment that exists is the same
write or a conflict, never a change. Bulk data is read by Spark; single commits are the driver's.
"""

from __future__ import annotations

import json
import os
import re
import secrets
import tempfile
from dataclasses import dataclass, fields, replace
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.jsontext import canonical, encode, sha256
from chronofold.schema import INLINE_CONTENT_BYTES, MAX_CONTENT_BYTES, MAX_SEGMENT_BYTES, MAX_SEGMENT_RECORDS, RECORD, RECORD_SCHEMA, SEGMENT_SCHEMA, HistoryError, valid_id


def checked_key(key: str) -> str:
    """A relative key with plain segments."""
    key = key.strip("/")
    if not key or "\\" in key or any(part in ("", ".", "..") for part in key.split("/")):
        raise HistoryError("INVALID_REQUEST", f"invalid key {key!r}")
    return key


class LocalStore:
    """Create-once files below a folder: a file appears whole (hard link of a synced temporary file) or not at all."""

    def __init__(self, root: str) -> None:
        self.root = Path(root.removeprefix("file://"))
        self.root.mkdir(parents=True, exist_ok=True)

    def describe(self) -> str:
        return f"file://{self.root}"

    def put_if_absent(self, key: str, data: bytes) -> bool:
        """True if this call created the object, False if equal bytes stood there; else a conflict."""
        path = self.root / checked_key(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=".tmp-")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.link(temporary, path)
            return True
        except FileExistsError:
            if path.read_bytes() != data:
                raise HistoryError("IDEMPOTENCY_CONFLICT", key) from None
            return False
        finally:
            os.unlink(temporary)

    def get(self, key: str) -> bytes:
        try:
            return (self.root / checked_key(key)).read_bytes()
        except FileNotFoundError:
            raise HistoryError("NOT_FOUND", key) from None

    def keys(self, prefix: str) -> list[str]:
        """Keys below a prefix in order; hidden files are none, a missing prefix has none."""
        top = self.root / prefix.strip("/")
        return sorted(str(p.relative_to(self.root)) for p in top.rglob("*") if p.is_file() and not p.name.startswith("."))


def open_store(uri: str) -> LocalStore:
    """A local store by path or file URI. Other schemes are read and written through Spark's connectors."""
    scheme = re.match(r"([a-z0-9]+)://", uri)
    if scheme and scheme[1] != "file":
        raise HistoryError("INVALID_REQUEST", f"single commits need a store with create-if-absent; {scheme[1]}:// is for bulk reads and writes")
    return LocalStore(uri)


# keys and digests


def conversation_hash(conversation_id: str) -> str:
    return sha256(conversation_id)


def segment_key(conversation_id: str, segment_id: str) -> str:
    return f"history/v2/conversations/{conversation_hash(conversation_id)}/segments/{sha256(f'{conversation_id}\0{segment_id}')}.json"


def blob_key(digest: str) -> str:
    return f"history/v2/blobs/sha256/{digest[:2]}/{digest[2:]}"


def new_id(prefix: str) -> str:
    return prefix + secrets.token_hex(16)


def rfc3339(at: datetime) -> str:
    at = at.astimezone(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


def digest_without(value: dict, field: str) -> str:
    return sha256(encode({k: v for k, v in value.items() if k != field}))


@dataclass(frozen=True)
class Event:
    """What a producer sends; the rest is filled in when it is sealed."""

    conversation_id: str
    kind: str
    content: object = None
    id: str | None = None
    occurred_at: datetime | None = None
    sequence: int | None = None
    trace_id: str | None = None
    span_id: str | None = None
    parent_id: str | None = None
    agent: str | None = None
    tool: str | None = None
    status: str | None = None
    tags: dict[str, str] | None = None


def check(event: Event) -> None:
    ids = [event.conversation_id, event.id, *(x for x in (event.trace_id, event.span_id, event.parent_id) if x is not None)]
    if not all(map(valid_id, ids)) or not 1 <= len(event.kind.encode()) <= 128:
        raise HistoryError("INVALID_RECORD", event.id or "")
    if any(not 1 <= len(k.encode()) <= 128 or len(v.encode()) > 1024 for k, v in (event.tags or {}).items()):
        raise HistoryError("INVALID_RECORD", "a tag is too long")


def append(store: LocalStore, events: list[Event], segment_id: str | None = None, now: datetime | None = None, inline_bytes: int = INLINE_CONTENT_BYTES) -> dict:
    """Seal events of one conversation into a segment; the same batch again returns the first one."""
    if not 1 <= len(events) <= MAX_SEGMENT_RECORDS:
        raise HistoryError("INVALID_BATCH", f"a batch has 1 to {MAX_SEGMENT_RECORDS} records")
    now = now or datetime.now(UTC)
    conversation_id = events[0].conversation_id
    if any(e.conversation_id != conversation_id for e in events):
        raise HistoryError("INVALID_BATCH", "a batch is of one conversation")
    segment_id = segment_id or new_id("seg_")
    if not valid_id(segment_id):
        raise HistoryError("INVALID_BATCH", "segment id")
    key, entries, blobs, total = segment_key(conversation_id, segment_id), [], {}, 0
    for n, event in enumerate(events):
        event = replace(event, id=event.id or new_id("rec_"))
        check(event)
        text = canonical(json.dumps(event.content))
        data, digest = text.encode(), sha256(text)
        if len(data) > MAX_CONTENT_BYTES:
            raise HistoryError("CONTENT_TOO_LARGE", event.id)
        inline = len(data) <= inline_bytes
        total += len(data) if inline else 0
        if not inline:
            blobs[blob_key(digest)] = data
        reference = {"sha256": digest, "size": len(data), "media_type": "application/json", "key": key if inline else blob_key(digest), "storage": "segment" if inline else "blob"}
        record = {
            "schema_version": RECORD_SCHEMA, "id": event.id, "conversation_id": conversation_id, "kind": event.kind, "occurred_at": rfc3339(event.occurred_at or now), "recorded_at": rfc3339(now),
            **{f: v for f in ("sequence", "trace_id", "span_id", "parent_id", "agent", "tool", "status") if (v := getattr(event, f)) is not None},
            "tags": dict(event.tags or {}), "content": reference | ({"entry_index": n} if inline else {}),
        }
        record["record_sha256"] = digest_without(record, "record_sha256")
        entries.append({"record": record} | ({"content": json.loads(text)} if inline else {}))
    if len({e["record"]["id"] for e in entries}) < len(entries):
        raise HistoryError("INVALID_SEGMENT", "an id stands twice in the batch")
    segment = {"schema_version": SEGMENT_SCHEMA, "id": segment_id, "conversation_id": conversation_id, "conversation_hash": conversation_hash(conversation_id), "created_at": rfc3339(now), "entries": entries}
    segment["segment_sha256"] = digest_without(segment, "segment_sha256")
    data = encode(segment).encode()
    if max(total, len(data)) > MAX_SEGMENT_BYTES:
        raise HistoryError("SEGMENT_TOO_LARGE", segment_id)
    for blob, body in blobs.items():
        store.put_if_absent(blob, body)
    try:
        store.put_if_absent(key, data)
        return segment
    except HistoryError:
        first = json.loads(store.get(key))
        if not same_batch(first, segment, events):
            raise
        return first


def read_batch(text: str) -> tuple[str | None, list[Event]]:
    """Segment id and events of a batch file: one JSON object, no unknown fields, a content (null, too) in each record."""
    if len(text.encode()) > MAX_SEGMENT_BYTES + 1024 * 1024:
        raise HistoryError("SEGMENT_TOO_LARGE", "batch file")
    try:
        value = json.loads(text)
    except ValueError as e:
        raise HistoryError("INVALID_JSON", str(e)) from None
    known = {f.name for f in fields(Event)}
    if not isinstance(value, dict) or not set(value) <= {"id", "records"} or not isinstance(value.get("records"), list):
        raise HistoryError("INVALID_JSON", "a batch file is one object with id and records")
    events = []
    for n, record in enumerate(value["records"]):
        if not isinstance(record, dict) or not set(record) <= known or not {"content", "conversation_id", "kind"} <= set(record):
            raise HistoryError("INVALID_JSON", f"records[{n}] has unknown fields, or lacks content, conversation_id or kind")
        at = record.get("occurred_at")
        events.append(Event(**record | ({"occurred_at": datetime.fromisoformat(at)} if at else {})))
    return value.get("id"), events


def append_one(store: LocalStore, event: Event, **options) -> dict:
    """A segment of one record, named by the record's id."""
    event = replace(event, id=event.id or new_id("rec_"))
    return append(store, [event], segment_id="single_" + sha256(event.id), **options)


def same_batch(first: dict, again: dict, events: list[Event]) -> bool:
    """Whether a retry repeats what stands there; ids and times count only where they were given."""
    if len(first["entries"]) != len(again["entries"]):
        return False
    for a, b, event in zip(first["entries"], again["entries"], events):
        x, y = a["record"], b["record"]
        compared = ["kind", "sequence", "trace_id", "span_id", "parent_id", "agent", "tool", "status", "tags"] + ["id"] * (event.id is not None) + ["occurred_at"] * (event.occurred_at is not None)
        if any(x.get(f) != y.get(f) for f in compared) or any(x["content"][f] != y["content"][f] for f in ("sha256", "size", "storage")):
            return False
    return True


# reading in bulk

SEGMENT_FIELDS = {"schema_version", "id", "conversation_id", "conversation_hash", "created_at", "segment_sha256", "entries"}
RECORD_FIELDS, CONTENT_FIELDS = set(RECORD.fieldNames()), set(RECORD["content"].dataType.fieldNames())


def segment_issue(key: str, raw: str) -> str | None:
    """What is wrong with a segment's text, None if nothing."""
    try:
        segment = json.loads(raw)
        if segment["schema_version"] != SEGMENT_SCHEMA:
            return "SCHEMA_UNSUPPORTED"
        if encode(segment) != raw:
            return "SEGMENT_CORRUPT: not canonical"
        if set(segment) != SEGMENT_FIELDS:
            return "SEGMENT_CORRUPT: fields"
        if segment["segment_sha256"] != digest_without(segment, "segment_sha256"):
            return "SEGMENT_CORRUPT: checksum"
        conversation = segment["conversation_id"]
        if key != segment_key(conversation, segment["id"]) or segment["conversation_hash"] != conversation_hash(conversation):
            return "SEGMENT_CORRUPT: place"
        ids = [e["record"]["id"] for e in segment["entries"]]
        if len(set(ids)) < len(ids) or not ids:
            return "SEGMENT_CORRUPT: repeated id"
        for n, entry in enumerate(segment["entries"]):
            record, content = entry["record"], entry["record"]["content"]
            if not set(entry) <= {"record", "content"} or not set(record) <= RECORD_FIELDS or not set(content) <= CONTENT_FIELDS:
                return f"RECORD_CORRUPT: fields of {record['id']}"
            if record["schema_version"] != RECORD_SCHEMA:
                return "SCHEMA_UNSUPPORTED"
            if not valid_id(record["id"]) or record["conversation_id"] != conversation or record["record_sha256"] != digest_without(record, "record_sha256"):
                return f"RECORD_CORRUPT: {record['id']}"
            if content["storage"] == "segment":
                text = encode(entry["content"])
                if content["key"] != key or content["entry_index"] != n or content["sha256"] != sha256(text) or content["size"] != len(text.encode()):
                    return f"RECORD_CORRUPT: content of {record['id']}"
            elif "content" in entry or content["key"] != blob_key(content["sha256"]):
                return f"RECORD_CORRUPT: content of {record['id']}"
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return f"SEGMENT_CORRUPT: {type(e).__name__}"
    return None


@F.pandas_udf(T.StringType())
def _issues(keys: pd.Series, raws: pd.Series) -> pd.Series:
    return pd.Series([segment_issue(k, r) for k, r in zip(keys, raws)])


_NESTED = "schema_version string, id string, conversation_id string, conversation_hash string, created_at string, segment_sha256 string, entries array<struct<record:{record},content:string>>"


def segments(spark: SparkSession, root: str) -> DataFrame:
    """All segments below a root, with their key, raw text, content and what is wrong with them (null: nothing)."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.json").text(f"{root.rstrip('/')}/history/v2/conversations")
    schema = _NESTED.format(record=RECORD.simpleString())
    key = F.regexp_extract(F.col("_metadata.file_path"), r"(history/v2/conversations/.*)$", 1)
    rows = found.select(key.alias("key"), F.col("value").alias("raw"))
    return rows.select("key", "raw", F.from_json("raw", schema).alias("segment"), _issues("key", "raw").alias("issue"))


def records(found: DataFrame) -> DataFrame:
    """A row per entry of segments(), with time and content; contents in blobs are null here. A damaged segment is an error."""
    sound = F.when(F.col("issue").isNull(), F.col("segment.entries")).otherwise(F.raise_error(F.concat("issue", F.lit(" in "), "key")).cast(found.schema["segment"].dataType["entries"].dataType))
    rows = found.select("key", F.col("segment.id").alias("segment_id"), F.posexplode(sound).alias("entry_index", "entry"))
    r = F.col("entry.record")
    plain = [r[f].alias(f) for f in ("id", "conversation_id", "kind", "trace_id", "span_id", "parent_id", "agent", "tool", "status", "tags", "record_sha256")]
    return rows.select("key", "segment_id", "entry_index", *plain, F.to_timestamp(r["occurred_at"]).alias("occurred_at"), r["sequence"].cast("long").alias("sequence"), F.col("entry.content").alias("content"), r["content"]["size"].alias("content_size"), r["content"]["sha256"].alias("content_sha256"), r["content"]["storage"].alias("storage"), r["content"]["key"].alias("content_key"))


def hydrated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """records() with the contents that lie in blobs(); a blob that is missing, or has another digest or size, is an error."""
    theirs = found.select(F.col("key").alias("blob_key"), F.col("sha256").alias("blob_sha256"), F.col("size").alias("blob_size"), F.col("content").alias("blob"))
    joined = rows.join(theirs, F.when(F.col("storage") == "blob", F.col("content_key")) == F.col("blob_key"), "left")
    fault = lambda code: F.raise_error(F.concat(F.lit(f"{code}: "), "id")).cast("string")
    sound = (F.col("blob_sha256") == F.col("content_sha256")) & (F.col("blob_size") == F.col("content_size"))
    content = F.when(F.col("storage") != "blob", F.col("content")).when(F.col("blob_key").isNull(), fault("BLOB_MISSING")).when(~sound, fault("BLOB_CORRUPT")).otherwise(F.col("blob"))
    return joined.withColumn("content", content).select(*rows.columns)


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(key, sha256 of the bytes, size, content) of all blobs."""
    path = f"{root.rstrip('/')}/history/v2/blobs"
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except Exception as e:  # no blob was ever written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, sha256 string, size long, content string")
    key = F.regexp_extract("path", r"(history/v2/blobs/.*)$", 1)
    return found.select(key.alias("key"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects by line; blank lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


