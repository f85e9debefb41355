"""Structured queries, timelines, look-ups and conversation roll-ups."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions import jsontext as js
from chronofold.schema import HistoryError, checked_limit, order_key, time_order
from chronofold.sources import store

EXACT = ("conversation_id", "trace_id", "kind", "agent", "tool", "status")


@dataclass(frozen=True)
class RecordFilter:
    """Exact fields, tags and an inclusive span of time; empty fields do not filter."""

    conversation_id: str = ""
    trace_id: str = ""
    kind: str = ""
    agent: str = ""
    tool: str = ""
    status: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    since: datetime | str | None = None
    until: datetime | str | None = None

    def apply(self, records: DataFrame) -> DataFrame:
        for name in EXACT:
            if value := getattr(self, name):
                records = records.where(F.col(name) == value)
        for key, value in self.tags.items():
            records = records.where(F.col("tags")[key] == value)
        if self.since is not None:
            records = records.where(F.col("occurred_at") >= F.lit(self.since).cast("timestamp"))
        if self.until is not None:
            records = records.where(F.col("occurred_at") <= F.lit(self.until).cast("timestamp"))
        return records


def parse_tags(pairs: list[str]) -> dict[str, str]:
    """key=value pairs; a key given again takes the last value."""
    out = {}
    for pair in pairs:
        key, equals, value = pair.partition("=")
        if not key or not equals:
            raise HistoryError("INVALID_REQUEST", f"a tag filter is key=value, not {pair!r}")
        out[key] = value
    return out


def find(records: DataFrame, where: RecordFilter, limit: int | None = None) -> DataFrame:
    """The oldest ``limit`` matching records in the order of time."""
    return where.apply(records).orderBy(*time_order()).limit(checked_limit(limit))


def unique(records: DataFrame) -> DataFrame:
    """records, after a check that no id stands twice."""
    twice = records.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise HistoryError("DUPLICATE_RECORD", twice[0]["id"])
    return records


def listing(records: DataFrame) -> DataFrame:
    return unique(records).orderBy(*time_order())


def get(records: DataFrame, record_id: str) -> DataFrame:
    """The one record with this id."""
    found = records.where(F.col("id") == record_id)
    n = len(found.select("id").limit(2).collect())
    if n != 1:
        raise HistoryError("DUPLICATE_RECORD" if n else "NOT_FOUND", record_id)
    return found


def timeline(records: DataFrame, conversation_id: str, blobs: DataFrame | None = None) -> DataFrame:
    """A conversation's records in order, with verified contents from blobs where they are not inline."""
    rows = records.where(F.col("conversation_id") == conversation_id)
    if blobs is not None:
        rows = store.hydrated(rows, blobs)
    if rows.isEmpty():
        raise HistoryError("NOT_FOUND", conversation_id)
    return rows.orderBy(*time_order())


def positions(records: DataFrame) -> DataFrame:
    """records with their place in the timeline of their conversation, from 0, and the offset from its start in ms."""
    of = Window.partitionBy("conversation_id").orderBy(*time_order())
    start = F.first("occurred_at").over(of)
    return records.withColumns({"position": F.row_number().over(of) - 1, "offset_ms": F.unix_millis("occurred_at") - F.unix_millis(start)})


def _sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(value != "", value)))


def conversations(records: DataFrame) -> DataFrame:
    """One row per conversation: count, first and last time, agents and kinds in order."""
    return records.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        _sorted_set(F.col("agent")).alias("agents"), _sorted_set(F.col("kind")).alias("kinds"),
    )


def newest(rolled: DataFrame, limit: int = 0) -> DataFrame:
    """Conversations by their last record; 0 means the default limit, a negative one all."""
    ordered = rolled.orderBy(F.desc("last_seen"), F.asc("conversation_id"))
    return ordered if limit < 0 else ordered.limit(checked_limit(limit))


def deltas(records: DataFrame, source: Column) -> DataFrame:
    """Partial roll-ups by source (a segment, a day, a batch), with the key that applies each once."""
    rolled = records.withColumn("source", source).groupBy("source", "conversation_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        _sorted_set(F.col("agent")).alias("agents"), _sorted_set(F.col("kind")).alias("kinds"),
    )
    return rolled.withColumn("delta_key", F.sha2(F.concat_ws("\u0000", "source", "conversation_id"), 256))


def merge(parts: DataFrame) -> DataFrame:
    """Roll-up of deltas; a delta that stands twice counts once."""
    once = parts.dropDuplicates(["delta_key"])
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return once.groupBy("conversation_id").agg(F.sum("record_count").alias("record_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), union("agents").alias("agents"), union("kinds").alias("kinds"))


def unseen(listed: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """What is listed and not applied yet."""
    return listed.join(applied.select(key), key, "left_anti")


def busiest(rolled: DataFrame) -> DataFrame:
    """The conversation with the most records; ties go to the latest, then by id."""
    return rolled.orderBy(F.desc("record_count"), F.desc("last_seen"), "conversation_id").limit(1)


def observed_values(records: DataFrame, fields: tuple[str, ...] = ("kind", "agent", "tool", "model", "status", "trace_id"), tags: bool = True) -> DataFrame:
    """(field, value): distinct non-empty values of fields, and of tags as tag.<name>, in order."""
    value = {f: js.string_at(js.parsed(F.col("content")), "$.model") if f == "model" else F.col(f) for f in fields}
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), value[f].alias("value")) for f in fields))
    if tags:
        own = F.transform(F.map_entries("tags"), lambda e: F.struct(F.concat(F.lit("tag."), e["key"]).alias("field"), e["value"].alias("value")))
        pairs = F.concat(pairs, F.coalesce(own, F.array().cast(T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])))))
    return records.select(F.explode(pairs).alias("p")).select("p.field", "p.value").where("value <> ''").distinct().orderBy("field", "value")


def session_status(rolled: DataFrame) -> DataFrame:
    status = F.when(F.array_contains("kinds", "agent.turn.completed"), "complete").when(F.exists("kinds", lambda k: k.startswith("message.")), "captured").otherwise("evidence")
    return rolled.withColumn("status", status)


def session_list(rolled: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Sessions of a type (all, agent, test) whose id or one of whose agents holds the text, in any case."""
    if kind != "all":
        rolled = rolled.where(F.exists("kinds", lambda k: k.startswith(f"{kind}.")))
    if text := text.strip().lower():
        rolled = rolled.where(F.lower("conversation_id").contains(text) | F.exists("agents", lambda a: F.lower(a).contains(text)))
    return rolled


def suggestions(values: DataFrame, column: str, text: str, n: int = 7) -> DataFrame:
    return values.where(F.lower(column).contains(text.lower())).orderBy(column).limit(n)


def latest(records: DataFrame, kind: str) -> DataFrame:
    """records with a flag at the last one of this kind in its conversation."""
    last = F.max(F.when(F.col("kind") == kind, order_key())).over(Window.partitionBy("conversation_id"))
    return records.withColumn("is_latest", F.coalesce((F.col("kind") == kind) & (order_key() == last), F.lit(False)))
