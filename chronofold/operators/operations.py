"""Operations of a trace: a tool call with its result, joined answers, single records; densities and focus.

Which operation a record belongs to depends on what stands before it: a result goes to the earliest call that still
waits for it, an answer to the answers right before it. So conversations are streamed in their order (sorted
partitions, one pass, no conversation held in memory); everything around it is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions import jsontext as js
from chronofold.functions import text as tx
from chronofold.operators import dsl
from chronofold.operators.query import positions
from chronofold.operators.sessions import FAILURES, reasoning
from chronofold.schema import SLOW_MS, time_order


class Pairing:
    """The operation of each record of one conversation, told in order.

    A call waits until a call of the same tool follows, so that there is one waiting call a tool at most. A result
    goes to the first call that waits with its id, with its tool and trace, or right before it.
    """

    def __init__(self) -> None:
        self.at = -1
        self.waiting: dict[str | None, tuple[int, str | None, str | None]] = {}  # tool -> (place, trace, call id)
        self.answer: tuple[int, str | None] | None = None  # the answers that go on: first place, trace

    def place(self, kind: str, tool: str | None, trace: str | None, call: str | None) -> int:
        self.at += 1
        here, answer = self.at, None
        if kind == "tool.call":
            self.waiting.pop(tool, None)
            self.waiting[tool] = (here, trace, call)  # in order of their places
        elif kind == "tool.result":
            for of, (place, its_trace, its_call) in self.waiting.items():
                if call and its_call == call or of == tool and its_trace == trace or place == here - 1:
                    del self.waiting[of]
                    here = place
                    break
        elif kind == "message.assistant":
            answer = self.answer if self.answer and self.answer[1] == trace else (here, trace)
            here = answer[0]
        self.answer = answer
        return here


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted records (last: kind, tool, trace_id, call_id, conversation_id) -> the records with position and operation."""
    conversation, pairing, new = None, Pairing(), True
    for batch in batches:
        n = batch.num_columns - 5
        position, operation = [], []
        for kind, tool, trace, call, own in zip(*(batch.column(n + k).to_pylist() for k in range(5))):
            if new or own != conversation:
                conversation, pairing, new = own, Pairing(), False
            operation.append(pairing.place(kind, tool, trace, call))
            position.append(pairing.at)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(position, pa.int32()), pa.array(operation, pa.int32())], names=[*batch.schema.names[:n], "position", "operation"])


def placed(records: DataFrame) -> DataFrame:
    """records with their position in their conversation and the position of the operation they belong to."""
    sorted_ = records.repartition("conversation_id").sortWithinPartitions("conversation_id", *time_order())
    keys = [F.col("kind").alias("__kind"), F.col("tool").alias("__tool"), F.col("trace_id").alias("__trace"), call_id(F.col("content")).alias("__call"), F.col("conversation_id").alias("__conversation")]
    schema = T.StructType([*records.schema.fields, T.StructField("position", T.IntegerType()), T.StructField("operation", T.IntegerType())])
    return sorted_.select(*records.columns, *keys).mapInArrow(_placed, schema)


def call_id(content: Column) -> Column:
    v = js.parsed(content)
    return F.coalesce(*(js.string_at(v, f"$.{k}") for k in ("tool_use_id", "call_id", "id")))


def preview(kind: Column, tool: Column, content: Column) -> Column:
    """A line about a record: its text, query, result count, error, model, or its first two fields."""
    v = js.parsed(content)
    at = lambda p: js.string_at(v, p)
    n = F.size(F.try_variant_get(v, "$.content", "array<variant>"))
    pair = lambda second, default: F.coalesce(F.nullif(F.concat_ws(" · ", at("$.model"), at(second)), F.lit("")), F.lit(default))
    fields = F.slice(F.map_entries(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != "encrypted_content")), 1, 2)
    first_two = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.to_json(e["value"]), F.lit("null")))), " · ")
    return (
        F.when(~js.is_object(v), F.coalesce(F.nullif(F.try_variant_get(v, "$", "string"), F.lit("null")), F.lit("No content")))
        .when(at("$.text").isNotNull(), at("$.text"))
        .when((kind == "tool.call") & at("$.input.query").isNotNull(), at("$.input.query"))
        .when(kind == "tool.call", F.concat(F.coalesce(tool, at("$.name"), F.lit("Tool")), F.lit(" called")))
        .when((kind == "tool.result") & n.isNotNull(), F.concat(n.cast("string"), F.when(n == 1, " result").otherwise(" results"), F.lit(" returned")))
        .when((kind == "tool.result") & at("$.error.message").isNotNull(), at("$.error.message"))
        .when(kind == "model.request", pair("$.provider", "Model request"))
        .when(kind == "model.response", pair("$.stop_reason", "Model response"))
        .when(at("$.prompt_name").isNotNull(), at("$.prompt_name"))
        .otherwise(F.coalesce(F.nullif(first_two, F.lit("")), F.lit("Structured event")))
    )


def build(records: DataFrame, raw: bool = False) -> DataFrame:
    """One row per operation: ids, kind, category, title, summary, duration, status, records joined, evidence bytes.

    Joined answers stand as their first record with all their texts; ``raw`` leaves each record alone.
    """
    rows = positions(records).withColumn("operation", F.col("position")) if raw else placed(records)
    answer = F.col("kind") == "message.assistant"
    v = js.parsed(F.col("content"))
    rows = rows.withColumns({
        "goes_on": answer & (F.col("position") != F.col("operation")), "text": F.when(answer, js.string_at(v, "$.text")), "model": js.string_at(v, "$.model"), "name": js.string_at(v, "$.name"),
        "preview": preview(F.col("kind"), F.col("tool"), F.col("content")), "low": F.lower("status"), "think": reasoning(F.col("kind"), F.col("content")),
    })
    by = F.col("position")
    first, own = lambda c: F.min_by(c, by), lambda c: F.when(~F.col("goes_on"), c)
    out = rows.groupBy("conversation_id", "operation").agg(
        F.array_sort(F.collect_list(own(F.struct("position", "id", "kind", "preview")))).alias("entries"), first("kind").alias("kind"), first("tool").alias("tool"), first("model").alias("model"),
        first("name").alias("name"), first("preview").alias("preview"), F.min("occurred_at").alias("started_at"), F.max_by(own(F.col("occurred_at")), own(by)).alias("ended_at"),
        F.count(F.lit(1)).cast("int").alias("grouped_count"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text")))).alias("texts"),
        F.max(own(F.coalesce(F.col("low").isin(*FAILURES), F.lit(False)))).alias("bad"), F.max_by("low", own(F.when(F.col("low") != "", by))).alias("last_status"),
        F.max(own(F.col("think"))).alias("is_reasoning"), F.sum(own(F.col("content_size"))).alias("evidence_bytes"),
    )
    joined = (F.col("kind") == "message.assistant") & (F.col("grouped_count") > 1)
    said = F.when(joined, F.array_join(F.transform("texts", lambda t: t["text"]), "")).otherwise(F.col("preview"))
    result = F.filter("entries", lambda e: e["kind"] == "tool.result")
    summary = F.array_join(F.filter(F.array(said, F.get(result, F.lit(0))["preview"]), lambda p: p.isNotNull() & (p != "")), " · ")
    return out.select(
        "conversation_id", F.col("operation").alias("position"), F.array_join(F.transform("entries", lambda e: e["id"]), "::").alias("id"), "kind", tx.event_category(F.col("kind")).alias("category"),
        tx.event_title(F.col("kind"), F.col("tool"), F.col("model"), F.col("name")).alias("title"), summary.alias("summary"), "started_at", "ended_at",
        F.greatest(F.lit(0), F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"), F.when(F.col("bad"), "error").otherwise(F.col("last_status")).alias("status"),
        "grouped_count", "is_reasoning", "evidence_bytes", F.transform("entries", lambda e: e["id"]).alias("entry_ids"),
    )


def overview(operations: DataFrame) -> DataFrame:
    """What an overview keeps: tools, tests, turns, requests, the final answer and errors."""
    final = F.max(F.when(F.col("kind") == "message.assistant", F.col("position"))).over(Window.partitionBy("conversation_id"))
    keep = F.col("category").isin("tool", "test") | F.col("kind").isin("agent.turn.started", "agent.turn.completed", "message.user") | F.coalesce((F.col("kind") == "message.assistant") & (F.col("position") == final), F.lit(False)) | F.coalesce(F.col("status") == "error", F.lit(False))
    return operations.withColumn("__keep", keep).where("__keep").drop("__keep")


def focus(name: str) -> Column:
    """Condition on operations: all, tools, reasoning, slow or errors."""
    return {"tools": F.col("category") == "tool", "reasoning": F.col("is_reasoning"), "slow": F.col("duration_ms") >= SLOW_MS, "errors": F.coalesce(F.col("status") == "error", F.lit(False))}.get(name, F.lit(True))


def focus_counts(operations: DataFrame) -> DataFrame:
    return operations.groupBy("conversation_id").agg(*(F.count_if(focus(n)).alias(n) for n in ("all", "tools", "reasoning", "slow", "errors")))


def inspect(records: DataFrame, density: str = "operations", focus_on: str = "all", text: str = "", context: str = "context") -> DataFrame:
    """What an inspector shows: operations at a density (overview, operations, records), in a focus, around matches.

    ``text`` is in the filter language; an operation matches if one of its records does. Without clauses, or with the
    context ``full``, all operations of the focus are shown; ``matches`` shows the matching ones, ``context`` their
    neighbours among the operations of the focus too. ``matched`` says which do match.
    """
    shown = build(records, raw=density == "records")
    shown = (overview(shown) if density == "overview" else shown).where(focus(focus_on))
    terms = dsl.parse(text)[0]
    if not terms:
        return shown.withColumn("matched", F.lit(True))
    hits = dsl.matching(records, text).select("conversation_id", F.col("id").alias("entry")).distinct()
    each = shown.select("conversation_id", "position", F.explode("entry_ids").alias("entry"))
    hit = each.join(hits, ["conversation_id", "entry"], "left_semi").select("conversation_id", "position").distinct().withColumn("hit", F.lit(True))
    shown = shown.join(hit, ["conversation_id", "position"], "left").withColumn("matched", F.coalesce("hit", F.lit(False))).drop("hit")
    if context == "full":
        return shown
    if context == "matches":
        return shown.where("matched")
    near = F.max("matched").over(Window.partitionBy("conversation_id").orderBy("position").rowsBetween(-1, 1))
    return shown.withColumn("__near", near).where("__near").drop("__near")


def run_map(operations: DataFrame) -> DataFrame:
    """Left edge and width in percent of each operation on its conversation's line from the first start to the last one's end."""
    of, place = Window.partitionBy("conversation_id"), F.col("position")
    start, end = F.min_by("started_at", place).over(of), F.max_by("ended_at", place).over(of)
    span = F.greatest(F.lit(1), F.unix_millis(end) - F.unix_millis(start))
    left = (F.unix_millis("started_at") - F.unix_millis(start)) * 100.0 / span
    width = F.greatest(F.lit(0.65), F.col("duration_ms") * 100.0 / span)
    return operations.withColumns({"left_pct": F.least(F.lit(99.2), left), "width_pct": F.least(F.lit(100.0) - left, width)})
