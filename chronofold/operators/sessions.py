"""Analytics of sessions: indicators, review blocks, context, geometry and daily activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronofold.functions import jsontext as js
from chronofold.operators.query import positions
from chronofold.schema import order_key, time_order

FAILURES = ("failed", "error", "cancelled")


def conversation() -> WindowSpec:
    return Window.partitionBy("conversation_id")


def in_order() -> WindowSpec:
    return conversation().orderBy(*time_order())


def failed(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*FAILURES), F.lit(False))


def reasoning(kind: Column, content: Column) -> Column:
    """Whether a record is a reasoning step, by its kind or its content's type."""
    of_content = F.lower(js.string_at(js.parsed(content), "$.type"))
    return F.lower(kind).contains("reasoning") | F.lower(kind).contains("thinking") | F.coalesce(of_content.isin("reasoning", "thinking"), F.lit(False))


def reasoning_text(content: Column) -> Column:
    """What a reasoning step says, null if nothing."""
    v = js.parsed(content)
    return F.coalesce(*(js.string_at(v, f"$.{k}") for k in ("text", "reasoning", "thinking", "summary")))


def message(kind: Column) -> Column:
    return kind.isin("message.user", "message.assistant")


def _first_seen(records: DataFrame, value: Column, name: str) -> DataFrame:
    """Distinct values of each conversation in the order of their first record."""
    first = records.withColumn("value", value).where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("conversation_id", "value").agg(F.min(order_key()).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "value")))
    return first.groupBy("conversation_id").agg(F.transform(listed, lambda x: x["value"]).alias(name))


def analyze(records: DataFrame) -> DataFrame:
    """One row of indicators per conversation; tokens are only those that completed turns report."""
    v = js.parsed(F.col("content"))
    kind, done = F.col("kind"), F.col("kind") == "agent.turn.completed"
    text = js.string_at(v, "$.text")
    user = (kind == "message.user") & text.isNotNull()
    usage = lambda c: F.sum(F.when(done, c).otherwise(0.0)).cast("long")
    count = lambda c: F.count_if(c).alias
    rows = records.groupBy("conversation_id").agg(
        F.max_by(F.when(done, F.coalesce(failed(F.col("status")), F.lit(False))), F.when(done, order_key())).alias("terminal_failed"),
        F.max(failed(F.col("status"))).alias("any_failed"), F.max(F.coalesce(F.lower("status") == "running", F.lit(False))).alias("any_running"),
        (F.unix_millis(F.max("occurred_at")) - F.unix_millis(F.min("occurred_at"))).alias("duration_ms"),
        count(kind == "agent.turn.started")("turns"), count(kind == "tool.call")("tool_calls"), count(kind == "model.request")("model_calls"),
        usage(F.coalesce(js.number_at(v, "$.usage.input_tokens"), F.lit(0.0))).alias("input_tokens"), usage(F.coalesce(js.number_at(v, "$.usage.output_tokens"), F.lit(0.0))).alias("output_tokens"),
        usage(js.first_number(v, "$.usage.reasoning_tokens", "$.usage.output_tokens_details.reasoning_tokens", "$.usage.completion_tokens_details.reasoning_tokens")).alias("reasoning_tokens"),
        usage(js.first_number(v, "$.usage.cache_read_input_tokens", "$.usage.cached_input_tokens", "$.usage.input_tokens_details.cached_tokens")).alias("cache_read_tokens"),
        F.count_if(reasoning(kind, F.col("content"))).alias("reasoning_events"),
        F.coalesce(F.min_by(F.when(user & (text != ""), text), F.when(user & (text != ""), order_key())), F.max(F.when(user, F.lit("")))).alias("prompt"),
    )
    bad = F.coalesce("terminal_failed", "any_failed")
    status = F.when(bad, "failed").when(F.col("any_running") & F.col("terminal_failed").isNull(), "running").when(F.col("terminal_failed").isNotNull(), "complete").otherwise("captured")
    rows = rows.withColumn("status", status).drop("terminal_failed", "any_failed", "any_running")
    models = _first_seen(records.where("kind = 'model.request'"), js.string_at(v, "$.model"), "models")
    traces = _first_seen(records, F.col("trace_id"), "traces")
    empty = F.array().cast("array<string>")
    joined = rows.join(models, "conversation_id", "left").join(traces, "conversation_id", "left")
    return joined.withColumns({"models": F.coalesce("models", empty), "traces": F.coalesce("traces", empty)})


def review_blocks(records: DataFrame) -> DataFrame:
    """Messages one by one and the runs of activity between them, with counts, tools and duration."""
    is_message = message(F.col("kind"))
    rows = positions(records).withColumn("is_message", is_message)
    # a run is named by the messages before it; a message is a block of its own
    before = F.sum(F.col("is_message").cast("int")).over(in_order())
    rows = rows.withColumn("block", F.when(F.col("is_message"), 2 * before - 1).otherwise(2 * before))
    last_answer = F.max(F.when(F.col("kind") == "message.assistant", F.col("position"))).over(conversation())
    rows = rows.withColumn("is_latest_assistant", F.coalesce((F.col("kind") == "message.assistant") & (F.col("position") == last_answer), F.lit(False)))
    think, first = reasoning(F.col("kind"), F.col("content")), F.struct("position", "id")
    # tools in order of first use: a position for each tool once
    seen = F.row_number().over(Window.partitionBy("conversation_id", "block", "tool").orderBy("position")) == 1
    rows = rows.withColumn("new_tool", F.when(seen & (F.col("tool") != ""), F.struct("position", "tool")))
    return rows.groupBy("conversation_id", "block", F.when(F.col("is_message"), "message").otherwise("activity").alias("type")).agg(
        F.min(first)["id"].alias("first_id"), F.max(first)["id"].alias("last_id"), F.count(F.lit(1)).alias("records"),
        (F.unix_millis(F.max("occurred_at")) - F.unix_millis(F.min("occurred_at"))).alias("duration_ms"),
        F.count_if(F.col("kind") == "tool.call").alias("tool_calls"), F.count_if(F.col("kind") == "tool.result").alias("tool_results"),
        F.count_if(F.col("kind").startswith("model.") & ~think).alias("model_events"), F.count_if(think).alias("reasoning_events"), F.count_if(failed(F.col("status"))).alias("errors"),
        F.transform(F.array_sort(F.collect_list("new_tool")), lambda t: t["tool"]).alias("tools"), F.max("is_latest_assistant").alias("is_latest_assistant"),
        (F.count_if(F.col("kind").startswith("agent.turn.")) == F.count(F.lit(1))).alias("only_turns"),
    )


def coalesced(records: DataFrame) -> DataFrame:
    """Neighbouring assistant records of one trace as one, texts joined; other records stay."""
    answer, trace = F.col("kind") == "message.assistant", F.col("trace_id")
    before = F.lag(F.struct(answer.alias("answer"), trace.alias("trace"))).over(in_order())
    goes_on = F.coalesce(answer & before["answer"] & trace.eqNullSafe(before["trace"]), F.lit(False))
    rows = records.withColumn("island", F.sum((~goes_on).cast("int")).over(in_order()))
    text = js.string_at(js.parsed(F.col("content")), "$.text")
    parts = F.array_sort(F.collect_list(F.struct(order_key().alias("at"), text.alias("text"))))
    return rows.groupBy("conversation_id", "island").agg(
        F.min_by("id", order_key()).alias("id"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("grouped_count"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def with_context(records: DataFrame, matches: Column, mode: str = "context") -> DataFrame:
    """The records to show around matching ones: matches alone, with their neighbours, or all (full)."""
    if mode == "full":
        return records
    if mode == "matches":
        return records.where(matches)
    near = F.max(F.coalesce(matches, F.lit(False))).over(in_order().rowsBetween(-1, 1))
    return records.withColumn("__near", near).where("__near").drop("__near")


def daily_activity(rolled: DataFrame, today: Column, days: int = 14, timezone: str = "UTC") -> DataFrame:
    """(day, sessions, events, agents) of each of the last days by the conversations' first record; days without any are 0."""
    days = max(1, days)
    day = F.to_date(F.from_utc_timestamp("first_seen", timezone))
    calendar = rolled.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    of = rolled.withColumn("day", day).where(F.col("day").between(F.date_sub(today, days - 1), today))
    totals = of.groupBy("day").agg(F.count(F.lit(1)).alias("sessions"), F.sum("record_count").alias("events"))
    agents = of.select("day", F.explode("agents").alias("agent")).distinct().groupBy("day").agg(F.count(F.lit(1)).alias("agents"))
    return calendar.join(totals, "day", "left").join(agents, "day", "left").fillna(0, ["sessions", "events", "agents"])


def activity_totals(rolled: DataFrame, today: Column, days: int = 14, timezone: str = "UTC") -> DataFrame:
    """Sessions, events and distinct agents of all conversations; active days and the busiest day's events of the last days."""
    daily = daily_activity(rolled, today, days, timezone).agg(F.count_if(F.col("sessions") > 0).alias("active_days"), F.greatest(F.lit(1), F.max("events")).alias("max_events"))
    agents = rolled.select(F.explode("agents").alias("a")).agg(F.count_distinct("a").alias("agents"))
    sums = rolled.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("events"))
    return sums.join(F.broadcast(daily)).join(F.broadcast(agents))


def export(records: DataFrame, rolled: DataFrame) -> DataFrame:
    """(conversation_id, value): a session as one JSON object of conversation, analysis and timeline."""
    # maps have no order: entries are compared by their place alone
    before = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(order_key().alias("at"), F.struct(*records.columns).alias("entry"))), before)
    timeline = records.groupBy("conversation_id").agg(F.transform(entries, lambda e: e["entry"]).alias("timeline"))
    analysis = analyze(records)
    analysis = analysis.select("conversation_id", F.struct(*(c for c in analysis.columns if c != "conversation_id")).alias("analysis"))
    summary = rolled.select("conversation_id", F.struct(*rolled.columns).alias("conversation"))
    joined = summary.join(analysis, "conversation_id").join(timeline, "conversation_id")
    return joined.select("conversation_id", F.to_json(F.struct("conversation", "analysis", "timeline")).alias("value"))
