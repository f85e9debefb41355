"""A made-up workload: scenarios over two weeks, the same for the same ``now``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.schema import ROW

SCENARIOS, DAYS, AGENTS, MODELS = 23, 14, 9, 5
#: Scenarios in which a tool fails and the turn recovers, and in which the turn fails.
RECOVERED, FAILED = 5, 11
OPENING = ("agent.turn.started", "message.user", "model.request")
MIDDLE = ("model.reasoning", "tool.call", "tool.result", "model.response", "message.assistant", "tool.call", "tool.result", "test.evidence")
CLOSING = ("message.assistant", "agent.turn.completed")


def workload(spark: SparkSession, now: datetime, scenarios: int = SCENARIOS) -> DataFrame:
    """Records of the scenarios, 24 to 58 each, evenly spaced before ``now``."""
    s = F.col("scenario")
    records = F.lit(24) + (s * 7) % 35
    rows = spark.range(scenarios).select(F.col("id").cast("int").alias("scenario")).withColumn("n", records.cast("int"))
    rows = rows.select("scenario", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    i, n = F.col("i"), F.col("n")
    pick = lambda kinds, at: F.get(F.array(*map(F.lit, kinds)), at.cast("int"))
    kind = F.when(i < len(OPENING), pick(OPENING, i)).when(i >= n - len(CLOSING), pick(CLOSING, i - n + len(CLOSING))).otherwise(pick(MIDDLE, (i - len(OPENING)) % len(MIDDLE)))
    slug = F.format_string("scenario_%02d", s)
    minutes = F.lit(5) + (s * 11) % 55
    back = (s % DAYS) * F.lit(86_400_000) + minutes * 60_000
    at = F.timestamp_millis(F.lit(int(now.timestamp() * 1000)) - back.cast("long") + (minutes.cast("long") * 60_000 * i / n).cast("long"))
    rows = rows.withColumns({"kind": kind, "slug": slug, "at": at})
    tool = F.when(F.col("kind").startswith("tool."), F.concat(F.lit("tool_"), (s % 4).cast("string")))
    status = (
        F.when((F.col("kind") == "tool.result") & (s == RECOVERED) & (i < 8), "failed").when((F.col("kind") == "agent.turn.completed") & (s == FAILED), "failed")
        .when(F.col("kind").isin("agent.turn.completed", "tool.result"), "completed")
    )
    text = F.concat(F.lit("Step "), i.cast("string"), F.lit(" of "), "slug")
    usage = F.when(F.col("kind") == "agent.turn.completed", F.struct((n * 100).alias("input_tokens"), (n * 20).alias("output_tokens")))
    model = F.when(F.col("kind").startswith("model."), F.concat(F.lit("model-"), (s % MODELS).cast("string")))
    content = F.to_json(F.struct(text.alias("text"), model.alias("model"), usage.alias("usage")))
    columns = {
        "id": F.format_string("rec_demo_%s_%03d", "slug", "i"), "conversation_id": F.concat(F.lit("conv_demo_"), "slug"), "kind": F.col("kind"), "occurred_at": F.col("at"), "sequence": i,
        "trace_id": F.concat(F.lit("trace_"), "slug"), "agent": F.concat(F.lit("agent_"), (s % AGENTS).cast("string")), "tool": tool, "status": status,
        "tags": F.create_map(F.lit("source"), F.lit("demo")), "content": content, "content_size": F.octet_length(content),
    }
    return rows.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ROW))
