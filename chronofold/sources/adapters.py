"""Plain tables as records and search documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.schema import ROW


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(df: DataFrame, **columns) -> DataFrame:
    """df as records: the columns given, null for the rest."""
    size = F.octet_length(columns["content"]).cast("long")
    columns = {"content_size": size} | columns
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ROW))


def records_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'agent.turn.started' WHEN 'view' THEN 'message.user' WHEN 'click' THEN 'tool.call' WHEN 'error' THEN 'tool.result' ELSE 'message.assistant' END")
    return _row(
        e,
        id=F.concat(F.lit("rec_evt_"), F.col("event_id").cast("string")), conversation_id=F.concat(F.lit("conv_user_"), F.col("user_id").cast("string")),
        kind=kind, occurred_at=F.col("ts"), trace_id=F.concat(F.lit("trace_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")),
        agent=F.concat(F.lit("agent_"), (F.col("user_id") % 10).cast("string")),
        tool=F.when(F.col("event_type").isin("click", "error"), F.concat(F.lit("tool_"), (F.col("k") % 5).cast("string"))),
        status=F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "completed"),
        tags=F.create_map(F.lit("k"), F.col("k").cast("string")), content=F.col("props"),
    )


def records_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id as int), cast(turn as int))")
    return _row(
        c,
        id=F.concat_ws("_", F.lit("rec"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), conversation_id=F.concat(F.lit("conv_"), F.col("conv_id").cast("string")),
        kind=F.concat(F.lit("message."), F.col("role")), occurred_at=at, sequence=F.col("turn"), content=F.to_json(F.struct("text")),
        tags=F.create_map(F.lit("role"), F.col("role")),
    )


def records_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as steps of a conversation: odd ones call a tool, even ones are its result."""
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    x = table(spark, sf_dir, "lineitem").withColumn("step", step)
    number = F.col("step").cast("string")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(step * 4000000 + l_partkey * 7 % 3999000 as decimal(18, 6)) / 1000)")
    return _row(
        x,
        id=F.concat_ws("_", F.lit("rec_line"), F.col("l_orderkey").cast("string"), number), conversation_id=F.concat(F.lit("conv_order_"), F.col("l_orderkey").cast("string")),
        kind=F.when(F.col("step") % 2 == 1, "tool.call").otherwise("tool.result"), occurred_at=at, sequence=F.col("step"),
        tool=F.concat(F.lit("tool_"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("x")).otherwise(number)), trace_id=F.lit("trace_1"), content=F.to_json(F.struct(F.col("l_returnflag").alias("flag"))),
        tags=F.create_map(F.lit("line"), number),
    )


def documents_for_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents with their search text (the key text is part of it)."""
    d = table(spark, sf_dir, "documents")
    rows = _row(
        d,
        id=F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), conversation_id=F.col("source"), kind=F.lit("document"),
        occurred_at=F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)"),
        tags=F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), content=F.col("text"),
    )
    return rows.withColumn("search_text", F.concat(F.lit("text \n"), F.col("content"))).drop("content")
