"""Registered queries over the test tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import jsontext, text
from chronofold.operators import dsl, integrity, normalize, operations, query, search, sessions
from chronofold.operators.query import RecordFilter
from chronofold.schema import ID_PATTERN, MAX_SEGMENT_RECORDS
from chronofold.sources import adapters
from chronofold.sources.shared import shared_dir
from chronofold.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The records of events, conversations and documents as the adapters make them.
VIEWS = {
    "er": """SELECT 'rec_evt_' || event_id AS id, 'conv_user_' || user_id AS conversation_id,
      CASE event_type WHEN 'signup' THEN 'agent.turn.started' WHEN 'view' THEN 'message.user' WHEN 'click' THEN 'tool.call' WHEN 'error' THEN 'tool.result' ELSE 'message.assistant' END AS kind,
      ts::TIMESTAMP AS occurred_at, 'trace_' || user_id || '_' || strftime(ts, '%Y%m%d') AS trace_id, 'agent_' || (user_id % 10) AS agent,
      CASE WHEN event_type IN ('click', 'error') THEN 'tool_' || (k % 5) END AS tool,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' END AS status, k, props AS content, strlen(props) AS content_size, user_id, epoch_us(ts::TIMESTAMP) // 1000 AS ms
      FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "cr": """SELECT 'rec_' || conv_id || '_' || turn AS id, 'conv_' || conv_id AS conversation_id, 'message.' || role AS kind,
      TIMESTAMP '2024-01-01' + to_minutes(conv_id::INT) + to_seconds(turn) AS occurred_at, turn AS sequence, text, role FROM conversations""",
    "sd": """SELECT 'doc_' || doc_id AS id, source AS conversation_id, lang, 'text ' || chr(10) || text AS search_text,
      TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS occurred_at FROM documents""",
    "lr": """SELECT 'conv_order_' || l_orderkey AS conversation_id, 'rec_line_' || l_orderkey || '_' || n AS id, n - 1 AS position, CASE WHEN n % 2 = 1 THEN 'tool.call' ELSE 'tool.result' END AS kind,
      n * 4000000 + l_partkey * 7 % 3999000 AS ms FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""",
}


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            sql_text = sql.strip()
            if views:
                head = _with(*views).strip()
                sql_text = f"{head}, {sql_text[5:]}" if sql_text.startswith("WITH ") else f"{head} {sql_text}"
            ORACLES[name] = sql_text
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.records_from_events(spark, sf_dir)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.records_from_conversations(spark, sf_dir)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Columns for comparison: times without zone, arrays as joined text."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType.simpleString()
        out.append(F.array_join(c, "|").alias(c) if kind == "array<string>" else F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c))
    return df.select(*out)


_ROLLUP = "count(*) AS record_count, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, coalesce(string_agg(DISTINCT agent, '|' ORDER BY agent), '') AS agents, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds"


# roll-ups


@register("conversations_rollup", f"SELECT conversation_id, {_ROLLUP} FROM er GROUP BY 1", ("er",))
def _(spark, sf):
    return _plain(query.conversations(_events(spark, sf)))


@register("conversations_topk", f"SELECT conversation_id, {_ROLLUP} FROM er GROUP BY 1 ORDER BY last_seen DESC, conversation_id LIMIT 100", ("er",))
def _(spark, sf):
    return _plain(query.newest(query.conversations(_events(spark, sf))))


@register("rollup_delta_merge", f"SELECT conversation_id, {_ROLLUP} FROM er GROUP BY 1", ("er",))
def _(spark, sf):
    parts = query.deltas(_events(spark, sf), F.date_format("occurred_at", "yyyyMMdd"))
    return _plain(query.merge(parts.unionByName(parts)))


@register("busiest_session", f"SELECT conversation_id, {_ROLLUP} FROM er GROUP BY 1 ORDER BY record_count DESC, last_seen DESC, conversation_id LIMIT 1", ("er",))
def _(spark, sf):
    return _plain(query.busiest(query.conversations(_events(spark, sf))))


@register("session_status", "SELECT conversation_id, CASE WHEN count(*) FILTER (kind = 'agent.turn.completed') > 0 THEN 'complete' WHEN count(*) FILTER (kind LIKE 'message.%') > 0 THEN 'captured' ELSE 'evidence' END AS status FROM er GROUP BY 1", ("er",))
def _(spark, sf):
    return query.session_status(query.conversations(_events(spark, sf))).select("conversation_id", "status")


@register("session_list_filter", "SELECT conversation_id, count(*) AS record_count FROM er GROUP BY 1 HAVING count(*) FILTER (kind LIKE 'agent.%') > 0 AND (contains(conversation_id, '7') OR count(*) FILTER (contains(agent, '7')) > 0)", ("er",))
def _(spark, sf):
    return query.session_list(query.conversations(_events(spark, sf)), "agent", "7").select("conversation_id", "record_count")


@register("stream_rollup", f"SELECT conversation_id, {_ROLLUP} FROM er GROUP BY 1", ("er",))
def _(spark, sf):
    """Each record comes twice, in micro-batches, and counts once; half way through the deltas are compacted."""
    out = f"{shared_dir(spark)}/chronofold-stream/{uuid.uuid4().hex}"
    rows = _events(spark, sf).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    rows.unionByName(rows.withColumn("part", (F.col("part") + 1) % 3)).repartition(3, "part").drop("part").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    ingest.ingest(stream, f"{out}/out", f"{out}/state").awaitTermination()
    ingest.compact(spark, f"{out}/out")
    return _plain(ingest.conversations(spark, f"{out}/out"))


# filters, timelines, look-ups

_RECORD = "id, conversation_id, kind, occurred_at, trace_id, agent, tool, status"


def _records(df: DataFrame) -> DataFrame:
    return _plain(df, "id", "conversation_id", "kind", "occurred_at", "trace_id", "agent", "tool", "status")


@register("query_by_kind", f"SELECT {_RECORD} FROM er WHERE kind = 'tool.call' ORDER BY occurred_at, id LIMIT 100", ("er",))
def _(spark, sf):
    return _records(query.find(_events(spark, sf), RecordFilter(kind="tool.call")))


@register("query_by_agent_status", f"SELECT {_RECORD} FROM er WHERE agent = 'agent_3' AND status = 'error' ORDER BY occurred_at, id LIMIT 50", ("er",))
def _(spark, sf):
    return _records(query.find(_events(spark, sf), RecordFilter(agent="agent_3", status="error"), 50))


@register("query_by_tag", f"SELECT {_RECORD} FROM er WHERE k = 42 ORDER BY occurred_at, id LIMIT 100", ("er",))
def _(spark, sf):
    return _records(query.find(_events(spark, sf), RecordFilter(tags=query.parse_tags(["k=1", "k=42"]))))


@register("query_time_range", f"WITH b AS (SELECT min(occurred_at) + INTERVAL 1 DAY AS lo, min(occurred_at) + INTERVAL 3 DAY AS hi FROM er) SELECT {_RECORD} FROM er, b WHERE occurred_at BETWEEN lo AND hi ORDER BY occurred_at, id LIMIT 1000", ("er",))
def _(spark, sf):
    rows = _events(spark, sf)
    low = rows.agg(F.min("occurred_at").cast("timestamp_ntz")).first()[0]
    return _records(query.find(rows, RecordFilter(since=str(low + _days(1)), until=str(low + _days(3))), 1000))


def _days(n: int):
    from datetime import timedelta

    return timedelta(days=n)


@register("timeline_one_conversation", f"SELECT {_RECORD} FROM er WHERE conversation_id = 'conv_user_7'", ("er",))
def _(spark, sf):
    return _records(query.timeline(_events(spark, sf), "conv_user_7"))


@register("timeline_with_sequence", "SELECT id, sequence, kind, occurred_at, row_number() OVER (ORDER BY occurred_at, sequence, id) - 1 AS position FROM cr WHERE conversation_id = 'conv_5'", ("cr",))
def _(spark, sf):
    rows = query.positions(query.timeline(_turns(spark, sf), "conv_5"))
    return _plain(rows, "id", "sequence", "kind", "occurred_at", "position")


@register("list_records", f"SELECT {_RECORD} FROM er", ("er",))
def _(spark, sf):
    return _records(query.listing(_events(spark, sf)))


@register("get_record", f"SELECT {_RECORD} FROM er WHERE id = 'rec_evt_17'", ("er",))
def _(spark, sf):
    return _records(query.get(_events(spark, sf), "rec_evt_17"))


@register("record_index", "SELECT id, row_number() OVER (PARTITION BY conversation_id ORDER BY occurred_at, id) - 1 AS position FROM er", ("er",))
def _(spark, sf):
    return query.positions(_events(spark, sf)).select("id", "position")


@register("observed_values", "SELECT DISTINCT field, value FROM (SELECT 'kind' AS field, kind AS value FROM er UNION ALL SELECT 'agent', agent FROM er UNION ALL SELECT 'tool', tool FROM er UNION ALL SELECT 'status', status FROM er UNION ALL SELECT 'trace_id', trace_id FROM er UNION ALL SELECT 'tag.k', k::VARCHAR FROM er) WHERE value <> ''", ("er",))
def _(spark, sf):
    return query.observed_values(_events(spark, sf))


@register("suggestions", "SELECT DISTINCT trace_id AS value FROM er WHERE contains(trace_id, '_1') ORDER BY 1 LIMIT 7", ("er",))
def _(spark, sf):
    return query.suggestions(query.observed_values(_events(spark, sf), ("trace_id",), tags=False), "value", "_1").select("value")


@register("offset_since_start", "SELECT id, ms - min(ms) OVER (PARTITION BY conversation_id) AS offset_ms FROM er", ("er",))
def _(spark, sf):
    return query.positions(_events(spark, sf)).select("id", "offset_ms")


# sessions


_ISLANDS = """WITH m AS (SELECT *, kind IN ('message.user', 'message.assistant') AS msg, row_number() OVER (PARTITION BY conversation_id ORDER BY occurred_at, id) - 1 AS position FROM er),
  b AS (SELECT *, sum(msg::INT) OVER (PARTITION BY conversation_id ORDER BY occurred_at, id) AS before FROM m),
  i AS (SELECT *, CASE WHEN msg THEN 2 * before - 1 ELSE 2 * before END AS block FROM b)"""


@register("review_blocks", _ISLANDS + """ SELECT conversation_id, block::BIGINT AS block, CASE WHEN bool_or(msg) THEN 'message' ELSE 'activity' END AS type, arg_min(id, position) AS first_id, arg_max(id, position) AS last_id, count(*) AS records,
  max(ms) - min(ms) AS duration_ms, count(*) FILTER (kind = 'tool.call') AS tool_calls, count(*) FILTER (kind = 'tool.result') AS tool_results, count(*) FILTER (status = 'error') AS errors, count(DISTINCT tool) AS n_tools
  FROM i GROUP BY conversation_id, block""", ("er",))  # fmt: skip
def _(spark, sf):
    rows = sessions.review_blocks(_events(spark, sf)).withColumn("n_tools", F.size("tools").cast("long"))
    return rows.select("conversation_id", "block", "type", "first_id", "last_id", "records", "duration_ms", "tool_calls", "tool_results", "errors", "n_tools")


@register("latest_assistant", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY conversation_id ORDER BY occurred_at DESC, sequence DESC, id DESC) AS n FROM cr WHERE kind = 'message.assistant') WHERE n = 1", ("cr",))
def _(spark, sf):
    return query.latest(_turns(spark, sf), "message.assistant").where("is_latest").select("id")


@register("context_expansion", "SELECT id FROM (SELECT id, max((kind = 'tool.result')::INT) OVER (PARTITION BY conversation_id ORDER BY occurred_at, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM er) WHERE near = 1", ("er",))
def _(spark, sf):
    return sessions.with_context(_events(spark, sf), F.col("kind") == "tool.result").select("id")


@register("assistant_coalesce", """WITH g AS (SELECT *, CASE WHEN kind = 'message.assistant' AND lag(kind) OVER p = kind AND lag(trace_id) OVER p IS NOT DISTINCT FROM trace_id THEN 0 ELSE 1 END AS new FROM er WINDOW p AS (PARTITION BY conversation_id ORDER BY occurred_at, id)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY occurred_at, id) AS island FROM g)
  SELECT conversation_id, arg_min(id, occurred_at) AS id, min(kind) AS kind, count(*) AS grouped_count FROM n GROUP BY conversation_id, island""", ("er",))  # fmt: skip
def _(spark, sf):
    return sessions.coalesced(_events(spark, sf)).select("conversation_id", "id", "kind", "grouped_count")


@register("assistant_coalesce_text", """WITH g AS (SELECT *, CASE WHEN kind = 'message.assistant' AND lag(kind) OVER p = kind THEN 0 ELSE 1 END AS new FROM cr WINDOW p AS (PARTITION BY conversation_id ORDER BY occurred_at, sequence, id)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY occurred_at, sequence, id) AS island FROM g)
  SELECT conversation_id, arg_min(id, sequence) AS id, count(*) AS grouped_count, string_agg(text, '' ORDER BY sequence) AS text FROM n GROUP BY conversation_id, island""", ("cr",))  # fmt: skip
def _(spark, sf):
    return sessions.coalesced(_turns(spark, sf)).select("conversation_id", "id", "grouped_count", "text")


@register("session_kpis", """SELECT conversation_id, CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'failed' ELSE 'captured' END AS status, max(ms) - min(ms) AS duration_ms,
  count(*) FILTER (kind = 'agent.turn.started') AS turns, count(*) FILTER (kind = 'tool.call') AS tool_calls, 0::BIGINT AS model_calls, count(DISTINCT trace_id) AS n_traces FROM er GROUP BY 1""", ("er",))  # fmt: skip
def _(spark, sf):
    rows = sessions.analyze(_events(spark, sf)).withColumn("n_traces", F.size("traces").cast("long"))
    return rows.select("conversation_id", "status", "duration_ms", "turns", "tool_calls", "model_calls", "n_traces")


@register("session_prompts", "SELECT conversation_id, arg_min(text, sequence) AS prompt FROM cr WHERE kind = 'message.user' AND text <> '' GROUP BY 1", ("cr",))
def _(spark, sf):
    return sessions.analyze(_turns(spark, sf)).where("prompt <> ''").select("conversation_id", "prompt")


_DAILY = """WITH c AS (SELECT conversation_id, count(*) AS n, min(occurred_at)::DATE AS day FROM er GROUP BY 1), t AS (SELECT max(day) AS today FROM c),
  cal AS (SELECT unnest(generate_series(today - INTERVAL 13 DAY, today::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM t),
  a AS (SELECT c.day, e.agent FROM c JOIN er e USING (conversation_id) GROUP BY ALL)"""


def _today(rolled: DataFrame):
    return F.lit(rolled.agg(F.max(F.to_date("first_seen"))).first()[0])


@register("daily_activity", _DAILY + " SELECT cal.day, count(c.conversation_id) AS sessions, coalesce(sum(c.n), 0)::BIGINT AS events, (SELECT count(*) FROM a WHERE a.day = cal.day) AS agents FROM cal LEFT JOIN c ON c.day = cal.day GROUP BY cal.day", ("er",))
def _(spark, sf):
    rolled = query.conversations(_events(spark, sf))
    return sessions.daily_activity(rolled, _today(rolled))


@register("activity_totals", _DAILY + ", d AS (SELECT cal.day, count(c.conversation_id) AS sessions, coalesce(sum(c.n), 0)::BIGINT AS events FROM cal LEFT JOIN c ON c.day = cal.day GROUP BY cal.day) SELECT (SELECT count(*) FROM c) AS sessions, (SELECT sum(n)::BIGINT FROM c) AS events, count(*) FILTER (sessions > 0) AS active_days, greatest(1, max(events)) AS max_events, (SELECT count(DISTINCT agent) FROM er) AS agents FROM d", ("er",))
def _(spark, sf):
    rolled = query.conversations(_events(spark, sf))
    return sessions.activity_totals(rolled, _today(rolled))


# the filter language


def _dsl(name: str, text_: str, where: str) -> None:
    @register(name, f"SELECT id FROM (SELECT *, ms - min(ms) OVER (PARTITION BY conversation_id) AS offset_ms FROM er) WHERE {where}", ("er",))
    def _(spark, sf):
        return dsl.matching(_events(spark, sf), text_).select("id")


_dsl("dsl_wildcard", "kind:tool.* tool:tool_*3", "kind LIKE 'tool.%' AND tool LIKE 'tool_%3'")
_dsl("dsl_negation", "-status:error -kind:message agent:AGENT_1", "coalesce(status, '') NOT LIKE '%error%' AND kind NOT LIKE '%message%' AND contains(agent, 'agent_1')")
_dsl("dsl_has", "has:tool -has:status", "tool IS NOT NULL AND status IS NULL")
_dsl("dsl_size_offset", "size:>=0.007kb offset:<=200h offset:>1s", "content_size >= 7.168 AND offset_ms <= 720000000 AND offset_ms > 1000")
_dsl("dsl_or", "tool:tool_1|tool_4 status:=ERROR", "(contains(tool, 'tool_1') OR contains(tool, 'tool_4')) AND status = 'error'")
_dsl("dsl_text_tag", 'tag.k:4 trace_1', "contains(k::VARCHAR, '4') AND contains(trace_id, 'trace_1')")


# set operations and integrity


@register("orphan_anti_join", "SELECT 'blob_' || p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R')")
def _(spark, sf):
    lines, parts = adapters.table(spark, sf, "lineitem"), adapters.table(spark, sf, "part")
    rows = lines.select(F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "blob").otherwise("segment").alias("storage"), F.concat(F.lit("blob_"), F.col("l_partkey").cast("string")).alias("content_key"))
    return integrity.orphans(rows, parts.select(F.concat(F.lit("blob_"), F.col("p_partkey").cast("string")).alias("key")))


@register("unseen_anti_join", "SELECT id FROM er WHERE k < 50", ("er",))
def _(spark, sf):
    rows = _events(spark, sf)
    return query.unseen(rows.select("id"), rows.where(F.col("tags")["k"].cast("int") >= 50), "id")


def _line_duplicates(rows: DataFrame) -> DataFrame:
    return integrity.duplicate_ids(rows.select(F.concat(F.lit("s"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("key"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_partkey").alias("entry_index")))


@register("duplicate_ids", "SELECT key, 'DUPLICATE_RECORD: ' || id || ' also in ' || before AS issue FROM (SELECT 's' || lpad(l_linenumber::VARCHAR, 2, '0') AS key, 'r' || l_orderkey AS id, lag('s' || lpad(l_linenumber::VARCHAR, 2, '0')) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) WHERE before IS NOT NULL")
def _(spark, sf):
    return _line_duplicates(adapters.table(spark, sf, "lineitem"))


@register("invalid_records", "SELECT id FROM (SELECT event_type || '!' || event_id AS id FROM events WHERE event_id % 3 = 0)")
def _(spark, sf):
    e = adapters.table(spark, sf, "events")
    rows = e.select(F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "!").otherwise("."), F.col("event_id").cast("string")).alias("id"), F.lit("conv_1").alias("conversation_id"), F.col("event_type").alias("kind"))
    return integrity.invalid_records(rows, ID_PATTERN).select("id")


@register("content_digest", "SELECT id, sha256(content) AS content_sha256, content_size FROM er", ("er",))
def _(spark, sf):
    return _events(spark, sf).select("id", F.sha2("content", 256).alias("content_sha256"), "content_size")


@register("conversation_hash", "SELECT DISTINCT conversation_id, sha256(conversation_id) AS conversation_hash FROM er", ("er",))
def _(spark, sf):
    return _events(spark, sf).select("conversation_id", F.sha2("conversation_id", 256).alias("conversation_hash")).distinct()


@register("canonical_content", """SELECT id, '{"k":' || k || '}' AS canonical, 'k ' || chr(10) || k AS search_text FROM er""", ("er",))
def _(spark, sf):
    return _events(spark, sf).select("id", jsontext.canonical_json("content").alias("canonical"), jsontext.search_text("content").alias("search_text"))


# search

_BM25 = """WITH d AS (SELECT id, occurred_at, lang, conversation_id, search_text, regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}]+') AS words FROM sd),
  st AS (SELECT count(*) AS n, sum(len(words))::DOUBLE / count(*) AS mean FROM d),
  w AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM d),
  p AS (SELECT term, id, dl, count(*) AS tf FROM w GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT p.term, p.id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score FROM p JOIN f USING (term), st)"""


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "total", *more)


def _found(where: str, score: str, having: str = "", docs: str = "true") -> str:
    return f"{_BM25}, h AS (SELECT id, {score} AS score FROM s WHERE {where} GROUP BY id {having}), x AS (SELECT h.id, score, occurred_at, search_text, words FROM h JOIN d USING (id) WHERE {docs}) SELECT id, round(score, 6) AS score, (SELECT count(*) FROM x) AS total FROM x ORDER BY x.score DESC, occurred_at DESC, id LIMIT 100"


@register("tokenize_stats", "WITH w AS (SELECT regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}]+') AS t FROM sd) SELECT count(*) AS documents, sum(len(t))::BIGINT AS terms, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM w)) AS vocabulary FROM w", ("sd",))
def _(spark, sf):
    words = adapters.documents_for_search(spark, sf).select(text.tokens(F.col("search_text")).alias("w"))
    vocabulary = words.select(F.explode("w").alias("t")).agg(F.count_distinct("t").alias("vocabulary"))
    return words.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("w")).alias("terms")).join(F.broadcast(vocabulary))


@register("vocab_top_terms", "SELECT term, count(DISTINCT id) AS df, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}]+')) AS term FROM sd) GROUP BY 1 ORDER BY n DESC, term LIMIT 50", ("sd",))
def _(spark, sf):
    rows = search.postings(adapters.documents_for_search(spark, sf))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(50)


def _index(spark: SparkSession, sf: str) -> search.Index:
    """The index of the documents, written once for a session and a set of tables and looked up from then on."""
    path = f"{shared_dir(spark)}/chronofold-index/{spark.sparkContext.applicationId}/{jsontext.sha256(sf)[:16]}"
    if path not in _stored:
        search.store(adapters.documents_for_search(spark, sf), path)
        _stored.add(path)
    return search.load(spark, path)


_stored: set[str] = set()


@register("search_and_terms", _found("term IN ('licensed', 'license')", "sum(score)", "HAVING count(*) = 2"), ("sd",))
def _(spark, sf):
    return _hits(search.search(_index(spark, sf), "licensed license"))


@register("search_duplicate_term", _found("term = 'licensed'", "2 * sum(score)"), ("sd",))
def _(spark, sf):
    return _hits(search.search(_index(spark, sf), "licensed LICENSED"))


@register("search_phrase", _found("term IN ('licensed', 'under', 'the')", "2 * sum(score)", "HAVING count(*) = 3", "contains(' ' || array_to_string(words, ' ') || ' ', ' licensed under the ')"), ("sd",))
def _(spark, sf):
    return _hits(search.search(_index(spark, sf), '"Licensed under the"'))


@register("search_prefix", _found("starts_with(term, 'lice')", "sum(score)"), ("sd",))
def _(spark, sf):
    return _hits(search.search(_index(spark, sf), "lice*"))


@register("search_filtered", _found("term = 'the'", "sum(score)", "", "lang = 'en' AND conversation_id = 'src3'"), ("sd",))
def _(spark, sf):
    return _hits(search.search(_index(spark, sf), "the", RecordFilter(conversation_id="src3", tags={"lang": "en"})))


@register("search_empty", "SELECT id, 0.0::DOUBLE AS score, count(*) OVER () AS total FROM sd ORDER BY occurred_at DESC, id LIMIT 100", ("sd",))
def _(spark, sf):
    return _hits(search.search(_index(spark, sf)))


_SNIP = "SELECT id, CASE WHEN st > 0 THEN '…' ELSE '' END || trim(substr(search_text, st + 1, 240)) || CASE WHEN st + 240 < length(search_text) THEN '…' ELSE '' END AS snippet FROM (SELECT id, search_text, greatest(0, instr(lower(search_text), 'licensed') - 81) AS st FROM (SELECT id, trim(search_text) AS search_text, regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}]+') AS words FROM sd) WHERE list_contains(words, 'licensed'))"


@register("search_snippet", _SNIP, ("sd",))
def _(spark, sf):
    docs = adapters.documents_for_search(spark, sf).where(F.array_contains(text.tokens(F.col("search_text")), "licensed"))
    return docs.select("id", text.snippet(F.col("search_text"), F.lit("licensed")).alias("snippet"))


@register("clause_intersect", "WITH w AS (SELECT id, unnest(regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}]+')) AS t FROM sd) SELECT id FROM w WHERE t IN ('the', 'of') GROUP BY id HAVING count(DISTINCT t) = 2", ("sd",))
def _(spark, sf):
    rows = search.postings(adapters.documents_for_search(spark, sf))
    return rows.where("term = 'the'").select("id").intersect(rows.where("term = 'of'").select("id"))


# normalisation



@register("kind_classification", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'model.generation' WHEN 1 THEN 'tool.execution' WHEN 2 THEN 'retrieval.rerank' WHEN 3 THEN 'output.parse' WHEN 4 THEN 'model.embedding' WHEN 5 THEN 'agent.invoke' ELSE 'trace.span' END AS kind FROM events""")
def _(spark, sf):
    e = adapters.table(spark, sf, "events")
    keys = ("gen_ai.operation.name", "gen_ai.operation.name", "openinference.span.kind", "langsmith.span.kind", "ai.operationId", "other", "other")
    values = ("Chat", "execute_tool", "reranker", "Parser", "ai.embed.doEmbed", "x", "y")
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 7 + 1).cast("int"))
    name = F.when(F.col("event_id") % 7 == 5, "My Agent run").otherwise("span")
    return e.select("event_id", normalize.kind_of(name, F.create_map(pick(keys), pick(values))).alias("kind"))


def _exports(spark: SparkSession, sf: str) -> DataFrame:
    """Events as export requests of a span each, as JSON comes in."""
    e = adapters.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    value = lambda kind, c: F.to_json(F.struct(c.cast("string").alias(kind)))
    attribute = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    attributes = F.array(
        attribute("session.id", value("stringValue", F.concat(F.lit("user_"), F.col("user_id").cast("string")))), attribute("gen_ai.operation.name", value("stringValue", F.when(F.col("k") % 2 == 0, "chat").otherwise("execute_tool"))),
        attribute("gen_ai.tool.name", value("stringValue", F.when(F.col("k") % 2 == 1, F.col("event_type")).otherwise(""))), attribute("gen_ai.usage.input_tokens", value("intValue", F.col("k"))), attribute("input.value", value("stringValue", F.col("props"))),
    )
    span = F.struct(
        hexed(F.col("user_id") + 1, 32).alias("traceId"), hexed(F.col("event_id") + 1, 16).alias("spanId"), F.when(F.col("event_id") % 50 == 0, "bad").otherwise("").alias("parentSpanId"), F.col("event_type").alias("name"), F.lit("SPAN_KIND_CLIENT").alias("kind"),
        nanos.cast("string").alias("startTimeUnixNano"), (nanos + F.col("k") * 1_500_000).cast("string").alias("endTimeUnixNano"), attributes.alias("attributes"), F.struct(F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR").alias("code")).alias("status"),
    )
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return e.select(F.from_json(F.to_json(request), normalize.EXPORT).alias("r")).select("r.*")


@register("span_records", """SELECT format('otel_{:032x}_{:016x}', user_id + 1, event_id + 1) AS id, 'user_' || user_id AS conversation_id, CASE WHEN k % 2 = 0 THEN 'model.generation' ELSE 'tool.execution' END AS kind,
  CASE WHEN k % 2 = 1 THEN event_type END AS tool, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, k AS input_tokens, k AS input_k, k * 1.5::DOUBLE AS duration_ms, CASE WHEN k % 2 = 0 THEN 'chat' ELSE 'execute_tool' END AS operation
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) WHERE event_id % 50 <> 0""")
def _(spark, sf):
    rows = normalize.records_from_spans(normalize.spans(_exports(spark, sf)))
    at = lambda path, kind: F.get_json_object("content", path).cast(kind)
    return rows.select("id", "conversation_id", "kind", "tool", "status", at("$.usage['gen_ai.usage.input_tokens']", "long").alias("input_tokens"), at("$.input.k", "long").alias("input_k"), F.coalesce(at("$.duration_ms", "double"), F.lit(0.0)).alias("duration_ms"), F.col("tags")["gen_ai.operation.name"].alias("operation"))


@register("span_rejects", "SELECT format('{:016x}', event_id + 1) AS span_id, 'INVALID_RECORD: the parent of span ' || chr(39) || event_type || chr(39) || ' has not 8 bytes' AS reason FROM events WHERE event_id % 50 = 0")
def _(spark, sf):
    return normalize.rejected(normalize.spans(_exports(spark, sf))).select("span_id", "reason")


@register("trace_envelopes", "SELECT DISTINCT 'openai_trace_t' || user_id AS id, 'conv_openai_' || sha256('group ' || user_id) AS conversation_id, 'agent.trace' AS kind, 'flow' AS workflow FROM events WHERE user_id % 2 = 0")
def _(spark, sf):
    rows = normalize.records_from_sdk_traces(_sdk_traces(spark, sf))
    return rows.select("id", "conversation_id", "kind", F.col("tags")["workflow"].alias("workflow"))


@register("id_sanitizer", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'order_' || o_orderkey ELSE 'conv_' || sha256(o_orderpriority || ' ' || o_orderkey) END AS conversation_id FROM orders")
def _(spark, sf):
    o = adapters.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))).otherwise(F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", normalize.external_id(raw, "conv_").alias("conversation_id"))


@register("chunk_segments", f"SELECT conversation_id, ((n - 1) // {MAX_SEGMENT_RECORDS})::INT AS chunk, count(*) AS records, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'conv_' || (l_orderkey % 7) AS conversation_id, 'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY 'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey) AS n FROM lineitem) GROUP BY 1, 2")
def _(spark, sf):
    x = adapters.table(spark, sf, "lineitem")
    key = F.concat(F.lit("r"), F.concat_ws("_", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))))
    rows = x.select(F.concat(F.lit("conv_"), (F.col("l_orderkey") % 7).cast("string")).alias("conversation_id"), key.alias("id"), F.lit("k").alias("kind"), F.lit("").alias("content"))
    return normalize.chunks(rows).groupBy("conversation_id", "chunk").agg(F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("status_normalization", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status FROM events")
def _(spark, sf):
    return normalize.records_from_sdk_spans(_sdk_spans(spark, sf), _sdk_traces(spark, sf)).select(F.substring("span_id", 2, 20).cast("long").alias("event_id"), "status")


def _sdk_spans(spark: SparkSession, sf: str) -> DataFrame:
    e = adapters.table(spark, sf, "events")
    data = F.to_json(F.struct(F.lit("function").alias("type"), F.col("event_type").alias("name")))
    return e.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"), F.lit(None).cast("string").alias("parent_id"), F.col("ts").cast("string").alias("started_at"), F.when(F.col("event_type") == "error", "x").alias("error"), data.alias("span_data"))


def _sdk_traces(spark: SparkSession, sf: str) -> DataFrame:
    users = adapters.table(spark, sf, "events").select("user_id").distinct().where("user_id % 2 = 0")
    return users.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("group "), F.col("user_id").cast("string")).alias("group_id"), F.lit("flow").alias("workflow_name"))


@register("sdk_span_records", "SELECT 'openai_span_s' || event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'conv_openai_' || sha256('group ' || user_id) ELSE 't' || user_id END AS conversation_id, 'tool.execution' AS kind, event_type AS tool, CASE WHEN user_id % 2 = 0 THEN 'flow' ELSE 'OpenAI Agent workflow' END AS workflow FROM events")
def _(spark, sf):
    rows = normalize.records_from_sdk_spans(_sdk_spans(spark, sf), _sdk_traces(spark, sf))
    return rows.select("id", "conversation_id", "kind", "tool", F.col("tags")["workflow"].alias("workflow"))


# operations of a trace


# the lines of an order are steps: odd ones call a tool, even ones return its result; every second order's tool differs by line


_STEPS = """o AS (SELECT conversation_id, position, id, kind, ms, lead(id) OVER p AS next_id, lead(kind) OVER p AS next_kind, lead(ms) OVER p AS next_ms FROM lr WINDOW p AS (PARTITION BY conversation_id ORDER BY position)),
  ops AS (SELECT conversation_id, position, kind, ms, CASE WHEN kind = 'tool.call' AND next_kind = 'tool.result' THEN next_ms ELSE ms END AS end_ms, CASE WHEN kind = 'tool.call' AND next_kind = 'tool.result' THEN id || '::' || next_id ELSE id END AS id, CASE WHEN kind = 'tool.call' AND next_kind = 'tool.result' THEN 2 ELSE 1 END AS grouped_count FROM o WHERE kind = 'tool.call' OR position % 2 = 0)"""


@register("trace_operations", f"WITH {_STEPS} SELECT conversation_id, position::INT AS position, id, kind, end_ms - ms AS duration_ms, grouped_count FROM ops", ("lr",))
def _(spark, sf):
    return operations.build(adapters.records_from_lines(spark, sf)).select("conversation_id", "position", "id", "kind", "duration_ms", "grouped_count")


@register("run_map_geometry", f"WITH {_STEPS} SELECT id, round(least(99.2, l), 6) AS left_pct, round(least(100.0 - l, greatest(0.65, w)), 6) AS width_pct FROM (SELECT id, (ms - s) * 100.0::DOUBLE / greatest(1, e - s) AS l, (end_ms - ms) * 100.0::DOUBLE / greatest(1, e - s) AS w FROM (SELECT *, min(ms) OVER (PARTITION BY conversation_id) AS s, max(end_ms) OVER (PARTITION BY conversation_id) AS e FROM ops))", ("lr",))
def _(spark, sf):
    shown = operations.run_map(operations.build(adapters.records_from_lines(spark, sf)))
    return shown.select("id", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"))


_ANSWERS = """g AS (SELECT *, CASE WHEN kind = 'message.assistant' AND lag(kind) OVER p = kind THEN 0 ELSE 1 END AS new FROM cr WINDOW p AS (PARTITION BY conversation_id ORDER BY occurred_at, sequence, id)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY occurred_at, sequence, id) AS island FROM g)"""


@register("answer_operations", f"WITH {_ANSWERS} SELECT conversation_id, arg_min(id, sequence) AS id, count(*)::INT AS grouped_count, string_agg(text, '' ORDER BY sequence) AS summary FROM n GROUP BY conversation_id, island", ("cr",))
def _(spark, sf):
    return operations.build(_turns(spark, sf)).select("conversation_id", "id", "grouped_count", "summary")


@register("inspector_context", f"WITH {_STEPS}, f AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position) AS n, ends_with(id, '_2') AS hit FROM ops WHERE end_ms - ms >= 1000), x AS (SELECT *, max(hit::INT) OVER (PARTITION BY conversation_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM f) SELECT id, hit AS matched FROM x WHERE near = 1", ("lr",))
def _(spark, sf):
    return operations.inspect(adapters.records_from_lines(spark, sf), "operations", "slow", "tag.line:=2").select("id", "matched")


@register("raw_operations", "SELECT id, duration_ms, status, grouped_count FROM (SELECT id, 0::BIGINT AS duration_ms, status, 1::INT AS grouped_count FROM er)", ("er",))
def _(spark, sf):
    return operations.build(_events(spark, sf), raw=True).select("id", "duration_ms", "status", "grouped_count")


@register("density_overview", "WITH o AS (SELECT *, max(occurred_at) FILTER (kind = 'message.assistant') OVER (PARTITION BY conversation_id) AS last FROM er) SELECT id FROM o WHERE kind LIKE 'tool.%' OR kind IN ('agent.turn.started', 'message.user') OR (kind = 'message.assistant' AND occurred_at = last) OR status = 'error'", ("er",))
def _(spark, sf):
    return operations.overview(operations.build(_events(spark, sf), raw=True)).select("id")


@register("focus_slow", f"WITH {_STEPS} SELECT conversation_id, id, end_ms - ms AS duration_ms FROM ops WHERE end_ms - ms >= 1000", ("lr",))
def _(spark, sf):
    return operations.build(adapters.records_from_lines(spark, sf)).where(operations.focus("slow")).select("conversation_id", "id", "duration_ms")


@register("focus_counts", "SELECT conversation_id, count(*) AS \"all\", count(*) FILTER (kind LIKE 'tool.%') AS tools, 0::BIGINT AS reasoning, 0::BIGINT AS slow, count(*) FILTER (status = 'error') AS errors FROM er GROUP BY 1", ("er",))
def _(spark, sf):
    return operations.focus_counts(operations.build(_events(spark, sf), raw=True))


@register("evidence_bytes", "SELECT conversation_id, sum(content_size)::BIGINT AS evidence_bytes FROM er GROUP BY 1", ("er",))
def _(spark, sf):
    return operations.build(_events(spark, sf), raw=True).groupBy("conversation_id").agg(F.sum("evidence_bytes").alias("evidence_bytes"))


# presentation


@register("event_titles", "SELECT id, CASE kind WHEN 'agent.turn.started' THEN 'Started agent turn' WHEN 'message.user' THEN 'User request' WHEN 'message.assistant' THEN 'Agent response' WHEN 'tool.call' THEN 'Run Tool ' || substr(tool, 6) ELSE 'Tool ' || substr(tool, 6) || ' result' END AS title, split_part(kind, '.', 1) AS category FROM er", ("er",))
def _(spark, sf):
    none = F.lit(None).cast("string")
    return _events(spark, sf).select("id", text.event_title(F.col("kind"), F.col("tool"), none, none).alias("title"), text.event_category(F.col("kind")).alias("category"))


@register("session_titles", "SELECT DISTINCT conversation_id, 'User ' || user_id AS title, user_id::VARCHAR AS short FROM er", ("er",))
def _(spark, sf):
    return _events(spark, sf).select("conversation_id").distinct().select("conversation_id", text.title_from_id(F.col("conversation_id")).alias("title"), text.short_id(F.col("conversation_id")).alias("short"))


@register("duration_texts", """SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN (ms // 1000) || ' s' WHEN m >= 1440 THEN (m // 1440) || 'd ' || ((m % 1440) // 60) || 'h' WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm ' || ((ms % 60000) // 1000) || 's' END AS text
  FROM (SELECT *, ms // 60000 AS m FROM (SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN o_orderkey ELSE o_orderkey * 10000 END AS ms FROM orders))""")  # fmt: skip
def _(spark, sf):
    ms = F.when(F.col("o_orderkey") < 1000, F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 10000)
    return adapters.table(spark, sf, "orders").select("o_orderkey", text.format_duration(ms).alias("text"))


