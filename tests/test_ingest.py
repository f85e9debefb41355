import json

import pytest
from pyspark.sql import functions as F

from chronofold.functions import text
from chronofold.operators import normalize, query
from chronofold.streaming import ingest

TRACE, MODEL, TOOL = "01" * 16, "01" * 8, "02" * 8


def attribute(key, value):
    kind = {str: "stringValue", bool: "boolValue", int: "intValue", float: "doubleValue"}[type(value)]
    return {"key": key, "value": {kind: str(value) if kind == "intValue" else value}}


def span(name, span_id=MODEL, trace=TRACE, parent="", status=None, start=1_767_225_600_000_000_000, end=1_767_225_601_500_000_000, **attributes):
    return {"traceId": trace, "spanId": span_id, "parentSpanId": parent, "name": name, "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": str(start), "endTimeUnixNano": str(end), "attributes": [attribute(k.replace("__", "."), v) for k, v in attributes.items()], **({"status": status} if status else {})}


def export(tmp_path, *spans):
    body = {"resourceSpans": [{"schemaUrl": "u", "resource": {"attributes": [attribute("service.name", "svc"), attribute("session.id", "from resource")]}, "scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": list(spans)}]}]}
    (tmp_path / "export.json").write_text(json.dumps(body))
    return str(tmp_path / "export.json")


def test_spans_become_records(spark, tmp_path):
    path = export(
        tmp_path, span("chat", session__id="conv_research", gen_ai__operation__name="chat", gen_ai__request__model="m-1", gen_ai__usage__input_tokens=21, input__value='[{"role": "user"}]'),
        span("execute", TOOL, parent=MODEL, status={"code": "STATUS_CODE_ERROR"}, session__id="conv_research", gen_ai__operation__name="execute_tool", gen_ai__tool__name="browser.search"),
        span("bad", "01"),
    )
    spans = normalize.read_exports(spark, path)
    assert [r["reason"].split(":")[0] for r in normalize.rejected(spans).collect()] == ["INVALID_RECORD"]
    got = {r["span_id"]: r for r in normalize.records_from_spans(spans).collect()}
    model, tool = got[f"span_{MODEL}"], got[f"span_{TOOL}"]
    assert (model["id"], model["conversation_id"], model["kind"], model["agent"], model["status"], model["parent_id"]) == (f"otel_{TRACE}_{MODEL}", "conv_research", "model.generation", "svc", "ok", None)
    assert (tool["kind"], tool["tool"], tool["status"], tool["parent_id"], tool["trace_id"]) == ("tool.execution", "browser.search", "error", f"span_{MODEL}", f"trace_{TRACE}")
    content = json.loads(model["content"])
    assert content["model"] == "m-1" and content["usage"] == {"gen_ai.usage.input_tokens": 21} and content["duration_ms"] == 1500 and content["span_kind"] == "CLIENT" and content["input"] == [{"role": "user"}]
    assert model["tags"] == {"chronofold.source": "otlp", "service.name": "svc", "gen_ai.operation.name": "chat", "gen_ai.request.model": "m-1", "otel.scope.name": "lib"}
    assert model["occurred_at"].isoformat() == "2026-01-01T00:00:00"


def test_values_keep_their_types_and_nothing_is_lost(spark, tmp_path):
    wire = [
        {"key": "list", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "a"}, {"arrayValue": {"values": [{"boolValue": True}]}}]}}},
        {"key": "map", "value": {"kvlistValue": {"values": [{"key": "x", "value": {"doubleValue": 1.5}}, {"key": "y", "value": {"kvlistValue": {"values": []}}}]}}},
        {"key": "n", "value": {"intValue": 7}}, {"key": "f", "value": {"doubleValue": 1.0}}, {"key": "b", "value": {"bytesValue": "AQI="}}, {"key": "", "value": {"intValue": 1}}, {"key": "n", "value": {"intValue": "8"}},
        {"key": "gen_ai.request.model", "value": {"doubleValue": 2500000.0}}, {"key": "output.value", "value": {"stringValue": "not json {"}}, {"key": "input.value", "value": {"stringValue": '{"q": [1, 2.5]}'}},
    ]
    one = span("s") | {"attributes": wire, "traceState": "k=v", "flags": 257, "droppedAttributesCount": 2, "droppedEventsCount": 3, "startTimeUnixNano": "1767225600000000001"}
    one |= {"events": [{"name": "e", "timeUnixNano": "1767225600123456789", "attributes": [attribute("i", 4)], "droppedAttributesCount": 1}], "links": [{"traceId": "AB" * 16, "spanId": "CD" * 8, "traceState": "t", "flags": 1, "attributes": [attribute("l", True)]}]}
    body = {"resourceSpans": [{"resource": {"attributes": [attribute("r", 2)], "droppedAttributesCount": 5}, "scopeSpans": [{"schemaUrl": "su", "scope": {"name": "lib", "attributes": [attribute("sc", 1.25)]}, "spans": [one]}]}]}
    (tmp_path / "e.json").write_text(json.dumps(body))
    row = normalize.records_from_spans(normalize.read_exports(spark, str(tmp_path / "e.json"))).first()
    c = json.loads(row["content"])
    assert c["attributes"] == {"list": [1, "a", [True]], "map": {"x": 1.5, "y": {}}, "n": 8, "f": 1, "b": "AQI=", "gen_ai.request.model": 2500000, "output.value": "not json {", "input.value": '{"q": [1, 2.5]}'}
    assert c["input"] == {"q": [1, 2.5]} and c["output"] == "not json {" and c["model"] == "2.5e+06" and row["tags"]["gen_ai.request.model"] == "2.5e+06"
    assert (c["trace_state"], c["flags"], c["dropped_attributes"], c["dropped_events"], c["start_time"]) == ("k=v", 257, 2, 3, "2026-01-01T00:00:00.000000001Z")
    assert c["events"] == [{"name": "e", "time": "2026-01-01T00:00:00.123456789Z", "attributes": {"i": 4}, "dropped_attributes": 1}]
    assert c["links"] == [{"trace_id": "ab" * 16, "span_id": "cd" * 8, "trace_state": "t", "flags": 1, "attributes": {"l": True}}]
    assert c["scope"] == {"name": "lib", "schema_url": "su", "attributes": {"sc": 1.25}} and c["resource"] == {"attributes": {"r": 2}, "dropped_attributes": 5}
    assert [normalize.scalar_text(v) for v in (1.0, 0.1, 123456.0, 1234567.0, 1e-5, -2.5, True, 3, [1], None, 0.0)] == ["1", "0.1", "123456", "1.234567e+06", "1e-05", "-2.5", "true", "3", "", "", "0"]


def test_a_stream_of_exports_keeps_its_good_spans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good, bad = span("chat", session__id="c1"), span("bad", "01")
    for name, spans_ in (("a.json", [good, bad]), ("b.json", [good, span("tool", TOOL, parent="zz", session__id="c1"), span("tool", "03" * 8, session__id="c1")])):
        (tmp_path / "in" / name).write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans_}]}]}))
    out = f"file://{tmp_path}/out"
    ingest.ingest_exports(ingest.read_exports(spark, f"file://{tmp_path}/in", 1), out, f"file://{tmp_path}/state").awaitTermination()
    assert {r["conversation_id"]: r["record_count"] for r in ingest.conversations(spark, out).collect()} == {"c1": 2}
    assert sorted(r["reason"].split("'")[1] for r in spark.read.parquet(f"{out}/rejects").collect()) == ["bad", "tool"]


def test_conversation_ids(spark, tmp_path):
    path = export(tmp_path, span("a", session__id="bad id"), span("b", TOOL))
    got = {r["span_id"]: r["conversation_id"] for r in normalize.records_from_spans(normalize.read_exports(spark, path)).collect()}
    import hashlib

    assert got == {f"span_{MODEL}": "conv_otel_" + hashlib.sha256(b"bad id").hexdigest(), f"span_{TOOL}": "conv_otel_" + hashlib.sha256(b"from resource").hexdigest()}


KINDS = [
    ({"chronofold.kind": "own.kind", "gen_ai.operation.name": "chat"}, "x", "own.kind"), ({"gen_ai.operation.name": "Embeddings"}, "x", "model.embedding"), ({"gen_ai.operation.name": "invoke_agent"}, "x", "agent.invoke"),
    ({"gen_ai.operation.name": "create_agent"}, "x", "agent.create"), ({"gen_ai.operation.name": "invoke_workflow"}, "x", "workflow.invoke"), ({"gen_ai.operation.name": "upsert_memory"}, "x", "memory.upsert_memory"),
    ({"gen_ai.operation.name": "delete_memory_store"}, "x", "memory.delete_memory_store"), ({"gen_ai.operation.name": "other"}, "my tool", "tool.execution"), ({"openinference.span.kind": "evaluator"}, "x", "evaluation"),
    ({"langsmith.span.kind": "Retriever"}, "x", "retrieval"), ({"ai.operationId": "ai.toolCall"}, "x", "tool.execution"), ({"ai.operationId": "ai.generateText.doGenerate"}, "x", "model.generation"),
    ({"ai.operationId": "ai.streamText"}, "x", "agent.turn"), ({"ai.operationId": "ai.embedMany"}, "x", "embedding.batch"), ({}, "LLM call", "model.generation"), ({}, "AgentRun", "agent.invoke"), ({}, "x", "trace.span"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(n, a, name, want) for n, (a, name, want) in enumerate(KINDS)], "n int, a map<string,string>, name string, want string")
    for r in df.withColumn("got", normalize.kind_of(F.col("name"), F.col("a"))).collect():
        assert r["got"] == r["want"], r


def test_hooks_and_blocks(spark):
    rows = spark.createDataFrame(
        [("PreToolUse", "s1", "u1", "Bash", None, None, "{}"), ("PostToolUseFailure", "s 2", None, "Bash", "a1", "helper", "{}"), ("New", "s1", None, None, None, None, "{}")],
        "hook_event_name string, session_id string, tool_use_id string, tool_name string, agent_id string, agent_type string, payload string",
    )
    got = normalize.records_from_hooks(rows, default_agent="main").collect()
    assert [(r["kind"], r["status"], r["agent"], r["span_id"]) for r in got] == [("tool.call", "running", "main", "u1"), ("tool.result", "error", "helper", "a1"), ("agent.hook", None, "main", None)]
    assert got[1]["trace_id"] is None and got[1]["conversation_id"].startswith("conv_claude_")
    for missing in ("", None):
        with pytest.raises(Exception, match="session_id"):
            normalize.records_from_hooks(spark.createDataFrame([("Stop", missing, None, None, None, None, "{}")], rows.schema)).collect()
    blocks = spark.createDataFrame([("text", False), ("server_tool_use", False), ("web_search_tool_result", True), ("thinking", False)], "t string, f boolean")
    assert [tuple(r["b"]) for r in blocks.select(normalize.block_kind(F.col("t"), F.col("f")).alias("b")).collect()] == [("message.assistant", None, "completed"), ("tool.call", "web_search", "started"), ("tool.result", "web_search", "failed"), ("anthropic.thinking", None, None)]


def test_scope(spark):
    df = spark.createDataFrame([(None, {"a": "1"}), ("x", None)], "agent string, tags map<string,string>")
    got = normalize.with_scope(df, {"agent": "default"}, {"a": "0", "b": "2"}).collect()
    assert [(r["agent"], r["tags"]) for r in got] == [("default", {"b": "2", "a": "1"}), ("x", {"a": "0", "b": "2"})]


def test_chunks_are_stable_and_bounded(spark):
    df = spark.range(2500).select(F.format_string("r%05d", "id").alias("id"), F.lit("c").alias("conversation_id"), F.lit("k").alias("kind"), F.lit("").alias("content"))
    a, b = (sorted((r["segment_id"], r["n"]) for r in normalize.chunks(x).groupBy("segment_id").agg(F.count("*").alias("n")).collect()) for x in (df, df.orderBy(F.rand(1))))
    assert a == b and sorted(n for _, n in a) == [500, 1000, 1000]


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def record(n, conversation="c1", **kw):
    return {"id": f"r{n}", "conversation_id": conversation, "kind": "k", "occurred_at": f"2026-01-01T00:{n % 60:02d}:00Z", "agent": "a", "tags": {}, "content": "{}", "content_size": 2, **kw}


def run(spark, tmp_path, **kw):
    ingest.ingest(ingest.read(spark, f"file://{tmp_path}/in", 1), f"file://{tmp_path}/out", f"file://{tmp_path}/state", **kw).awaitTermination()
    return {r["conversation_id"]: (r["record_count"], r["agents"], r["kinds"]) for r in ingest.conversations(spark, f"file://{tmp_path}/out").collect()}


def test_stream_equals_batch_and_repeats_count_once(spark, tmp_path):
    rows = [record(n, f"c{n % 3}", agent=f"a{n % 2}") for n in range(30)]
    write(tmp_path / "in", "a.json", rows[:20])
    write(tmp_path / "in", "b.json", rows[15:])
    got = run(spark, tmp_path)
    batch = query.conversations(spark.read.schema(ingest.ROW).json(f"file://{tmp_path}/in").dropDuplicates(["id"]))
    assert got == {r["conversation_id"]: (r["record_count"], r["agents"], r["kinds"]) for r in batch.collect()}
    assert ingest.records(spark, f"file://{tmp_path}/out").count() == 30
    # a later file joins the compacted roll-up; the files read are not read again
    ingest.compact(spark, f"file://{tmp_path}/out")
    assert ingest.newest_snapshot(spark, f"file://{tmp_path}/out")[0] == 0 and not list((tmp_path / "out" / "deltas").glob("batch=*"))
    write(tmp_path / "in", "c.json", [record(40, "c1"), record(41, "new")])
    later = run(spark, tmp_path)
    assert later["new"][0] == 1 and later["c1"][0] == got["c1"][0] + 1 and later["c0"] == got["c0"]


def test_late_and_repeated_records_across_batches(spark, tmp_path):
    write(tmp_path / "in", "a.json", [record(1, occurred_at="2026-01-10T00:00:00Z"), record(2)])
    run(spark, tmp_path)
    write(tmp_path / "in", "b.json", [record(3, "late", occurred_at="2026-01-01T00:00:00Z"), record(1, "again"), record(4)])
    write(tmp_path / "in", "c.json", [record(5, "late", occurred_at="2020-01-01T00:00:00Z"), record(3, "late")])
    got = run(spark, tmp_path)
    assert {k: v[0] for k, v in got.items()} == {"c1": 3, "late": 2}
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # snapshot on snapshot
        ingest.compact(spark, out)
    assert {r["conversation_id"]: r["record_count"] for r in ingest.conversations(spark, out).collect()} == {"c1": 3, "late": 2}
    assert ingest.newest_snapshot(spark, out)[0] == 1
    # a version that was not written to its end does not count
    broken = tmp_path / "out" / "snapshots" / "version=2"
    broken.mkdir()
    assert ingest.newest_snapshot(spark, out)[0] == 1
    assert {r["conversation_id"]: r["record_count"] for r in ingest.rebuild(spark, out).collect()} == {"c1": 3, "late": 2}


def test_hook_changes_and_drops(spark, tmp_path):
    write(tmp_path / "in", "a.json", [record(1), record(2, kind="secret")])
    got = run(spark, tmp_path, before_send=lambda df: df.where("kind <> 'secret'").withColumn("agent", F.lit("masked")))
    assert got == {"c1": (1, ["masked"], ["k"])}


@pytest.mark.parametrize("build", [ingest.rolling_counts, ingest.sessions])
def test_windows_run(spark, tmp_path, build):
    write(tmp_path / "in", "a.json", [record(n) for n in range(40)])
    query_ = build(ingest.read(spark, f"file://{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName(f"w_{build.__name__}").trigger(availableNow=True).start()
    query_.awaitTermination()
    assert query_.exception() is None


def test_presentation(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    verbs = {"github_search": "Search GitHub", "web_search": "Search web", "code_search": "Search Code", "read_file": "Read File", "query-logs": "Query Logs", "exec": "Run command", "deploy_it": "Run Deploy It"}
    assert {t: one(text.tool_verb(F.lit(t))) for t in verbs} == verbs
    durations = {-1: "—", 12: "12 ms", 1500: "1.5 s", 12_400: "12 s", 61_000: "1m 1s", 3_720_000: "1h 2m", 93_600_000: "1d 2h"}
    assert {d: one(text.format_duration(F.lit(d))) for d in durations} == durations
    assert one(text.title_from_id(F.lit("conv_fix_the-bug_20260101T101010Z_0123456789ab"))) == "Fix The Bug" and one(text.title_from_id(F.lit("conv_"))) == "Untitled session"
    assert one(text.short_id(F.lit("rec_0123456789abc"))) == "012345678"
    assert one(text.snippet(F.lit("x" * 200 + " Needle " + "y" * 400), F.lit("needle"))).startswith("…") and one(text.snippet(F.lit("short"), F.lit("none"))) == "short"
    assert text.quote_value("a b") == '"a b"' and text.quote_value("ab") == "ab" and text.token_list("Foo-bar 12é") == ["foo", "bar", "12é"]
