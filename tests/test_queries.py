from datetime import UTC, datetime

import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions import text
from chronofold.operators import dsl, operations, query, search, sessions
from chronofold.operators.query import RecordFilter
from chronofold.schema import ROW, HistoryError

T0 = datetime(2026, 1, 1, tzinfo=UTC).timestamp()


def rows(spark, *records):
    """Records from dicts; ``at`` is in seconds from the start."""
    out = []
    for n, r in enumerate(records):
        content = r.get("content", "{}")
        base = {"id": f"rec_{n}", "conversation_id": "conv_a", "kind": "event", "tags": {}, "content": content, "content_size": len(content)}
        r = {k: v for k, v in r.items() if k != "at"} | {"occurred_at": datetime.fromtimestamp(T0 + r.get("at", n), UTC)}
        row = base | r
        out.append(tuple(row.get(f.name) for f in ROW))
    return spark.createDataFrame(out, ROW)


def test_filters_timeline_and_rollup(spark):
    df = rows(
        spark,
        {"id": "rec_1", "kind": "user.message", "at": 0, "agent": "researcher"}, {"id": "rec_2", "kind": "model.response", "at": 60, "agent": "researcher", "tags": {"env": "test"}},
        {"id": "rec_3", "conversation_id": "conv_b", "kind": "user.message", "at": 60},
    )
    until = "2026-01-01 00:01:00"
    assert [r["id"] for r in query.find(df, RecordFilter(conversation_id="conv_a", kind="model.response", tags={"env": "test"}, until=until)).collect()] == ["rec_2"]
    assert [r["id"] for r in query.timeline(df, "conv_a").collect()] == ["rec_1", "rec_2"]
    rolled = query.newest(query.conversations(df)).collect()
    assert [(r["conversation_id"], r["record_count"], r["agents"]) for r in rolled] == [("conv_a", 2, ["researcher"]), ("conv_b", 1, [])]
    with pytest.raises(HistoryError, match="NOT_FOUND"):
        query.timeline(df, "conv_x")
    with pytest.raises(HistoryError, match="NOT_FOUND"):
        query.get(df, "rec_x")
    with pytest.raises(HistoryError, match="DUPLICATE_RECORD"):
        query.get(df.unionByName(df), "rec_1")
    with pytest.raises(HistoryError, match="DUPLICATE_RECORD"):
        query.listing(df.unionByName(df))
    with pytest.raises(HistoryError):
        query.find(df, RecordFilter(), 1001)


def test_order_uses_sequence_then_id(spark):
    df = rows(spark, {"id": "b", "at": 0, "sequence": 2}, {"id": "c", "at": 0, "sequence": 1}, {"id": "a", "at": 0}, {"id": "d", "at": -1})
    assert [r["id"] for r in query.timeline(df, "conv_a").collect()] == ["d", "c", "b", "a"]


def test_deltas_merge_like_a_batch_however_often_they_come(spark):
    df = rows(spark, *({"conversation_id": f"conv_{n % 3}", "agent": f"a{n % 2}", "kind": f"k{n % 5}", "at": n * 7 % 11} for n in range(40)))
    whole = {r["conversation_id"]: tuple(r) for r in query.conversations(df).collect()}
    parts = query.deltas(df, F.substring("id", -1, 1))
    merged = query.merge(parts.unionByName(parts).orderBy(F.rand(3)))
    assert {r["conversation_id"]: tuple(r) for r in merged.select(*query.conversations(df).columns).collect()} == whole


def corpus(spark):
    texts = ["durable agent execution", "checkpoint recovery of durable agent", "gardening checkpoints", "unrelated"]
    df = rows(spark, *({"id": f"d{n}", "conversation_id": "conv_s", "tags": {"env": "prod" if n == 0 else "test"}, "agent": "x" if n < 2 else None} for n, _ in enumerate(texts)))
    text = F.element_at(F.array(*map(F.lit, texts)), F.substring("id", 2, 1).cast("int") + 1)
    return df.withColumn("search_text", F.concat(F.lit("text \n"), text))


def test_search_words_phrases_prefixes_and_filters(spark, tmp_path):
    index = search.build(corpus(spark))
    hits = search.search(index, '"durable agent"', RecordFilter(conversation_id="conv_s", tags={"env": "prod"})).collect()
    assert [(r["id"], r["total"]) for r in hits] == [("d0", 1)] and hits[0]["score"] > 0
    assert {r["id"] for r in search.search(index, "check*").collect()} == {"d1", "d2"}
    assert {r["id"] for r in search.search(index, "durable check*").collect()} == {"d1"}
    assert search.search(index, "absent").count() == 0 and search.search(index, "zz*").count() == 0
    assert search.search(index).count() == 4
    assert [r["id"] for r in search.search(index, '"agent durable"').collect()] == []
    stored = search.store(corpus(spark), f"file://{tmp_path}/index")
    a, b = ({r["id"]: round(r["score"], 9) for r in search.search(i, 'durable "agent"').collect()} for i in (index, stored))
    assert a == b and len(a) == 2


@pytest.mark.parametrize("bad", ['"open', "a*", '""', "foo-bar", "a*b"])
def test_search_syntax_errors(bad):
    with pytest.raises(HistoryError, match="INVALID_SEARCH"):
        search.parse(bad)


def test_search_limits(spark):
    index = search.build(corpus(spark))
    for bad in (lambda: search.search(index, "x", limit=1001), lambda: search.search(index, "x", RecordFilter(since="2026-02-01", until="2026-01-01"))):
        with pytest.raises(HistoryError, match="INVALID_SEARCH"):
            bad()


def turn(status=None, usage="{}", at=5):
    return {"kind": "agent.turn.completed", "status": status, "content": f'{{"usage": {usage}}}', "at": at}


def test_session_indicators(spark):
    df = rows(
        spark,
        {"kind": "agent.turn.started", "trace_id": "t1", "at": 0}, {"kind": "message.user", "content": '{"text": ""}', "at": 1}, {"kind": "message.user", "content": '{"text": "Do it"}', "at": 2},
        {"kind": "model.request", "content": '{"model": "m1"}', "at": 3}, {"kind": "tool.call", "tool": "x", "at": 4}, {"kind": "tool.result", "status": "failed", "at": 4},
        turn("completed", '{"input_tokens": 1200, "output_tokens": 300, "output_tokens_details": {"reasoning_tokens": 240}, "cached_input_tokens": 800, "cache_read_input_tokens": "no"}'),
        {"conversation_id": "conv_b", "kind": "model.reasoning", "status": "running"}, {"conversation_id": "conv_c", "kind": "x", "status": "Cancelled", "content": '{"type": "Thinking"}'},
        {"conversation_id": "conv_d", **turn("failed")},
    )
    got = {r["conversation_id"]: r for r in sessions.analyze(df).collect()}
    a = got["conv_a"]
    assert (a["status"], a["duration_ms"], a["turns"], a["tool_calls"], a["model_calls"]) == ("complete", 5000, 1, 1, 1)
    assert (a["input_tokens"], a["output_tokens"], a["reasoning_tokens"], a["cache_read_tokens"]) == (1200, 300, 240, 800)
    assert (a["prompt"], a["models"], a["traces"]) == ("Do it", ["m1"], ["t1"])
    assert (got["conv_b"]["status"], got["conv_b"]["reasoning_events"]) == ("running", 1)
    assert (got["conv_c"]["status"], got["conv_c"]["reasoning_events"], got["conv_c"]["prompt"]) == ("failed", 1, None)
    assert got["conv_d"]["status"] == "failed"


def test_review_blocks(spark):
    kinds = ["agent.turn.started", "message.user", "tool.call", "tool.result", "message.assistant", "agent.turn.completed"]
    df = rows(spark, *({"kind": k, "tool": "read_file" if k.startswith("tool") else None, "at": 2 * n} for n, k in enumerate(kinds)))
    got = sessions.review_blocks(df).orderBy("block").collect()
    assert [r["type"] for r in got] == ["activity", "message", "activity", "message", "activity"]
    assert (got[2]["tool_calls"], got[2]["tool_results"], got[2]["duration_ms"], got[2]["tools"]) == (1, 1, 2000, ["read_file"])
    assert [r["is_latest_assistant"] for r in got] == [False, False, False, True, False] and got[0]["only_turns"]


def test_review_counts_reasoning_apart_from_model_events(spark):
    df = rows(spark, {"kind": "model.request"}, {"kind": "model.reasoning"}, {"kind": "model.response", "status": "error"})
    r = sessions.review_blocks(df).first()
    assert (r["reasoning_events"], r["model_events"], r["errors"]) == (1, 2, 1)


def test_coalesced_answers(spark):
    df = rows(spark, {"kind": "message.assistant", "content": '{"text": "Hello "}', "trace_id": "t"}, {"kind": "message.assistant", "content": '{"text": "world"}', "trace_id": "t"}, {"kind": "message.assistant", "content": '{"text": "!"}'})
    assert [(r["id"], r["grouped_count"], r["text"]) for r in sessions.coalesced(df).orderBy("island").collect()] == [("rec_0", 2, "Hello world"), ("rec_2", 1, "!")]


def test_context(spark):
    df = rows(spark, *({"kind": "hit" if n in (0, 3) else "other"} for n in range(6)))
    at = lambda mode: sorted(int(r["id"][4:]) for r in sessions.with_context(df, F.col("kind") == "hit", mode).collect())
    assert at("context") == [0, 1, 2, 3, 4] and at("matches") == [0, 3] and at("full") == list(range(6))


def test_daily_activity(spark):
    # a conversation counts on the day it began; totals are of all conversations, days of the window
    df = rows(spark, {"conversation_id": "c1", "agent": "a", "at": 86_400}, {"conversation_id": "c1", "agent": "c", "at": 2 * 86_400}, {"conversation_id": "c2", "agent": "a", "at": 2 * 86_400}, {"conversation_id": "c3", "agent": "b", "at": 2 * 86_400}, {"conversation_id": "old", "agent": "z", "at": -9 * 86_400})
    rolled = query.conversations(df)
    got = sessions.daily_activity(rolled, F.lit("2026-01-03").cast("date"), 3).orderBy("day").collect()
    assert [(r["sessions"], r["agents"], r["events"]) for r in got] == [(0, 0, 0), (1, 2, 2), (2, 2, 2)]
    t = sessions.activity_totals(rolled, F.lit("2026-01-03").cast("date"), 3).first()
    assert (t["sessions"], t["events"], t["active_days"], t["max_events"], t["agents"]) == (4, 5, 2, 2, 4)


def test_stored_index_grows_and_tells_its_state(spark, tmp_path):
    path, docs = f"file://{tmp_path}/index", corpus(spark)
    for buckets in (16, 3):
        index = search.store(docs, path, buckets)
        assert index.buckets == buckets
        a, b = ({r["id"]: round(r["score"], 9) for r in search.search(i, "durable agent").collect()} for i in (search.build(docs), index))
        assert a == b and a
        assert {r["id"] for r in search.search(index, '"durable agent"').collect()} == {r["id"] for r in search.search(search.build(docs), '"durable agent"').collect()}
    first = docs.limit(1).withColumn("id", F.lit("later")).withColumn("search_text", F.lit("a zebra appears"))
    state = search.status(index, docs.unionByName(first)).first()
    assert (state["indexed_records"], state["missing"], state["current"]) == (4, 1, False)
    assert search.search(index, "zebra").count() == 0
    grown = search.add(first.unionByName(docs), path)
    assert grown.documents == 5 and [r["id"] for r in search.search(grown, "zebra").collect()] == ["later"]
    whole = search.build(docs.unionByName(first))
    a, b = ({r["id"]: round(r["score"], 9) for r in search.search(i, "durable").collect()} for i in (whole, grown))
    assert a == b
    said = search.respond(grown, "zebra")
    assert (said["total"], said["indexed_records"], len(said["hits"])) == (1, 5, 1) and said["took_ms"] >= 0 and said["index_updated_at"] is not None
    assert search.respond(grown, "nothing")["total"] == 0


def test_times_are_compared_as_times_and_stars_as_sent(spark):
    index = search.build(corpus(spark))
    assert search.search(index, "", RecordFilter(since="2024-1-2", until="2024-01-10")).count() == 0
    with pytest.raises(HistoryError):
        search.search(index, "", RecordFilter(since="2024-01-10", until="2024-1-2"))
    assert search.parse("*foo foo**") == [search.Clause(("foo",)), search.Clause(("foo",), prefix=True)]


def test_operations_pair_calls_with_results(spark):
    df = rows(
        spark,
        {"kind": "tool.call", "tool": "query_logs", "content": '{"input": {"query": "find it"}}', "at": 1}, {"kind": "agent.note", "at": 2},
        {"kind": "tool.result", "tool": "query_logs", "content": '{"content": [1, 2]}', "at": 4, "status": "ok"}, {"kind": "tool.call", "tool": "exec", "at": 5}, {"kind": "tool.result", "tool": "other", "at": 6, "status": "failed"},
        {"kind": "message.assistant", "content": '{"text": "a"}', "at": 7}, {"kind": "message.assistant", "content": '{"text": "b"}', "at": 8},
    )
    got = operations.build(df).orderBy("position").collect()
    assert [r["id"] for r in got] == ["rec_0::rec_2", "rec_1", "rec_3::rec_4", "rec_5"]
    assert (got[0]["title"], got[0]["duration_ms"], got[0]["grouped_count"], got[0]["summary"], got[0]["status"]) == ("Query Logs", 3000, 2, "find it · 2 results returned", "ok")
    assert (got[2]["title"], got[2]["status"], got[3]["grouped_count"], got[3]["duration_ms"]) == ("Run command", "error", 2, 0)
    # joined answers read as one
    assert got[3]["summary"] == "ab" and got[3]["entry_ids"] == ["rec_5"]
    assert operations.build(df, raw=True).count() == 7
    counts = operations.focus_counts(operations.build(df)).first()
    assert (counts["all"], counts["tools"], counts["slow"], counts["errors"]) == (4, 2, 2, 1)


def paired(kinds, tools, traces, calls):
    pairing = operations.Pairing()
    return [pairing.place(*x) for x in zip(kinds, tools, traces, calls)]


def test_greedy_pairing_rules():
    # an id pairs over other tools; the next call of the same tool ends the search
    assert paired(["tool.call", "tool.call", "tool.result", "tool.result"], ["a", "b", "b", "a"], [None] * 4, [None] * 4) == [0, 1, 1, 0]
    assert paired(["tool.call", "x", "tool.call", "tool.result"], ["a", None, "a", "a"], [None] * 4, [None] * 4) == [0, 1, 2, 2]
    assert paired(["tool.call", "x", "tool.result"], ["a", None, "b"], ["t", "t", "u"], ["c1", None, "c1"]) == [0, 1, 0]
    assert paired(["message.assistant", "message.assistant", "x", "message.assistant"], [None] * 4, ["t", "t", "t", "t"], [None] * 4) == [0, 0, 2, 3]


def slow_pairing(kinds, tools, traces, calls):
    """Call by call, each looks ahead for its result."""
    out, used = list(range(len(kinds))), set()
    for i, kind in enumerate(kinds):
        if kind != "tool.call":
            continue
        for j in range(i + 1, len(kinds)):
            if j in used:
                continue
            if kinds[j] == "tool.call" and tools[j] == tools[i]:
                break
            if kinds[j] == "tool.result" and (calls[i] and calls[i] == calls[j] or (tools[i], traces[i]) == (tools[j], traces[j]) or j == i + 1):
                used.add(j)
                out[j] = i
                break
    return out


def test_pairing_in_one_pass_equals_looking_ahead():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 14)
        case = [[rng.choice(x) for _ in range(n)] for x in (["tool.call", "tool.call", "tool.result", "tool.result", "x"], ["a", "b", "c", None], ["t", "u"], ["i", "j", None, None])]
        assert paired(*case) == slow_pairing(*case), case


def test_inspector_shows_matches_in_context(spark):
    df = rows(spark, *({"kind": "tool.call" if k % 2 else "message.user", "tool": f"t{k}", "at": k} for k in range(10)))
    ids = lambda **kw: [r["position"] for r in operations.inspect(df, **kw).orderBy("position").collect()]
    assert ids() == list(range(10)) and ids(focus_on="tools") == [1, 3, 5, 7, 9] and ids(density="overview", focus_on="tools") == [1, 3, 5, 7, 9]
    assert ids(focus_on="tools", text="tool:=t5") == [3, 5, 7] and ids(focus_on="tools", text="tool:=t5", context="matches") == [5] and ids(focus_on="tools", text="tool:=t5", context="full") == [1, 3, 5, 7, 9]
    assert ids(density="records", text="tool:=t4", context="context") == [3, 4, 5] and ids(focus_on="tools", text="tool:=t4") == []


def test_overview(spark):
    df = rows(spark, *({"kind": k} for k in ("agent.turn.started", "model.request", "model.response", "message.assistant", "x", "message.assistant", "agent.turn.completed")))
    assert [r["kind"] for r in operations.overview(operations.build(df)).orderBy("position").collect()] == ["agent.turn.started", "message.assistant", "agent.turn.completed"]


def test_previews(spark):
    cases = [
        ("message.user", None, '{"text": "hi"}', "hi"), ("tool.call", None, '{"name": "grep"}', "grep called"), ("tool.call", "ls", "{}", "ls called"), ("tool.result", None, '{"content": [1]}', "1 result returned"),
        ("tool.result", None, '{"error": {"message": "bad"}}', "bad"), ("model.request", None, '{"model": "m", "provider": "p"}', "m · p"), ("model.response", None, "{}", "Model response"),
        ("x", None, '{"prompt_name": "n"}', "n"), ("x", None, '"plain"', "plain"), ("x", None, "null", "No content"), ("x", None, "{}", "Structured event"), ("x", None, '{"a": 1, "encrypted_content": "z", "b": "c"}', "a: 1 · b: c"),
    ]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, kind string, tool string, content string, want string")
    for r in df.withColumn("got", operations.preview(F.col("kind"), F.col("tool"), F.col("content"))).collect():
        assert r["got"] == r["want"], r


def test_filter_language_parser():
    terms, errors = dsl.parse('agent:"research agent" size:>=2kb -status:error durable')
    assert [(t.field, t.operator, t.value, t.negated) for t in terms] == [("agent", "contains", "research agent", False), ("size", ">=", "2kb", False), ("status", "contains", "error", True), ("", "contains", "durable", False)] and not errors
    terms, errors = dsl.parse("wat:value tool: x")
    assert len(errors) == 2 and [t.value for t in terms] == ["x"]
    assert len(dsl.parse('"open')[1]) == 1
    assert [dsl.number(*x) for x in (("2kb", "size"), ("1.5m", "offset"), ("3K", "tokens"), ("x", "size"), ("1.2.3", "size"))] == [2048, 90_000, 3000, None, None]


def test_filter_language(spark):
    df = rows(
        spark,
        {"kind": "tool.call", "tool": "web_search", "content": '{"q": "durable", "usage": {"input_tokens": 900, "output_tokens": 200}, "model": "m-1"}', "content_size": 3000, "at": 4, "tags": {"prompt": "landing page"}, "trace_id": "t1", "status": "running"},
        {"kind": "message.user", "content": '{"text": "Durable things"}', "at": 0, "status": "error", "agent": "Bob"},
    )
    find = lambda q: sorted(r["id"] for r in dsl.matching(df, q).collect())
    assert find("kind:tool tool:web offset:>=3s size:>=2kb tag.prompt:land") == ["rec_0"]
    assert find("durable -status:error has:trace") == ["rec_0"] and find("durable") == ["rec_0", "rec_1"]
    assert find("status:complete") == [] and find("status:run|err") == ["rec_0", "rec_1"] and find("kind:*call") == ["rec_0"] and find("kind:call*") == []
    assert find("tokens:>1k model:m-*") == ["rec_0"] and find("agent:=bob") == ["rec_1"] and find("-agent:bob") == ["rec_0"] and find("has:tags") == ["rec_0"] and find("has:what") == []


def test_run_map_and_latest(spark):
    df = rows(spark, {"at": 0, "kind": "tool.call", "tool": "a"}, {"at": 50, "kind": "tool.result", "tool": "a"}, {"at": 60, "kind": "message.assistant"}, {"at": 100, "kind": "x"})
    got = operations.run_map(operations.build(df)).orderBy("position").collect()
    assert [(r["left_pct"], r["width_pct"]) for r in got] == [(0.0, 50.0), (60.0, 0.65), (99.2, 0.0)]
    assert [r["is_latest"] for r in query.latest(df, "message.assistant").orderBy("occurred_at").collect()] == [False, False, True, False]


def test_prompt_titles(spark):
    one = lambda t: spark.createDataFrame([(t,)], "p string").select(text.prompt_title(F.col("p")).alias("x")).first()["x"]
    assert one("Fix it. Then look for the other things that are broken here") == "Fix it. Then look for the other things that are broken here"
    assert one("Look for   the things\nthat are broken here! Then fix them") == "Look for the things that are broken here!"
    assert one("x" * 300) == "x" * 104 + "…" and one("x" * 104) == "x" * 104


def test_observed_values_of_models_and_tags_and_reasoning(spark):
    df = rows(spark, {"kind": "model.request", "content": '{"model": "m1"}', "tags": {"env": "x"}}, {"kind": "model.reasoning", "content": '{"thinking": "so"}'}, {"kind": "x", "content": "[]"})
    got = {(r["field"], r["value"]) for r in query.observed_values(df).collect()}
    assert ("model", "m1") in got and ("tag.env", "x") in got
    assert [r[0] for r in df.orderBy("id").select(sessions.reasoning_text(F.col("content"))).collect()] == [None, "so", None]
