import json
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pytest

from chronofold.functions import jsontext as js
from chronofold.operators import integrity
from chronofold.schema import HistoryError
from chronofold.sources import store as st

NOW = datetime(2026, 1, 2, 3, 4, 5, 600, tzinfo=UTC)


def event(n=1, **kw):
    return st.Event(**({"conversation_id": "conv_a", "kind": "message.user", "id": f"rec_{n}", "content": {"text": f"hello {n}"}} | kw))


def code(f, *args, **kw):
    with pytest.raises(HistoryError) as e:
        f(*args, **kw)
    return e.value.code


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{ "z": 1, "text": "<agent>", "a": [true, null] }', '{"a":[true,null],"text":"<agent>","z":1}'),
        ('{"numbers":[333333333.33333329,1E30,4.50,2e-3,1e-27],"string":"€"}', '{"numbers":[333333333.3333333,1e+30,4.5,0.002,1e-27],"string":"€"}'),
        ("", "null"), ("[0, -0.0, 1e21, 1e20, 123456789012345680000, 0.000001, 1e-7, -1.5, 9007199254740993]", "[0,0,1e+21,100000000000000000000,123456789012345680000,0.000001,1e-7,-1.5,9007199254740992]"),
        ('{"\\u20ac":1,"\\r":2,"1":3,"\\ud83d\\ude00":4,"\\ufb33":5}', '{"\\r":2,"1":3,"€":1,"😀":4,"\ufb33":5}'),
    ],
)
def test_canonical_json(text, want):
    assert js.canonical(text) == want


def test_canonical_json_rejects_and_digests():
    assert code(js.canonical, "{} {}") == "INVALID_JSON" and code(js.canonical, "[1") == "INVALID_JSON"
    assert js.sha256('{"model":"fixture","text":"hello"}') == "5df089daabec13aadc1dab95f3c9d8f98184a3012b9821a590754747c88650c8"
    assert st.conversation_hash("conv_fixture") == "65c224fe86b48495393b0f3a96bb65f3129e80b98abef01786a44d05fa874c8c"


def test_search_text_leaves_out_opaque_fields():
    assert js.flatten('{"b": [1, true, null, "x"], "a": {"encrypted_content": "no", "Signature": {"y": 1}, "k": 2.5}}') == "a \nk \n2.5 \nb \n1 \ntrue \nx"
    assert js.flatten("not json") == "" and js.flatten(None) == ""


def test_append_reads_back_and_verifies(spark, tmp_path):
    s = st.open_store(f"file://{tmp_path}")
    segment = st.append(s, [event(1, occurred_at=NOW, tags={"env": "x"}), event(2, sequence=7)], "seg_1", NOW)
    st.append_one(s, event(3, conversation_id="conv_b"), now=NOW)
    key = st.segment_key("conv_a", "seg_1")
    assert js.canonical(s.get(key).decode()) == s.get(key).decode() and json.loads(s.get(key)) == segment
    rows = {r["id"]: r for r in st.records(st.segments(spark, f"file://{tmp_path}")).collect()}
    assert set(rows) == {"rec_1", "rec_2", "rec_3"} and rows["rec_2"]["sequence"] == 7 and rows["rec_1"]["tags"] == {"env": "x"} and json.loads(rows["rec_1"]["content"]) == {"text": "hello 1"}
    assert rows["rec_1"]["occurred_at"] == NOW.replace(tzinfo=None)
    v = integrity.verify(spark, f"file://{tmp_path}").first()
    assert (v["segments"], v["records"], v["blobs"], v["orphans"], v["issues"], v["ok"]) == (2, 3, 0, 0, 0, True)


def test_retry_returns_the_first_and_another_content_conflicts(tmp_path):
    s = st.LocalStore(str(tmp_path))
    first = st.append_one(s, event(1), now=NOW)
    assert st.append_one(s, event(1), now=NOW + timedelta(hours=1)) == first
    assert code(st.append_one, s, event(1, content={"n": 2}), now=NOW) == "IDEMPOTENCY_CONFLICT"
    assert code(st.append_one, s, event(1, occurred_at=NOW + timedelta(1)), now=NOW) == "IDEMPOTENCY_CONFLICT"


def test_rejects(tmp_path):
    s = st.LocalStore(str(tmp_path))
    assert code(st.append, s, [event(1), event(2, conversation_id="other")]) == "INVALID_BATCH"
    assert code(st.append, s, [event(1), event(1)]) == "INVALID_SEGMENT"
    assert code(st.append, s, []) == "INVALID_BATCH"
    assert code(st.append, s, [event(1, kind="")]) == "INVALID_RECORD"
    assert code(st.append, s, [event(1, id="!x")]) == "INVALID_RECORD" and code(st.append, s, [event(1, tags={"k": "v" * 1025})]) == "INVALID_RECORD"
    assert code(st.append, s, [event(1, content="x" * (10 * 1024 * 1024))]) == "CONTENT_TOO_LARGE"
    for key in ("", "a//b", "../x", "a\\b", "a/./b"):
        assert code(st.checked_key, key) == "INVALID_REQUEST"
    assert s.keys("history") == [] and code(s.get, "none") == "NOT_FOUND" and code(st.open_store, "s3://x") == "INVALID_REQUEST"


def test_one_of_many_writers_creates(tmp_path):
    s = st.LocalStore(str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda _: s.put_if_absent("a/b.json", b"same"), range(16)))
    assert sum(made) == 1 and s.keys("a") == ["a/b.json"]
    assert code(s.put_if_absent, "a/b.json", b"other") == "IDEMPOTENCY_CONFLICT"


def test_blobs_orphans_and_damage(spark, tmp_path):
    s, root = st.LocalStore(str(tmp_path)), f"file://{tmp_path}"
    st.append(s, [event(1, content={"output": "large"})], "seg_1", NOW, inline_bytes=8)
    st.append(s, [event(2)], "seg_2", NOW)
    s.put_if_absent(st.blob_key("ab" * 32), b"orphan")
    v = integrity.verify(spark, root).first()
    assert (v["segments"], v["blobs"], v["orphans"], v["issues"], v["ok"]) == (2, 2, 1, 0, True)
    rows = st.records(st.segments(spark, root))
    from chronofold.operators import query

    texts = {r["id"]: r["content"] for r in query.timeline(rows, "conv_a", st.blobs(spark, root)).collect()}
    assert json.loads(texts["rec_1"]) == {"output": "large"}
    blob = next(k for k in s.keys("history/v2/blobs") if "abab" not in k)
    (tmp_path / blob).write_bytes(b'{"output":"LARGE"}')
    segment = tmp_path / st.segment_key("conv_a", "seg_2")
    segment.write_bytes(segment.read_bytes().replace(b"hello 2", b"hellO 2"))
    found = {r["issue"].split(":")[0] for r in integrity.issues(spark, root).collect()}
    assert found == {"BLOB_CORRUPT", "SEGMENT_CORRUPT"}
    # reads fail too: nothing damaged is passed over
    with pytest.raises(Exception, match="SEGMENT_CORRUPT"):
        st.records(st.segments(spark, root)).collect()
    sound = st.records(st.segments(spark, root).where("issue IS NULL"))
    with pytest.raises(Exception, match="BLOB_CORRUPT"):
        query.timeline(sound, "conv_a", st.blobs(spark, root)).collect()
    (tmp_path / blob).unlink()
    with pytest.raises(Exception, match="BLOB_MISSING"):
        query.timeline(sound, "conv_a", st.blobs(spark, root)).collect()
    assert {r["issue"].split(":")[0] for r in integrity.issues(spark, root).collect()} == {"BLOB_MISSING", "SEGMENT_CORRUPT"}


def test_id_in_two_conversations_is_an_issue(spark, tmp_path):
    s = st.LocalStore(str(tmp_path))
    st.append_one(s, event(1), now=NOW)
    st.append_one(s, event(1, conversation_id="conv_b"), now=NOW)
    issues = integrity.issues(spark, f"file://{tmp_path}").collect()
    assert len(issues) == 1 and issues[0]["issue"].startswith("DUPLICATE_RECORD: rec_1 also in ")


def test_segment_checks():
    raw = '{"schema_version": "chronofold.segment.v9"}'
    assert st.segment_issue("k", raw) == "SCHEMA_UNSUPPORTED" and st.segment_issue("k", "{") == "SEGMENT_CORRUPT: JSONDecodeError"
    assert st.segment_issue("k", "[]").startswith("SEGMENT_CORRUPT")


def test_unknown_fields_and_other_forms_are_damage(tmp_path):
    s = st.LocalStore(str(tmp_path))
    segment, key = st.append(s, [event(1)], "seg_1", NOW), st.segment_key("conv_a", "seg_1")
    assert st.segment_issue(key, js.encode(segment)) is None
    assert st.segment_issue(key, json.dumps(segment, indent=1)) == "SEGMENT_CORRUPT: not canonical"
    more = segment | {"more": 1}
    assert st.segment_issue(key, js.encode(more)) == "SEGMENT_CORRUPT: fields"
    record = segment["entries"][0]["record"] | {"more": 1}
    record["record_sha256"] = st.digest_without(record, "record_sha256")
    more = segment | {"entries": [segment["entries"][0] | {"record": record}]}
    more["segment_sha256"] = st.digest_without(more, "segment_sha256")
    assert st.segment_issue(key, js.encode(more)) == "RECORD_CORRUPT: fields of rec_1"


def test_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    df = st.read_jsonl(spark, str(tmp_path / "m.jsonl"), "a int")
    assert sorted(r["a"] for r in df.collect()) == [1, 2]
    st.write_json(df, f"file://{tmp_path}/out")
    assert st.read_jsonl(spark, f"file://{tmp_path}/out", "a int").count() == 2


def test_batch_files_are_strict():
    name, events = st.read_batch('{"id": "seg_1", "records": [{"conversation_id": "c", "kind": "k", "content": null, "occurred_at": "2026-01-01T00:00:00Z", "tags": {"a": "b"}}]}')
    assert name == "seg_1" and events[0].content is None and events[0].occurred_at == datetime(2026, 1, 1, tzinfo=UTC)
    for bad in ("{", "[]", '{"records": []} {}', '{"records": [], "more": 1}', '{"records": [{"conversation_id": "c", "kind": "k"}]}', '{"records": [{"conversation_id": "c", "kind": "k", "content": 1, "x": 2}]}'):
        assert code(st.read_batch, bad) == "INVALID_JSON"


def test_any_value_becomes_json():
    assert js.coerced({1: (1, {"a"}), "b": None, "t": NOW, "n": {"x": iter([2.5])}, "y": b"z"}) == {"1": [1, ["a"]], "b": None, "t": str(NOW), "n": {"x": [2.5]}, "y": "b'z'"}
