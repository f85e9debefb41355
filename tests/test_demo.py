import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from chronofold.operators import query, sessions
from chronofold.sources import demo
from chronofold.streaming import ingest

NOW = datetime(2026, 1, 20, 12, tzinfo=UTC)


def test_workload_invariants(spark):
    df = demo.workload(spark, NOW).persist()
    rolled = query.conversations(df)
    counts = [r["record_count"] for r in rolled.collect()]
    assert len(counts) >= 20 and min(counts) >= 24 and max(counts) <= 58
    assert df.select("agent").distinct().count() >= 8 and df.select("id").distinct().count() == df.count()
    status = {r["conversation_id"]: (r["status"], len(r["models"])) for r in sessions.analyze(df).collect()}
    assert status["conv_demo_scenario_11"][0] == "failed" and status["conv_demo_scenario_05"] == ("complete", 1)
    daily = sessions.daily_activity(rolled, F.lit("2026-01-20").cast("date")).collect()
    assert all(r["sessions"] > 0 for r in daily) and len(daily) == 14
    assert sorted(map(tuple, df.select("id", "occurred_at").collect())) == sorted(map(tuple, demo.workload(spark, NOW).select("id", "occurred_at").collect()))
    df.unpersist()


def test_session_export(spark):
    df = demo.workload(spark, NOW, 2)
    got = {r["conversation_id"]: json.loads(r["value"]) for r in sessions.export(df, query.conversations(df)).collect()}
    one = got["conv_demo_scenario_00"]
    assert len(got) == 2 and one["conversation"]["record_count"] == len(one["timeline"]) == 24 and one["analysis"]["status"] == "complete"
    assert [e["sequence"] for e in one["timeline"]] == list(range(24))


def test_delivery_stats(spark, tmp_path):
    stats = ingest.DeliveryStats()
    spark.streams.addListener(stats)
    try:
        demo.workload(spark, NOW, 1).coalesce(1).write.json(f"file://{tmp_path}/in")
        ingest.ingest(ingest.read(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
        for _ in range(100):
            if stats.rows:
                break
            __import__("time").sleep(0.1)
        assert stats.rows == 24 and stats.failed == 0
    finally:
        spark.streams.removeListener(stats)
