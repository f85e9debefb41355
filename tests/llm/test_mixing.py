import duckdb
import pytest

from chronofold.llm import mixing


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_x int")


def some():
    out = []
    for i in range(400):
        source = "hot" if i % 3 else f"s{i % 5}"
        text = None if i == 7 else " ".join(["word"] * (i % 90 + 1)) + (" | cell" if i % 4 == 0 else "")
        out.append((i, text, ("en", "fr", None)[i % 3 if i % 2 else 0], source if i % 50 else None, 1))
    return out


def test_weights_sum_to_one(spark):
    shares = {"hot": 0.3, "s0": 0.2, "s1": 0.2, "s2": 0.1, "s3": 0.1, "s4": 0.1, "": 0.0}
    targets = {"source": spark.createDataFrame(list(shares.items()), "value string, share double")}
    raked = mixing.rake(mixing.cells(mixing.featured(documents(spark, some()))), targets, sweeps=9).collect()
    assert sum(r["weight"] for r in raked) == pytest.approx(1, abs=1e-6)


def test_given_margin_is_met(spark):
    rows = [(i, "a b c d", "en", "ab"[i % 4 == 0], 0) for i in range(400)]
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")}
    raked = {r["source"]: r for r in mixing.rake(mixing.cells(mixing.featured(documents(spark, rows))), targets).collect()}
    assert raked["a"]["weight"] == pytest.approx(0.5) and raked["b"]["weight"] == pytest.approx(0.5)
    kept = mixing.mix(documents(spark, rows), targets, keep=0.4).where("mix_kept").groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in kept}
    assert abs(counts["a"] - 80) < 30 and abs(counts["b"] - 80) < 30


def test_the_budget_is_spent_and_margins_hold_where_tokens_suffice(spark):
    # the small sources cannot give a third of half the tokens each; what they lack goes to the others
    rows = [(i, "a b c d", "en", "hot" if i % 10 else f"s{i % 20}", 0) for i in range(800)]
    targets = {"source": spark.createDataFrame([("hot", 0.2), ("s0", 0.4), ("s10", 0.4)], "value string, share double")}
    fitted = {r["source"]: r for r in mixing.probabilities(mixing.rake(mixing.cells(mixing.featured(documents(spark, rows))), targets, keep=0.5), 0.5).collect()}
    assert fitted["s0"]["probability"] == fitted["s10"]["probability"] == pytest.approx(1)
    assert sum(r["probability"] * r["tokens"] for r in fitted.values()) == pytest.approx(0.5 * 3200)
    # nothing is clipped in this one, so that every margin is met
    mild = {"source": spark.createDataFrame([("hot", 0.8), ("s0", 0.1), ("s10", 0.1)], "value string, share double")}
    fitted = {r["source"]: r for r in mixing.probabilities(mixing.rake(mixing.cells(mixing.featured(documents(spark, rows))), mild, keep=0.4), 0.4).collect()}
    assert [fitted[s]["probability"] * fitted[s]["tokens"] / (0.4 * 3200) for s in ("hot", "s0", "s10")] == pytest.approx([0.8, 0.1, 0.1])


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.9, 1])
def test_expected_tokens_are_the_budget(spark, keep):
    got = mixing.report(documents(spark, some()), keep=keep).collect()
    total = sum(r["n_tokens"] for r in got)
    assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(keep * total, rel=1e-6)
    assert all(0 <= r["probability"] <= 1 for r in got)


def test_report_equals_its_sql(spark):
    docs = documents(spark, some())
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted((int(a), b, c, d, e, round(f, 6), g) for a, b, c, d, e, f, g in con.execute(mixing.report_sql()).fetchall())
    got = sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), r[6]) for r in mixing.report(docs).collect())
    assert got == want


def test_empty_and_repeated(spark):
    assert mixing.report(documents(spark, [])).count() == 0
    rows = documents(spark, [(None, None, None, None, 1)] * 3 + [(1, "", "en", "s", 2)])
    assert mixing.report(rows).count() == 4
    with pytest.raises(ValueError):
        mixing.mix(rows, keep=0)
