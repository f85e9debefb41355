from chronofold.plans import registry


def test_repeated_ids_of_the_whole_table(spark, tmp_path):
    rows = [(5, 1, 10), (5, 2, 11), (1999, 1, 1), (2000, 1, 7), (2000, 2, 8), (2000, 3, 8), (900_000, 1, 3), (900_000, 12, 3), (900_001, 1, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.QUERIES["duplicate_ids"](spark, str(tmp_path)).collect()}
    said = lambda id, key, before: (key, f"DUPLICATE_RECORD: r{id} also in {before}")
    assert got == {said(5, "s02", "s01"), said(2000, "s02", "s01"), said(2000, "s03", "s02"), said(900_000, "s12", "s01")}
