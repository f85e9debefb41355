import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from chronofold.llm import language_id, mixing

public_tokenizers = pytest.importorskip("public_tokenizers")

SYLLABLES = {"en": "th ing er ould ness wh".split(), "de": "sch ung ein keit pf ü".split()}
ITEM = "a train leaves the station with 12 people and 5 more get on at noon how many people ride"


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 6)))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 120), ("en", "de")[i % 2], f"s{i % 4}") for i in range(120)]
    rows += [(200, None, "en", "s0"), (201, "12 34", "en", "s0"), (202, "", "de", "s1")]
    rows += [(210 + k, rows[k][1], "en", "s1") for k in range(5)]
    edited = rows[10][1].split()
    edited[60] = "edited"
    rows += [(220, " ".join(edited), "en", "s2")]
    rows += [(230, f"{prose(rng, 'en', 50)}. {ITEM}", "en", "s3"), (231, f"{prose(rng, 'en', 50)}. {ITEM.replace('12', '40').replace('5', '9')}", "en", "s3")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, all_ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    found = stages["language_id"](spark, docs, sf_dir)
    assert found.columns == columns and {r["doc_id"] for r in found.collect()} == all_ids - {200, 201, 202}
    found = stages["near_duplicates"](spark, docs, sf_dir)
    assert found.columns == columns
    # the empty texts (null counts as one) are copies of each other
    assert {r["doc_id"] for r in found.collect()} == all_ids - {210, 211, 212, 213, 214, 220, 202}
    found = stages["decontamination"](spark, docs, sf_dir)
    assert found.columns == columns and {r["doc_id"] for r in found.collect()} == all_ids - {230, 231}
    found = stages["mixing"](spark, docs, sf_dir)
    want = {r["doc_id"] for r in mixing.report(docs, keep=cp.KEEP).collect() if r["kept"]}
    assert found.columns == columns and {r["doc_id"] for r in found.collect()} == want and 0 < len(want) < len(all_ids)


def test_run_is_the_stages_one_after_another(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for r in sorted(docs.collect()):
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).collect()) == want and len(want) > 20


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_language_split_is_the_operators(spark):
    assert [language_id.crc_of(i) == 2 for i in range(9)] == [r[0] for r in spark.range(9).select(language_id.held_out(__import__("pyspark").sql.functions.col("id"))).collect()]


def test_stages_take_nulls_repeats_and_any_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")
    clashing = ["score", "lang_pred", "mix_tokens", "uid", "h", "row_uid", "leaked_uid", "item_id", "whole", "doc_column_1"]
    odd = spark.createDataFrame([(None, None, None, None), (None, ITEM, "en", "s0"), (None, ITEM.replace("12", "13"), "en", "s0"), (300, ITEM, "en", "s0"), (300, "thing would other " * 20, "en", "s0")], docs.schema)
    rows = docs.unionByName(odd).unionByName(odd)
    plain = {name: stage(spark, rows, sf_dir) for name, stage in cp.STAGES}
    for name, stage in cp.STAGES:
        more = rows
        for k, c in enumerate(clashing):
            more = more.withColumn(c, cp.F.lit(k))
        got = stage(spark, more, sf_dir)
        want = plain[name]
        assert got.columns == (want.columns if name == "token_output" else more.columns), name
        ids = ["doc_id", "start"] if name == "token_output" else ["doc_id", "text"]
        key = lambda r: str([r[c] for c in ids])
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())), name
    left = [(r["doc_id"], r["text"]) for r in plain["decontamination"].collect()]
    # of rows that share an id only those go that leak
    assert sum(d == 300 for d, _ in left) == 2 and sum(d is None for d, _ in left) == 2 and all(t != ITEM for _, t in left)
