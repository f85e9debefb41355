"""From raw documents to token files: five stages, each one operator of chronofold.llm.

Each stage takes (spark, docs, sf_dir) and returns a data frame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, language_id, mixing, simhash, token_codec
from chronofold.llm.common import row_uid, scratch, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Below this probability of the best language a text counts as none of them.
LEAST_SCORE = 0.3
#: Leaking rows (two numbers each) that are broadcast to the documents; more of them are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Share of the tokens that the mix spends.
KEEP = 0.5


def _with_key(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with their columns renamed, so that none meets a name of ours, and the new names with the old ones."""
    own = {f"doc_column_{k}": c for k, c in enumerate(docs.columns)}
    return docs.toDF(*own), own


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without letters, and without a likely language, go.

    Null and empty texts have no letter and go. Ties of languages go to the first by name, which decides no
    document's stay. Repeated rows are judged alike. An empty table gives no rows. Extra columns are kept.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.learn(rows.where("NOT held_out").select("doc_id", "text", "lang"))
    renamed, own = _with_key(docs)
    text = next(k for k, c in own.items() if c == "text")
    types = {k: renamed.schema[k].dataType.simpleString() for k in own if k != text}
    judged = language_id.predict(renamed.withColumnRenamed(text, "text"), model, types | {"text": "string"})
    kept = judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("text" if k == text else k).alias(c) for k, c in own.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id.

    SimHash links those within 4 bits that meet by their Golay keys and whose shingles agree; a prefix filter completes
    the classes to a similarity of 0.8. Null and empty texts are copies of each other. Of equal rows one stays, a null doc_id only where its class has no
    other. An empty table gives no rows. Extra columns are kept.
    """
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or re-parameterised.

    Null and empty texts leak nothing and stay. Rows that share a doc_id, or have none, are judged each by its own
    text; equal rows go or stay together. Without documents there are no rows, without items all stay. Extra columns
    are kept.
    """
    renamed, own = _with_key(docs)
    doc_id, text = (next(k for k, c in own.items() if c == name) for name in ("doc_id", "text"))
    found = decontaminate.leaking_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = stored(found.select(F.col("doc_id").alias("leaked_id"), F.col("uid").alias("leaked_uid")).distinct(), "leaked")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    same = renamed[doc_id].cast("long").eqNullSafe(F.col("leaked_id")) & (row_uid(doc_id, text) == F.col("leaked_uid"))
    return renamed.join(found, same, "left_anti").toDF(*own.values())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked target weights of sources, languages and topics.

    Null texts have no tokens, null sources and languages are values of their own. Rows that share a doc_id draw alike,
    and those without one draw as one. An empty table gives no rows. Extra columns are kept.
    """
    renamed, own = _with_key(docs)
    named = renamed.withColumns({c: F.col(k) for k, c in own.items() if c in ("doc_id", "text", "lang", "source")})
    return mixing.mix(named, keep=KEEP).where("mix_kept").select(*(F.col(k).alias(c) for k, c in own.items()))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and what they hold: doc_id, start, n_tokens, ids_crc32.

    A null text is the end id alone, a null doc_id comes first, rows that share a doc_id are all written, in order of
    their texts' hash. An empty table gives no rows. Extra columns are ignored.
    """
    import public_tokenizers

    return token_codec.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Fingerprints, a fitted model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
