"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells of (source, language, topic). The tokens of each cell are summed, with
partial sums before the shuffle, and raked: sweep by sweep the cells' weights are scaled so that each
margin (sources, then languages, then topics) has its target share. No cell gets more than all its tokens:
in every step the cells of a margin that would pass that bound take it, and the others share what is left,
so that a margin is met as long as its tokens suffice; the last step does the same for the whole budget. Cells
are as many as combinations of margin values, not as documents; their table is the only thing that meets in one
task. A document is then kept with the probability budget x weight / tokens of its cell, at most 1, against a
uniform number that is a hash of its doc_id: the sample is the same wherever and however often it is drawn.

Targets are data frames of (value, share). Where none is given, the target is the tempered share
tokens^alpha of each value, which lifts rare values and holds down a source with a third of the rows.

Tokens are the words between ASCII white space of the whole text. The topic is a parameter; the
default reads the form of the text: table, code, list, note (under 300 characters) or prose.

Defined results: null text has no tokens, its document is kept with its cell's probability. Null
source or language count as the value ''. A cell without tokens has the probability 0. A null doc_id draws as the text 'null'. Values that a
given target does not name get the share 0. Repeated rows draw alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import stored

MARGINS = ("source", "lang", "topic")
#: Cells are broadcast to the documents up to this count (some 100 bytes each), joined by shuffle beyond.
BROADCAST_CELLS = 50_000
#: Sweeps in one plan: the table of cells is written and read in between, as plans may not get too deep.
SWEEPS_A_PLAN = 3
#: Sweeps end early once no weight changes by more than this part of the whole.
SETTLED = 1e-13
#: More than any weight.
UNBOUNDED = 1e9


def token_count(text: Column) -> Column:
    """Words between ASCII white space, over the whole text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def form_topic(text: Column) -> Column:
    """The form of a text as its topic."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("{")) | F.contains(text, F.lit("();")), "code")
        .when(F.contains(text, F.lit("\n- ")) | F.contains(text, F.lit("\n* ")), "list")
        .when(F.length(text) < 300, "note")
        .otherwise("prose")
    )


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id: 52 bits of it."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(2**52))


def featured(documents: DataFrame, topic: Column | None = None) -> DataFrame:
    """documents with the columns mix_source, mix_lang, mix_topic and mix_tokens."""
    return documents.withColumns(
        {
            "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "mix_topic": F.coalesce(form_topic(F.col("text")) if topic is None else topic, F.lit("")),
            "mix_tokens": token_count(F.col("text")),
        }
    )


def cells(rows: DataFrame) -> DataFrame:
    """Tokens and documents of each cell of featured()."""
    return rows.groupBy(*(F.col(f"mix_{m}").alias(m) for m in MARGINS)).agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def _scaled(cells_: DataFrame, of: list[str], target: Column) -> DataFrame:
    """weight scaled to the target's sum within each group, no weight beyond its cell's most.

    With the cells in order of most / weight, a cell takes its most if the group would still be short once all up to
    it have theirs and the others are scaled as far as it is.
    """
    ordered = Window.partitionBy(*(of or [F.lit(1)])).orderBy(F.asc_nulls_last("ratio"), *MARGINS)
    so_far, whole = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = cells_.withColumn("ratio", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")))
    reached = F.sum("most").over(so_far) + F.col("ratio") * F.greatest(F.lit(0.0), F.sum("weight").over(whole) - F.sum("weight").over(so_far))
    rows = rows.withColumn("full", F.coalesce(reached <= target, F.lit(False)))
    left = target - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)
    rows = rows.withColumns({"left": left, "free": free})
    scaled = F.when(F.col("full"), F.col("most")).when((F.col("weight") > 0) & (F.col("free") > 0), F.least("most", F.col("weight") * F.greatest(F.lit(0.0), F.col("left")) / F.col("free"))).otherwise(0.0)
    return rows.withColumn("weight", scaled).drop("ratio", "full", "left", "free")


def rake(summed: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = 0.7, sweeps: int = 12, keep: float | None = None) -> DataFrame:
    """The cells with the column weight: shares of the raked table, 1 in all, none beyond the cell's share of tokens / keep (if given).

    One task holds the cells (they are aggregated), so that no sweep shuffles.
    """
    targets = targets or {}
    one = summed.coalesce(1)
    everything = Window.partitionBy(F.lit(1))
    for m in MARGINS:
        if m in targets:
            named = targets[m].select(F.col("value").alias(m), F.col("share").cast("double").alias(f"target_{m}"))
            one = one.join(F.broadcast(named), m, "left").withColumn(f"target_{m}", F.coalesce(f"target_{m}", F.lit(0.0)))
        else:
            of_value = F.pow(F.sum("tokens").over(Window.partitionBy(m)).cast("double"), F.lit(alpha))
            one = one.withColumn("part", of_value / F.count(F.lit(1)).over(Window.partitionBy(m)))
            one = one.withColumn(f"target_{m}", F.when(F.sum("part").over(everything) > 0, of_value / F.sum("part").over(everything)).otherwise(0.0)).drop("part")
    total = F.sum("tokens").over(everything)
    one = one.withColumns({"weight": F.when(total > 0, F.col("tokens") / total).otherwise(0.0), "most": F.when(total > 0, F.col("tokens") / (F.lit(keep) * total)).otherwise(0.0) if keep else F.lit(UNBOUNDED)})
    for sweep in range(0, sweeps, SWEEPS_A_PLAN):
        one = one.withColumn("before", F.col("weight"))
        for _ in range(min(SWEEPS_A_PLAN, sweeps - sweep)):
            for m in MARGINS:
                one = _scaled(one, [m], F.col(f"target_{m}"))
        one = stored(one, f"sweep{sweep}")
        if (one.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0) <= SETTLED:
            break
        one = one.coalesce(1)
    return _scaled(one.coalesce(1), [], F.lit(1.0)).select(*MARGINS, "tokens", "n_docs", "weight")


def probabilities(raked: DataFrame, keep: float) -> DataFrame:
    """The cells with the probability that spends keep x all tokens by the raked weights."""
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    wanted = F.lit(keep) * total * F.col("weight")
    return raked.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), wanted / F.col("tokens"))).otherwise(0.0))


def mix(documents: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, keep: float = 0.5, alpha: float = 0.7, sweeps: int = 12) -> DataFrame:
    """documents with mix_* columns, mix_probability and mix_kept (see the module)."""
    if not 0 < keep <= 1 or sweeps < 1:
        raise ValueError("keep must be in (0, 1] and sweeps positive")
    return sampled(featured(documents, topic), targets, keep, alpha, sweeps)


def sampled(rows: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = 0.5, alpha: float = 0.7, sweeps: int = 12) -> DataFrame:
    """featured() rows with mix_probability and mix_kept."""
    fitted = probabilities(rake(cells(rows), targets, alpha, sweeps, keep), keep)
    fitted = fitted.select(*(F.col(m).alias(f"mix_{m}") for m in MARGINS), F.round("probability", 9).alias("mix_probability"))
    # checked size: the table of cells is materialised, counted, and broadcast only below the bound
    fitted = stored(fitted, "cells")
    if fitted.count() <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    joined = rows.join(fitted, [f"mix_{m}" for m in MARGINS], "left")
    return joined.withColumn("mix_kept", uniform(F.col("doc_id")) < F.col("mix_probability"))


def report(documents: DataFrame, topic: Column | None = None, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every document; the texts are read once."""
    rows = featured(documents.select("doc_id", "text", "lang", "source"), topic).drop("text", "lang", "source")
    rows = sampled(stored(rows, "features"), **options)
    return rows.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


def report_sql(table: str = "documents", keep: float = 0.5, alpha: float = 0.7, sweeps: int = 12) -> str:
    """The rows of report() in DuckDB's SQL, without given targets."""
    steps = [
        rf"""f AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
          CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '{{') OR contains(t, '();') THEN 'code'
               WHEN contains(t, chr(10) || '- ') OR contains(t, chr(10) || '* ') THEN 'list'
               WHEN length(t) < 300 THEN 'note' ELSE 'prose' END AS topic,
          len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
          FROM (SELECT *, coalesce(text, '') AS t FROM {table}))""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM f GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"t_{m} AS (SELECT {m}, p / sum(p) OVER () AS share FROM (SELECT {m}, pow(sum(tokens), {alpha}) AS p FROM c GROUP BY {m}))")
    steps.append(f"w AS (SELECT *, CASE WHEN sum(tokens) OVER () > 0 THEN tokens / sum(tokens) OVER () ELSE 0 END AS w, CASE WHEN sum(tokens) OVER () > 0 THEN tokens / ({keep} * sum(tokens) OVER ()) ELSE 0 END AS u FROM c)")
    before = "w"
    for i, m in [*((i, m) for i in range(sweeps) for m in MARGINS), (sweeps, "")]:
        to, share = (f"t_{m} t WHERE b.{m} = t.{m}", "t.share") if m else ("(SELECT 1) WHERE true", "1.0")
        of = f"PARTITION BY {m}" if m else ""
        steps.append(f"""w{i}_{m} AS MATERIALIZED (SELECT source, lang, topic, tokens, u, CASE WHEN full_ THEN u WHEN w > 0 AND free > 0 THEN least(u, w * greatest(0, share - taken) / free) ELSE 0 END AS w FROM (
  SELECT *, sum(CASE WHEN full_ THEN u ELSE 0 END) OVER ({of}) AS taken, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({of}) AS free FROM (
    SELECT *, coalesce(u_so_far + r * greatest(0, w_all - w_so_far) <= share, false) AS full_ FROM (
      SELECT *, sum(u) OVER ({of} ORDER BY r NULLS LAST, source, lang, topic ROWS UNBOUNDED PRECEDING) AS u_so_far, sum(w) OVER ({of} ORDER BY r NULLS LAST, source, lang, topic ROWS UNBOUNDED PRECEDING) AS w_so_far, sum(w) OVER ({of}) AS w_all FROM (
        SELECT b.source, b.lang, b.topic, b.tokens, b.u, b.w, {share} AS share, CASE WHEN b.w > 0 THEN b.u / b.w END AS r FROM {before} b, {to})))))""")
        before = f"w{i}_{m}"
    steps.append(f"p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1.0, {keep} * sum(tokens) OVER () * w / tokens) ELSE 0 END, 9) AS probability FROM {before})")
    return (
        "WITH " + ",\n".join(steps) + """
SELECT f.doc_id, f.source, f.lang, f.topic, f.n_tokens, p.probability,
  ('0x' || substr(md5(coalesce(f.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < p.probability AS kept
FROM f JOIN p ON f.source = p.source AND f.lang = p.lang AND f.topic = p.topic"""
    )
