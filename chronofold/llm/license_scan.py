"""Licence notices by diagonal voting, in DataFrame functions only.

A document's words (lower-cased in ASCII; letters, digits and everything beyond ASCII) give rolling word
grams, joined by their hash, and checked by their text, to the grams of the templates (grams that begin with
none of the templates' first words are left out before the join, as they can meet nothing). Each match votes
for a template at the diagonal (place in the document less place in the template). Votes are summed by
document, template and diagonal, with partial sums; diagonals at most ``slack`` apart, as inserted or
missing words make them, are merged, and a merged run is a licence span if its grams cover at least
``coverage`` of the template's.

Grams have three words, but two where the first word is the first of a two-word phrase; documents and
templates follow the same rule. A phrase (template of base labels) has one gram, so that each vote for it
is a place where its words stand consecutively.

Templates are a fixed list (a few hundred grams), broadcast; templates have at most 63 grams.

Defined results: null and empty texts have no words, no spans and the score 0; first_word and last_word
are null without places. Rows that repeat are reported one by one with equal results. A null doc_id is
carried along. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import lower_ascii, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices as their licences word them, with the method's labels.
NOTICES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Creative Commons Attribution NonCommercial", "cc-by-nc"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("No part of this publication may be reproduced, distributed, or transmitted in any form or by any means", "proprietary"),
)
TWO = tuple(p.split()[0] for p, _ in PHRASES if len(p.split()) == 2)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_grams(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, is a phrase, its grams, place, gram)."""
    out = []
    for n, (text, label, base) in enumerate([*((*p, True) for p in phrases), *((*p, False) for p in notices)]):
        words = re.findall(WORD, text.lower())
        grams = [(i, " ".join(words[i : i + (2 if w in TWO else 3)])) for i, w in enumerate(words) if i + (2 if w in TWO else 3) <= len(words)]
        if not grams or len(grams) > 63 or base and len(grams) > 1:
            raise ValueError(f"a template has 1 to 63 grams, a phrase has 1: {text}")
        out += [(n, label, base, len(grams), i, g) for i, g in grams]
    return out


def placed(documents: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """uid (of the row), doc_id, n_words and grams (place, gram) of each row; the texts are read once.

    Of the rolling grams those stay that begin with a word with which a template's gram begins: no other can meet one.
    """
    heads = sorted({gram.split(" ")[0] for *_, gram in template_grams(phrases, notices)})
    words = documents.select(F.col("doc_id"), words_of(F.col("text")).alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(heads))
    word = lambda i: F.get("words", i)
    # a missing word is no part of a gram, as concat_ws leaves nulls out
    gram = lambda i: F.when(word(i).isin(*TWO), F.concat_ws(" ", word(i), word(i + 1))).otherwise(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)))
    grams = F.when(F.size("words") > 0, F.transform(places, lambda i: F.struct(i.alias("place"), gram(i).alias("gram"))))
    return stored(words.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.size("words").cast("long").alias("n_words"), grams.alias("grams")), "places")


def votes(rows: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """uid, template, label, base, size, diagonal, mask (of the template's grams), low and high (places) of each diagonal of placed() rows."""
    spark: SparkSession = rows.sparkSession
    grams = spark.createDataFrame(template_grams(phrases, notices), "template int, label string, base boolean, size int, at int, theirs string").withColumn("h", F.xxhash64("theirs"))
    own = rows.select("uid", F.inline("grams")).withColumn("h", F.xxhash64("gram"))
    met = own.join(F.broadcast(grams), "h").where(F.col("gram") == F.col("theirs"))
    met = met.withColumn("diagonal", F.col("place") - F.col("at"))
    voted = met.groupBy("uid", "template", "label", "base", "size", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"), F.min("place").alias("low"), F.max("place").alias("high"))
    return stored(voted, "votes")


def spans(voted: DataFrame, coverage: float = 0.7, slack: int = 4) -> DataFrame:
    """uid, label, first and last word, coverage of each verified notice: neighbouring diagonals of a template merged.

    Of a run that is too long for one notice (repeats, fragments) its best part stands: diagonals within ``slack``.
    """
    of = Window.partitionBy("uid", "template").orderBy("diagonal")
    part = of.rangeBetween(0, slack)
    apart = F.col("diagonal") - F.lag("diagonal").over(of) > slack
    runs = voted.where("NOT base").withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(of))
    # the part's length is at most the template's and the slack
    runs = runs.withColumn("part", F.struct((F.bit_count(F.bit_or("mask").over(part)) / F.col("size")).alias("coverage"), F.min("low").over(part).alias("first"), (F.max("high").over(part) + 2).alias("last")))
    merged = runs.groupBy("uid", "template", "label", "size", "run").agg(F.bit_or("mask").alias("mask"), F.min("low").alias("first"), (F.max("high") + 2).alias("last"), F.max("part").alias("part"))
    whole = F.struct((F.bit_count("mask") / F.col("size")).alias("coverage"), "first", "last")
    # a span that is far longer than its template is scattered words, not a notice
    fits = F.col("last") - F.col("first") + 1 <= 2 * (F.col("size") + 2) + slack
    found = merged.select("uid", "label", F.when(fits, whole).otherwise(F.col("part")).alias("found")).where(F.col("found.coverage") >= coverage)
    return found.select("uid", "label", "found.first", "found.last", "found.coverage")


def scan(documents: DataFrame, coverage: float = 0.7, slack: int = 4) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row (see the module)."""
    rows = placed(documents)
    voted = votes(rows)
    base = voted.where("base").select("uid", "label", F.lit(True).alias("base"), F.col("diagonal").alias("first"), F.lit(1.0).alias("coverage"))
    method = spans(voted, coverage, slack).select("uid", "label", F.lit(False).alias("base"), F.lit(None).cast("int").alias("first"), "coverage")
    found = base.unionByName(method).groupBy("uid").agg(
        F.count("first").alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("coverage").alias("score"),
    )
    joined = rows.select("uid", "doc_id", "n_words").join(found, "uid", "left")
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        text("base_labels").alias("base_labels"), text("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
