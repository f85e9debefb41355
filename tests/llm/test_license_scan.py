import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronofold.llm import license_scan as ls

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    words = re.findall(ls.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, uid string")
    got = {r["doc_id"]: r for r in ls.scan(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    return got


def test_cases(spark):
    got = check(spark, [
        None, "", "CC-BY", "cc by cc by cc", "cc", "general public license", "x General\nPublic  license general public LICENSE", "All rights reserved. All Rights, reserved",
        "Ünder cc by-nc é漢字 1.0", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "released under a mit licence", "the of and in",
        "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and its associated documentation files", "cc by " * 3000,
    ])
    assert got[9]["labels"] == "apache-2.0" and got[10]["labels"] == "mit" and got[11]["labels"] == "" and got[13]["labels"] == "mit"
    assert got[10]["score"] == 1 and 0.7 <= got[13]["score"] < 1 and got[12]["score"] == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "é", "."]), max_size=14).map(" ".join), min_size=30, max_size=50))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_repeated_null_and_empty(spark):
    schema = "doc_id long, text string, template int, labels string"
    assert ls.scan(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "cc by x", 1, "")] * 2 + [(1, "cc by x", 1, ""), (1, "all rights reserved", 2, None)], schema)
    assert sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in ls.scan(rows).collect()) == [(0, 1, "cc-by"), (0, 1, "cc-by"), (1, 1, "cc-by"), (1, 1, "reserved")]


def test_notices_that_repeat_or_stand_amid_their_fragments(spark):
    notice, gpl = "Creative Commons Attribution NonCommercial ", "GNU Lesser General Public License "
    got = check(spark, [notice, notice * 2, notice * 4, notice * 40, gpl * 9, "Creative Commons Attribution x " * 9 + notice + "Commons Attribution NonCommercial " * 9, "creative commons " * 40])
    assert [got[i]["labels"] for i in range(7)] == ["cc-by-nc"] * 4 + ["gpl,lgpl", "cc-by-nc", ""]
    assert all(got[i]["score"] == 1 for i in range(6))
