import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import language_id as li

SYLLABLES = {"en": "th ing er ould ness wh".split(), "de": "sch ung ein keit pf ü".split(), "fr": "eau oi ment é que ç".split()}


def documents(n=600, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 5)))) for _ in range(int(rng.integers(3, 60)))]
        out.append((i, " ".join(words), lang, "s"))
    return out


SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_split(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in li.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) == (li.crc_of(i) == 2) for i, *_ in rows)
    out = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows if got[i]["held_out"]]
    assert len(out) > 100 and sum(out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_and_sources_have_no_say(spark):
    rows = documents(300)
    wrong = [(i, t, "xx" if li.crc_of(i) == 2 else lang, s * 2) for i, t, lang, s in rows]
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, wrong))
    assert a == b


def test_null_letterless_repeated_and_unlabelled(spark):
    odd = [(1000, None, "en", "s"), (1001, "12 34 !!", "en", "s"), (1002, "", None, "s"), (1003, "thing would", None, "s"), (None, "schung ein", "de", "s"), (None, "schung ein", "de", "s"), (1005, "thing " * 30_000, "en", "s"), (1006, "x" * 100_000, None, "s")]
    got = li.identify(spark.createDataFrame(documents(300) + odd, SCHEMA)).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert [by[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003][0] == "en" and by[None][0] == "de" and by[1005][0] == "en" and len(got) == 308
    nothing = li.identify(spark.createDataFrame([(1, "some words", None, "s")], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert li.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def plain(learned, texts, evidence=20, penalty=0.5):
    """The definition, with counters: word first, then the longest n-grams known."""
    languages = sorted({lang for _, lang in learned})
    words = lambda t: re.findall(r"[^\W\d_]+", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()))
    grams = lambda w, n: [m[i : i + n] for m in [f"^{w}$" if n > 1 else w] for i in range(len(m) - n + 1)]
    count = {n: {lang: Counter() for lang in languages} for n in range(6)}
    for t, lang in learned:
        for w in words(t):
            count[0][lang][w] += 1
            for n in range(1, 6):
                count[n][lang].update(grams(w, n))
    keys = {n: set().union(*count[n].values()) for n in count}
    total = {n: {lang: count[n][lang].total() + 0.5 * len(keys[n]) for lang in languages} for n in count}

    def logs(n, key):
        raw = [math.log((count[n][lang][key] + 0.5) / total[n][lang]) for lang in languages]
        return [x - sum(raw) / len(raw) for x in raw]

    def score(w):
        if w in keys[0]:
            return logs(0, w)
        for n in range(5, 0, -1):
            if known := [logs(n, g) for g in grams(w, n) if g in keys[n]]:
                return [sum(c) / len(known) * penalty ** ((5 - n) / 5) for c in zip(*known)]
        return [0.0] * len(languages)

    for t in texts:
        if not (found := words(t or "")):
            yield "und", 0.0
            continue
        mean = [sum(c) / len(found) for c in zip(*map(score, found))]
        best = max(range(len(languages)), key=lambda i: (mean[i], -i))
        yield languages[best], 1 / sum(math.exp((m - mean[best]) * min(len(found), evidence)) for m in mean)


def test_equals_the_definition(spark):
    rows = documents(90, seed=4)
    odd = ["½ ² Ⅷ ① 3", "Ⅷthing½ould", "schungeinkeit" * 50, "eauément qqq zzz", "q", "日本語 中文", "x_y thing's", "THING Ould", None, "ßß İI"]
    rows += [(900 + i, t, None, "s") for i, t in enumerate(odd)]
    # a language written without spaces is learned from its long words
    rows += [(1000 + i, "".join(np.random.default_rng(i).permutation(list("日本語中文字漢かな"))) * 30, "ja", "s") for i in range(8)]
    got = {r["doc_id"]: r for r in li.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain([(t, lang) for i, t, lang, _ in rows if lang and li.crc_of(i) != 2], [t for _, t, _, _ in rows])
    for (i, text, _, _), (lang, score) in zip(rows, want):
        assert (got[i]["lang_pred"], pytest.approx(got[i]["score"], abs=1e-9)) == (lang, score), text
    assert got[900]["lang_pred"] == "und" and got[905]["lang_pred"] == "ja"


def test_repeated_rows_are_sampled_once(spark):
    rows = documents(60) + [(0, "thing " * 5, "en", "s")] * 500
    frame = spark.createDataFrame(rows, SCHEMA)
    assert (li.learn(frame, 80).words.matrix == li.learn(frame.dropDuplicates(), 80).words.matrix).all()


def test_back_off_goes_from_long_to_short_grams():
    model = li.fit({"abcdef": {"a": 5}, "xyzxyz": {"b": 5}})
    assert model.score("abcdef")[0] > 0 > model.score("xyzxyz")[0]
    assert model.score("bcdefg")[0] > model.score("ab")[0] > 0
    assert model.score("qqq").tolist() == [0, 0]
    assert sum(model.score("abcdef")) == pytest.approx(0)
