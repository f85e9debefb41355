import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronofold.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d if i % 2 == 0 else 2 * d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p.lstrip("0")[:4] or 0) for p in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(rows).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (t, got[i], base)
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert got[i]["spans"].startswith(base)


CASES = [
    None, "", "a@b.c_d@e.f x", "é😀 mail a.b+c@d-e.co.uk!", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (974) 555-3436 or +49 30 1234567890123456", "a@b a@b.c@d.e", "x" * 5_000, "1" * 5_000, "7" * 3_000 + ".1.2.3", "card 4111111111111111 4111111111111111", "+1234567 +12345678)",
]


def test_cases_match_brute_force(spark):
    check(spark, CASES)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.@+- ()_é😀9", max_size=60), min_size=20, max_size=60))
def test_random_texts_match_brute_force(spark, texts):
    check(spark, texts)


def test_iban_by_mod_97_and_context_score(spark):
    rows = spark.createDataFrame([(1, "Konto DE89 3704 0044 0532 0130 00 ok"), (2, "DE89 3704 0044 0532 0130 01"), (3, "xx GB82WEST12345698765432.")], "doc_id long, text string")
    got = {r["doc_id"]: r["pii_iban"] for r in pii.find(rows).collect()}
    assert [(s["match"], round(s["score"], 2)) for s in got[1]] == [("DE89 3704 0044 0532 0130 00", 0.9)]
    assert got[2] == []
    assert [s["match"] for s in got[3]] == ["GB82WEST12345698765432"]


def test_empty_null_repeated_and_extra_columns(spark):
    schema = "doc_id long, text string, pii_email string, spans string"
    assert pii.digest(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a@b.c", None, "x")] * 2 + [(1, None, "y", None)], schema)
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in pii.digest(rows).collect()) == [(0, 1), (0, 1), (1, 0)]
