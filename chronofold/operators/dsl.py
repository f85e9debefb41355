"""The timeline filter language: field:value clauses, negation, wildcards, units and free text, as one column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import jsontext as js

FIELDS = ("kind", "agent", "tool", "model", "status", "trace", "offset", "size", "tokens", "has")
#: Units of numbers.
UNITS = {
    "offset": {"h": 3_600_000, "m": 60_000, "min": 60_000, "s": 1000},
    "size": {"mb": 1_048_576, "kb": 1024, "k": 1024},
    "tokens": {"m": 1_000_000, "k": 1000},
}


@dataclass(frozen=True)
class Term:
    """A clause: text (no field) or a field's comparison; operator is one of contains = > >= < <=."""

    field: str
    operator: str
    value: str
    negated: bool = False


def _split(query: str) -> tuple[list[str], bool]:
    """Tokens between white space outside quotes, and whether a quote stays open."""
    found = re.findall(r'(?:"[^"]*(?:"|$)|[^\s"])+', query.strip())
    return found, query.count('"') % 2 == 1


def parse(query: str) -> tuple[list[Term], list[str]]:
    """Clauses and messages about tokens that are none; the clauses apply all the same."""
    tokens, still_open = _split(query)
    terms, errors = [], ["a quotation has no end"] if still_open else []

    def bare(value: str) -> str:
        return value[1:-1] if value.startswith('"') and value.endswith('"') else value

    for token in tokens:
        negated = token.startswith("-")
        token = token[negated:]
        name, colon, value = token.partition(":")
        if not colon or not name:
            if bare(token):
                terms.append(Term("", "contains", bare(token), negated))
            continue
        name, value = name.lower(), bare(value)
        if name not in FIELDS and not name.startswith("tag."):
            errors.append(f"{name} is no field of the filter")
        elif not value:
            errors.append(f"{name}: stands without a value")
        else:
            m = re.match(r"(>=|<=|>|<|=)(.+)$", value, re.S)
            terms.append(Term(name, m[1] if m else "contains", m[2] if m else value, negated))
    return terms, errors


def number(value: str, field: str) -> float | None:
    m = re.fullmatch(r"([\d.]+)\s*([a-z]*)", value.strip().lower(), re.A)
    if not m:
        return None
    try:
        return float(m[1]) * UNITS.get(field, {}).get(m[2], 1)
    except ValueError:
        return None


def _text_matches(actual: Column, term: Term) -> Column:
    target = term.value.lower()
    if term.operator == "contains" and "|" in target:
        found = F.lit(False)
        for part in target.split("|"):
            found = found | _text_matches(actual, Term(term.field, "contains", part))
        return found
    low = F.lower(actual)
    if term.operator == "=":
        hit = low == target
    elif "*" in target:
        pattern = ".*".join(re.sub(r"([\\.+?^${}()|\[\]])", r"\\\1", p) for p in target.split("*"))
        hit = actual.rlike(f"(?i)^{pattern}$")
    else:
        hit = low.contains(target)
    return F.coalesce(hit & (actual != ""), F.lit(False))


def _number_matches(actual: Column, term: Term) -> Column:
    wanted = number(term.value, term.field)
    if wanted is None:
        return F.lit(False)
    compare = {">": actual > wanted, ">=": actual >= wanted, "<": actual < wanted, "<=": actual <= wanted}
    return F.coalesce(compare.get(term.operator, actual == wanted), F.lit(False))


def model() -> Column:
    return js.string_at(js.parsed(F.col("content")), "$.model")


def token_sum() -> Column:
    v = js.parsed(F.col("content"))
    return sum((F.coalesce(js.number_at(v, f"$.usage.{k}"), F.lit(0.0)) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens")), F.lit(0.0))


def search_text() -> Column:
    """All that free text is looked for in, in lower case."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(" ", F.nullif(e["key"], F.lit("")), F.nullif(e["value"], F.lit(""))))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("kind", "agent", "tool", "status", "trace_id")]
    return F.lower(F.concat_ws(" ", *parts, model(), F.array_join(tags, " "), "content"))


def condition(terms: list[Term]) -> Column:
    """All clauses at once, over records with a column offset_ms."""
    plain = {"kind": F.col("kind"), "agent": F.col("agent"), "tool": F.col("tool"), "status": F.col("status"), "trace": F.col("trace_id")}
    numbers = {"offset": F.col("offset_ms"), "size": F.col("content_size")}
    out = F.lit(True)
    for term in terms:
        if not term.field:
            hit = F.coalesce(search_text().contains(term.value.lower()), F.lit(False))
        elif term.field == "has":
            what = term.value.lower()
            present = {**{k: F.coalesce(plain[k] != "", F.lit(False)) for k in ("trace", "tool", "agent", "status")}, "tags": F.coalesce(F.size("tags") > 0, F.lit(False))}
            hit = present.get(what, F.lit(False))
        elif term.field.startswith("tag."):
            hit = _text_matches(F.col("tags")[term.field[4:]], term)
        elif term.field in numbers:
            hit = _number_matches(numbers[term.field], term)
        elif term.field == "tokens":
            hit = _number_matches(token_sum(), term)
        else:
            hit = _text_matches(model() if term.field == "model" else plain[term.field], term)
        out = out & (~hit if term.negated else hit)
    return out


def with_offsets(records: DataFrame) -> DataFrame:
    start = F.min("occurred_at").over(Window.partitionBy("conversation_id"))
    return records.withColumn("offset_ms", F.unix_millis("occurred_at") - F.unix_millis(start))


def matching(records: DataFrame, query: str) -> DataFrame:
    """records with offset_ms that all clauses of the query match."""
    return with_offsets(records).where(condition(parse(query)[0]))
