"""Text functions: tokens, titles, durations and other presentation scalars as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and numbers, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_list(text: str) -> list[str]:
    """The same for a string on the driver."""
    out, now = [], []
    for c in text:
        if c.isalpha() or c.isnumeric():
            now.append(c.lower())
        elif now:
            out.append("".join(now))
            now = []
    return [*out, "".join(now)] if now else out


def humanize(value: Column) -> Column:
    """Underscores and hyphens become spaces, the first letter of each word a capital."""
    spaced = F.split(F.translate(value, "_-", "  "), " ")
    return F.array_join(F.transform(spaced, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def tool_verb(tool: Column) -> Column:
    low = F.lower(tool)
    return (
        F.when(low == "github_search", "Search GitHub")
        .when(low == "web_search", "Search web")
        .when(low.contains("search"), F.trim(F.concat(F.lit("Search "), humanize(F.regexp_replace(tool, "(?i)_?search$", "")))))
        .when(low.startswith("read_"), F.concat(F.lit("Read "), humanize(F.substr(tool, F.lit(6)))))
        .when(low.contains("query") | low.contains("fetch"), humanize(tool))
        .when(low == "exec", "Run command")
        .otherwise(F.concat(F.lit("Run "), humanize(tool)))
    )


#: Titles of kinds.
TITLES = {
    "agent.turn.started": "Started agent turn", "agent.turn.completed": "Completed agent turn", "message.user": "User request",
    "message.assistant": "Agent response", "model.response": "Received model response", "test.evidence": "Verified evidence",
}


def event_title(kind: Column, tool: Column, model: Column, name: Column) -> Column:
    fixed = F.element_at(F.create_map(*(F.lit(x) for p in TITLES.items() for x in p)), kind)
    return (
        F.when(fixed.isNotNull(), fixed)
        .when(kind == "model.request", F.concat(F.lit("Asked "), F.coalesce(model, F.lit("model"))))
        .when(kind == "tool.call", tool_verb(F.coalesce(tool, name, F.lit("tool"))))
        .when(kind == "tool.result", F.concat(humanize(F.coalesce(tool, F.lit("Tool"))), F.lit(" result")))
        .otherwise(humanize(kind))
    )


def event_category(kind: Column) -> Column:
    head = F.regexp_extract(kind, r"^(message|model|tool|agent|test)\.", 1)
    return F.when(head != "", head).otherwise("event")


def short_id(value: Column, length: int = 9) -> Column:
    return F.substring(F.element_at(F.split(value, "_"), -1), 1, length)


def title_from_id(value: Column) -> Column:
    plain = value
    for pattern in ("^conv_", "(?i)_[a-f0-9]{8,}$", r"T\d{6}Z", r"_\d{8}"):
        plain = F.regexp_replace(plain, pattern, "")
    words = F.filter(F.split(plain, r"[._/-]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(title == "", "Untitled session").otherwise(title)


def format_duration(ms: Column) -> Column:
    ms = ms.cast("double")
    minutes, seconds = F.floor(ms / 60_000), F.floor(F.pmod(ms, F.lit(60_000.0)) / 1000 + 0.5)
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(ms.isNull() | F.isnan(ms) | (ms < 0), "—")
        .when(ms < 1000, text(F.floor(ms + 0.5), " ms"))
        .when(ms < 10_000, text(F.format_number(ms / 1000, 1), " s"))
        .when(ms < 60_000, text(F.floor(ms / 1000 + 0.5), " s"))
        .when(minutes >= 1440, text(F.floor(minutes / 1440), "d ", F.floor((minutes % 1440) / 60), "h"))
        .when(minutes >= 60, text(F.floor(minutes / 60), "h ", minutes % 60, "m"))
        .otherwise(text(minutes, "m ", seconds, "s"))
    )


def relative_date(value: Column, now: Column) -> Column:
    """Signed count and unit of the distance to now, in the coarsest of second, minute, hour and day."""
    delta = (F.unix_millis(value) - F.unix_millis(now)).cast("double")
    size = F.abs(delta)
    whole = lambda d: F.floor(delta / d + 0.5).cast("string")
    return F.when(size < 60_000, F.concat(whole(1000), F.lit(" second"))).when(size < 3_600_000, F.concat(whole(60_000), F.lit(" minute"))).when(size < 86_400_000, F.concat(whole(3_600_000), F.lit(" hour"))).otherwise(F.concat(whole(86_400_000), F.lit(" day")))


def prompt_title(prompt: Column) -> Column:
    """The first sentence where 24 to 105 characters stand before its mark, else the first 104 characters; white space is collapsed."""
    plain = F.trim(F.regexp_replace(prompt, r"\s+", " "))
    sentence = F.regexp_extract(plain, r"^(.{24,105}?[.!?])(?:\s|$)", 1)
    return F.when(sentence != "", sentence).when(F.length(plain) > 104, F.concat(F.substring(plain, 1, 104), F.lit("…"))).otherwise(plain)


def quote_value(value: str) -> str:
    return '"' + value.replace('"', '\\"') + '"' if re.search(r"\s", value) else value


def snippet(text: Column, needle: Column) -> Column:
    """240 characters from 80 before the first hit of needle (any case), with marks where text is cut."""
    text = F.trim(text)
    hit = F.when(needle.isNull() | (needle == ""), 0).otherwise(F.instr(F.lower(text), F.lower(needle)) - 1)
    start = F.greatest(F.lit(0), hit - 80)
    end = F.least(F.length(text), start + 240)
    body = F.trim(F.substr(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
