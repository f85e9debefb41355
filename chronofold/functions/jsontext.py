"""JSON text: the canonical form (RFC 8785), search text of arbitrary JSON, typed look-ups on VARIANT."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.schema import HistoryError


def _number(value: float) -> str:
    """A double as ECMAScript prints it."""
    if not math.isfinite(value):
        raise HistoryError("INVALID_JSON", "a number is not finite")
    if value == 0:
        return "0"
    sign, mantissa = ("-", -value) if value < 0 else ("", value)
    digits, _, power = f"{mantissa!r}e0".partition("e")
    power = int(power.split("e")[0])
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + power
    digits = whole + part
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    if 0 < point <= 21:
        body = digits + "0" * (point - len(digits)) if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + body


def encode(value: Any) -> str:
    """Canonical text of a decoded JSON value: sorted keys, shortest numbers, no spare escapes."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int | float):
        return _number(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    return "{" + ",".join(f"{encode(k)}:{encode(v)}" for k, v in sorted(value.items(), key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))) + "}"


def canonical(text: str | None) -> str:
    """Canonical form of JSON text; blank text is null, more than one value is an error."""
    if text is None or not text.strip():
        return "null"
    try:
        return encode(json.loads(text))
    except (ValueError, RecursionError) as e:
        raise HistoryError("INVALID_JSON", str(e)) from e


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _or_none(f, text: str | None) -> str | None:
    try:
        return f(text)
    except HistoryError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form, null where the text is no JSON."""
    return texts.map(lambda t: _or_none(canonical, t))


def _hidden(key: str) -> bool:
    return "encrypted" in key.lower() or "signature" in key.lower()


def _flat(value: Any, out: list[str]) -> None:
    if isinstance(value, dict):
        for key in sorted(value):
            if not _hidden(key):
                out.append(key)
                _flat(value[key], out)
    elif isinstance(value, list):
        for item in value:
            _flat(item, out)
    elif isinstance(value, bool):
        out.append("true" if value else "false")
    elif isinstance(value, int | float):
        out.append(_number(float(value)))
    elif isinstance(value, str):
        out.append(value)


def flatten(text: str | None) -> str:
    """Search text of JSON: keys in order and values, without opaque fields; null and bad JSON give ''."""
    out: list[str] = []
    try:
        _flat(json.loads(text or "null"), out)
    except (ValueError, RecursionError):
        return ""
    return " \n".join(out)


@F.pandas_udf(T.StringType())
def search_text(texts: pd.Series) -> pd.Series:
    return texts.map(flatten)


# typed look-ups; v is VARIANT


def parsed(content: Column) -> Column:
    return F.try_parse_json(content)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def string_at(v: Column, path: str) -> Column:
    """The value at the path if it is a string, else null."""
    return F.when(F.schema_of_variant(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """The value at the path as a double if it is a number, else null."""
    kind = F.schema_of_variant(_at(v, path))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def first_number(v: Column, *paths: str) -> Column:
    return F.coalesce(*(number_at(v, p) for p in paths), F.lit(0.0))


def coerced(value):
    """A value of any kind as JSON: mappings by the text of their keys, other collections as lists, the rest by its text."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, Mapping):
        return {str(k): coerced(v) for k, v in value.items()}
    if isinstance(value, Iterable) and not isinstance(value, bytes | bytearray):
        return [coerced(v) for v in value]
    return str(value)
