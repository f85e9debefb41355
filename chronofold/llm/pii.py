"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is built from DataFrame functions. A span is a match of a kind's pattern, leftmost and not
overlapping within the kind, that passes the kind's check (digit counts, ranges, Luhn, mod-97); a
failing match is dropped and not retried. Positions are code points, the end is exclusive. Where the
pattern of a contract would rescan a run of characters from each of its positions, an equivalent
pattern is used that enters a run only at its start or where the last match ended.

Kinds: email, ip, card and phone (the base) and iban (added by the method, confirmed by mod-97). The
score starts from the kind's prior and rises where a context word of the kind stands within
``window`` code points before the span; it ranks spans and drops none of the base kinds.

Defined results: null text counts as empty (no spans). Repeated rows give repeated results, row by
row; nulls in other columns are carried along. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Local-part and host classes of the email contract.
LOCAL = r"A-Za-z0-9._%+-"
HOST = r"A-Za-z0-9-"
#: Fixed value: a dotted part of at most 255, leading zeros allowed.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A pattern, a character that every match holds ('' for none), a prior score and context words."""

    name: str
    pattern: str
    needs: str
    prior: float
    context: str


#: In the order in which spans are listed.
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{HOST}]+(?:\.[{HOST}]+)+", "@", 0.9, r"(?i)e-?mail|contact|write to|mailto|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, r"(?i)\bip\b|address|host|server|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"(?i)card|visa|master|credit|debit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"(?i)phone|tel|call|mobile|fax|anruf"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.7, r"(?i)iban|account|bank|konto|compte|cuenta"),
)
BASE = ("email", "ip", "card", "phone")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _luhn_value(d.try_cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _luhn_value(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 by 97 once its first four characters are moved to the end."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    values = F.transform(F.split(moved, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def spans_of(kind: Kind, text: Column, window: int = 40) -> Column:
    """array<struct<kind, start, end, match, score>> of the confirmed matches, in order of start."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.needs:
        found = F.when(F.contains(text, F.lit(kind.needs)), found)
    # the pieces between matches give the positions; they are cut only where something was found
    pieces = F.when(F.size(found) > 0, F.split(text, kind.pattern, -1))
    empty = F.array().cast("array<struct<start:int,match:string,before:string>>")
    placed = F.aggregate(
        F.arrays_zip(found.alias("m"), pieces.alias("p")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.when(x["m"].isNull(), a).otherwise(
            F.struct(
                (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), x["m"].alias("match"), F.right(x["p"], F.lit(window)).alias("before")))).alias("out"),
            )
        ),
        lambda a: a["out"],
    )
    spans = F.transform(
        F.filter(placed, lambda s: confirmed(kind.name, s["match"])),
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match"),
            F.when(s["before"].rlike(kind.context), F.lit(min(1.0, kind.prior + 0.2))).otherwise(F.lit(kind.prior)).alias("score"),
        ),
    )
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,match:string,score:double>>"))


def find(documents: DataFrame, text_col: str = "text", window: int = 40) -> DataFrame:
    """documents with a column per kind, pii_<kind>: its confirmed spans (see the module)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.withColumns({f"pii_{k.name}": spans_of(k, text, window) for k in KINDS})


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base listing and the listing of all kinds."""
    rows = find(documents.select("doc_id", "text"))
    columns = {k.name: F.col(f"pii_{k.name}") for k in KINDS}
    counts = [F.size(columns[k]).cast("long").alias(f"n_{k}") for k in BASE]
    base = listing(F.concat(*(columns[k] for k in BASE)))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listing(F.concat(*columns.values())).alias("spans"), F.array_max(F.transform(F.concat(*columns.values()), lambda s: s["score"])).alias("top_score"))
