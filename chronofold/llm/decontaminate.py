"""Benchmark decontamination by template windows with slot consistency.

Texts and benchmark items become templates: numbers, units and names are replaced by typed slots, other
words are lower-cased and lose outer punctuation. Windows of ``WINDOW`` template words (items shorter than
that are one window) are hashed and joined: a document window meets an item's window if their templates
are equal, whatever stands in the slots. So a question with other numbers or names still meets.

A document and an item are a leak if one alignment of the two shows it. An alignment is a place of the item in
the document, give or take ``SLACK`` words that were left out or put in. Its windows cover at least ``coverage``
of the item's, and its slots agree: a value of the item always stands for the same value of the document, and no
other value of the item does (7 -> 9 everywhere, and only 7), in at least ``consistency`` of its values. Different
values mean a re-parameterised copy, equal ones a verbatim copy.

Only windows that can meet leave a task: a bitmap of 2^``BITMAP`` bits, of fixed size whatever the
benchmark, holds the hashes of the items' windows. It lets a few strangers through, which the join drops,
and loses nothing. Windows that many items share (the same opening of a question) would bring each of their
documents to each of the items. But who has c of an item's n windows has one of any n - c + 1 of them, so that only
so many of each item, the ones that the fewest items have, propose pairs; pairs then take their windows by key.

A capital says little about a word that may begin a sentence, and nothing in a text in lower case. So a text has
four readings: names are capitalised words inside sentences, or all capitalised words, or none, and the last one
has no slots at all. Windows meet in the readings that both sides have in common, and a leak is one in any of them;
the figures are of the first one. Windows with more slots than words say nothing about a text and are left out
on the items' side; the last reading has none, so that verbatim copies are found whatever they consist of.
Items of fewer than ``SHORT`` words ("yes") are found only where they are a whole line or sentence.

Defined results: null or empty texts have no windows. A null item_id is reported as null. Rows that repeat
a doc_id are judged one by one and reported once for each item. Texts that repeat an item_id are looked for one by
one and reported as one item. Of equal alignments the first in the text is reported. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import row_uid, stored, worker_cache, working_for
from chronofold.llm.substring_dedup import rolling

WINDOW = 8
#: Items of fewer words must be a line or a sentence.
SHORT = 4
#: Words by which the places of an alignment's windows may shift.
SLACK = 3
#: Power of two of the bits that say which hashes occur in the benchmark.
BITMAP = 22
CACHED_WORDS = 300_000
#: Units after a number, and marks of currency or share.
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent $ € £ usd eur dollars euros cents degrees °c °f kb mb gb mph kph km/h w kw v a hz".split())
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*([%°a-zA-Z$€£]*)")
OUTER = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~%$«»“”‘’…¿¡"

LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
_SLOTS = np.array([xxhash.xxh64_intdigest(x, 11) for x in ("", "<number>", "<unit>", "<name>")], np.uint64)
#: Names inside sentences, all capitalised words, no names, no slots.
READINGS = 4


class _Words(dict):
    """word -> index into hash, kind, may it be a name, does a sentence end with it, is it a word at all."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, bool, bool, bool]] = []

    def __missing__(self, word: str) -> int:
        core = word.strip(OUTER)
        kind, name = LITERAL, False
        if word[:1] in "0123456789+-$€£(" and NUMBER.fullmatch(word.strip("()[],;!?\"'").rstrip(".:")):
            kind = NUM
        elif core.lower() in UNITS or word in ("%", "$", "€", "£"):
            kind = UNIT
        elif len(core) > 1 and core[0].isupper() and core[1:].islower():
            name = True
        self[word] = n = len(self)
        self.rows.append((xxhash.xxh64_intdigest(core.lower(), 11), kind, name, word.rstrip("\"')”’»")[-1:] in ".!?:", bool(core) or kind == UNIT))
        return n

    def clear(self) -> None:
        super().clear()
        self.rows = []


class _Table:
    """The words' columns as arrays that double when full."""

    KINDS = (np.uint64, np.int8, bool, bool, bool)

    def __init__(self) -> None:
        self.words, self.filled = _Words(), 0
        self.columns = [np.zeros(1 << 14, t) for t in self.KINDS]

    def index(self, words: list[str]) -> np.ndarray:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
            self.filled = 0
        index = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        new, self.words.rows = self.words.rows, []
        if new:
            end = self.filled + len(new)
            while len(self.columns[0]) < end:
                self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
            for c, values in zip(self.columns, zip(*new)):
                c[self.filled : end] = values
            self.filled = end
        return index


_table = _Table()
worker_cache("templates", lambda: _table.__init__())


def readings(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash, kind) of each template word in each of the READINGS, as rows, and the words themselves."""
    words = (text or "").split()
    index = _table.index(words)
    if not len(index):
        return np.empty((READINGS, 0), np.uint64), np.empty((READINGS, 0), np.int8), []
    hashes, kind, name, ends, real = (c[index] for c in _table.columns)
    first = np.append(True, ends[:-1])
    after_number = np.append(False, kind[:-1] == NUM)
    kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
    name = name & (kind == LITERAL)
    kinds = np.stack([np.where(name & ~first, NAME, kind), np.where(name, NAME, kind), kind, np.zeros_like(kind)])
    hashes = np.where(kinds == LITERAL, hashes, _SLOTS[kinds])
    stays = np.flatnonzero(real)
    if len(stays) < len(words):
        return hashes[:, stays], kinds[:, stays], [words[i] for i in stays]
    return hashes, kinds, words


def whole(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each template word, whether a line or sentence begins with it, and ends with it."""
    words = (text or "").split()
    index = _table.index(words)
    ends, real = _table.columns[3][index].copy(), _table.columns[4][index]
    lines = np.cumsum([len(line.split()) for line in (text or "").splitlines()])
    ends[lines[lines > 0] - 1] = True
    # a boundary anywhere between two template words counts
    stays = np.flatnonzero(real)
    passed = np.append(np.cumsum(ends), 0)
    after = np.append(stays[1:], len(words)) - 1
    last = passed[after] > passed[stays - 1]
    return np.append(True, last[:-1])[: len(stays)], last


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash, kind) of each template word in the first reading and the words themselves."""
    hashes, kinds, words = readings(text)
    return hashes[0], kinds[0], words


SCHEMA = "h long, owner long, uid long, place int, size int, readings int, windows array<int>, slots array<string>"
_ARROW = pa.schema([("h", pa.int64()), ("owner", pa.int64()), ("uid", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("readings", pa.int32()), ("windows", pa.list_(pa.int32())), ("slots", pa.list_(pa.string()))])


def _windows(sizes: list[int], bitmap: np.ndarray | None):
    """owner, uid, text -> windows of these sizes; of items (no bitmap) one size each, without those of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("templates")
        for batch in batches:
            held: list[list] = [[] for _ in _ARROW]
            for owner, uid, text in zip(*(batch.column(i) for i in range(3))):
                hashes, kinds, words = readings(text.as_py())
                for size in sizes if bitmap is not None else [min(WINDOW, len(words))]:
                    if not size or len(words) < size:
                        continue
                    # the readings one after another; windows across two of them are cut off
                    h = rolling(hashes.reshape(-1), size)
                    h = np.append(h, np.zeros(size - 1, np.uint64)).reshape(READINGS, -1)[:, : len(words) - size + 1]
                    if bitmap is not None:
                        low = (h & np.uint64((1 << BITMAP) - 1)).astype(np.int64)
                        taken = (bitmap[low >> 6] >> (low & 63) & 1).astype(bool)
                        if size < SHORT and taken.any():
                            begins, ends = whole(text.as_py())
                            taken &= begins[: len(words) - size + 1] & ends[size - 1 :]
                    else:
                        slots = np.cumsum(np.pad(kinds != LITERAL, ((0, 0), (1, 0))), axis=1)
                        taken = 2 * (slots[:, size:] - slots[:, :-size]) <= size
                    windows = taken.sum(axis=1).tolist()
                    for p in np.flatnonzero(taken.any(axis=0)).tolist():
                        same: dict[int, int] = {}  # equal readings are one row
                        for r in np.flatnonzero(taken[:, p]).tolist():
                            same[int(h[r, p])] = same.get(int(h[r, p]), 0) | 1 << r
                        for mask in same.values():
                            r = (mask & -mask).bit_length() - 1
                            row = (h[r, p].astype(np.int64), owner.as_py(), uid.as_py(), p, size, mask, windows, [words[p + i].strip(OUTER) or words[p + i] for i in np.flatnonzero(kinds[r, p : p + size])])
                            for to, value in zip(held, row):
                                to.append(value)
                if len(held[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, _ARROW)], schema=_ARROW)
                    held = [[] for _ in _ARROW]
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, _ARROW)], schema=_ARROW)

    return run


def bitmap_of(items: DataFrame) -> np.ndarray:
    """Bits of the items' window hashes: 2^BITMAP of them, in 64s, however many items."""
    bits = np.zeros((1 << BITMAP) // 64, np.int64)
    low = items.select(F.col("h").bitwiseAND((1 << BITMAP) - 1).alias("low"))
    for r in low.groupBy((F.col("low") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 AS int))")).alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    return bits


def _each_reading(rows: DataFrame) -> DataFrame:
    """A row for each reading of a row's set of them."""
    each = F.filter(F.sequence(F.lit(0), F.lit(READINGS - 1)), lambda r: F.expr("readings").bitwiseAND(F.pow(F.lit(2), r).cast("int")) != 0)
    return rows.withColumn("reading", F.explode(each)).drop("readings")


def proposing(items: DataFrame, coverage: float) -> DataFrame:
    """Of each item's windows in each reading the n - c + 1 that the fewest items have (see the module)."""
    rows = _each_reading(items.select("h", "size", "item", "item_place", "readings", "windows"))
    shared = items.groupBy("h", "size").agg(F.count_distinct("item").alias("items"))
    order = Window.partitionBy("item", "reading").orderBy("items", "item_place")
    rows = rows.join(shared, ["h", "size"]).withColumn("rank", F.row_number().over(order)).withColumn("n", F.get("windows", F.col("reading")))
    return rows.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(coverage) * F.col("n") - 1e-9) + 1).select("h", "size", "item", "reading")


def consistency_of(pairs: Column) -> Column:
    """Of a set of (theirs, ours), the share of their values that stand for one value of ours that no other stands for."""
    theirs = F.array_distinct(F.transform(pairs, lambda p: p["theirs"]))
    alone = lambda p, of: F.size(F.filter(pairs, lambda q: q[of] == p[of])) == 1
    good = F.filter(pairs, lambda p: alone(p, "theirs") & alone(p, "ours"))
    return F.when(F.size(theirs) > 0, F.size(good) / F.size(theirs)).otherwise(1.0)


def leaking_rows(documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5, consistency: float = 0.8) -> DataFrame:
    """doc_id, uid (of the row, by doc_id and text), item_id and the figures of the best alignment of each leak."""
    if not 0 < coverage <= 1 or not 0 <= consistency <= 1:
        raise ValueError("coverage must be in (0, 1] and consistency in [0, 1]")
    own = benchmark.select(F.col("item_id").cast("long").alias("owner"), row_uid("item_id", "text").alias("uid"), "text").distinct()
    items = stored(own.mapInArrow(_windows([], None), SCHEMA), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    docs = documents.select(F.col("doc_id").cast("long").alias("owner"), row_uid("doc_id", "text").alias("uid"), "text")
    found = docs.mapInArrow(_windows(sizes, bitmap_of(items)), SCHEMA)
    found = stored(found.select("h", "size", F.col("owner").alias("doc_id"), "uid", "place", F.col("readings").alias("ours"), "slots"), "found")
    theirs = items.select("h", "size", F.col("owner").alias("item_id"), F.col("uid").alias("item"), F.col("place").alias("item_place"), "readings", "windows", F.col("slots").alias("item_slots"))
    in_reading = F.col("ours").bitwiseAND(F.pow(F.lit(2), F.col("reading")).cast("int")) != 0
    proposed = found.select("h", "size", "uid", "ours").join(proposing(theirs, coverage), ["h", "size"]).where(in_reading).select("uid", "item").distinct()
    # the windows of proposed pairs, by the item and then by the document and the window
    met = proposed.join(theirs, "item").join(found, ["uid", "h", "size"]).withColumn("shift", F.col("place") - F.col("item_place"))
    met = met.withColumn("readings", F.col("readings").bitwiseAND(F.col("ours"))).where("readings <> 0")
    met = _each_reading(met.drop("h", "size", "ours"))
    # an alignment begins at any shift and takes in what lies up to SLACK beyond
    met = met.withColumn("anchor", F.explode(F.sequence(F.col("shift") - SLACK, F.col("shift"))))
    slots = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("theirs"), z["slots"].alias("ours")))
    aligned = met.groupBy("uid", "item", "reading", "anchor").agg(
        F.max("doc_id").alias("doc_id"), F.max("item_id").alias("item_id"), F.count_distinct("item_place").cast("long").alias("matched"), F.max(F.get("windows", F.col("reading"))).cast("long").alias("windows"),
        F.min("place").cast("long").alias("first_word"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs"),
    )
    aligned = aligned.withColumns({"coverage": F.col("matched") / F.col("windows"), "slot_consistency": consistency_of(F.col("pairs")), "reparameterised": F.exists("pairs", lambda p: p["theirs"] != p["ours"])})
    kept = aligned.where((F.col("coverage") >= coverage) & (F.col("slot_consistency") >= consistency))
    return kept.groupBy("doc_id", "uid", "item_id", "item").agg(_first().alias("best")).select("doc_id", "uid", "item_id", "best.reading", *(F.col(f"best.{c}_").alias(c) for c in FIGURES))


def _first() -> Column:
    """The figures of the first reading, of the best alignment in it, of the first of equal ones."""
    return F.min(F.struct("reading", -F.col("coverage"), -F.col("slot_consistency"), F.col("first_word").alias("at"), *(F.col(c).alias(f"{c}_") for c in FIGURES)))


FIGURES = ("matched", "windows", "coverage", "slot_consistency", "reparameterised", "first_word")


def leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5, consistency: float = 0.8) -> DataFrame:
    """doc_id, item_id, matched and all windows, coverage, slot_consistency, reparameterised, first_word of each leak."""
    rows = leaking_rows(documents, benchmark, coverage, consistency)
    return rows.groupBy("doc_id", "item_id").agg(_first().alias("best")).select("doc_id", "item_id", *(F.col(f"best.{c}_").alias(c) for c in FIGURES))
