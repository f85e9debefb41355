"""Language identification, word first: known words by log frequency, unseen words by shorter and shorter n-grams.

Learning. From labelled rows a sample of at most ``sample`` documents is taken (those with the smallest hash of
doc_id and text, equal rows once; the bound is a parameter, prediction runs over every whole text). Spark counts
the sample's words, and the character n-grams (``ORDER`` down to 1, with the word's edges marked) of all of them,
by language with partial sums; the counts of the sample reach the driver. The model holds for each word and each
n-gram the smoothed log frequency in each language.

Prediction. Words are maximal runs of letters (Unicode categories L), lower-cased, however long. A known word
scores its log frequencies. An unseen word backs off: the longest n for which any of its n-grams is known gives
the mean of their log frequencies, weighted down with each step. A language's score is the mean over the text's
words; the answer is the best language, ties go to the first by name. ``score`` is its share once the scores are
turned into probabilities as if the text had ``evidence`` words at most, so that it stays between 0 and 1 and a
long text does not make every answer certain.

Defined results: null texts and texts without a letter are ``und`` with the score 0, as is every text if
nothing was learned. Rows without a language, with null text or null doc_id are not learned from. Repeated
rows get equal answers. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import stored, working_for
from chronofold.llm.substring_dedup import powers

UNDETERMINED = "und"
ORDER = 5
_WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    found = _WORD.findall((text or "").lower())
    if text is None or text.isascii():
        return found
    # the expression takes fractions, Roman and circled numbers for letters too
    return [part for w in found for part in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with marked edges; single letters have no edges."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, the same wherever it stands."""
    up, down = powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:-1], dtype=np.uint64)])
    value = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


@dataclass
class Table:
    """Hashes of keys, in order, with a row of a matrix each: centred log frequency by language."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class Model:
    """Log frequency by language of words and, for each n, of n-grams."""

    languages: list[str]
    words: Table = field(default_factory=Table)
    grams: dict[int, Table] = field(default_factory=dict)
    penalty: float = 0.5

    def scores(self, words: list[str]) -> np.ndarray:
        """A row by language for each word: its own if it is known, else that of the longest n-grams known."""
        out = np.zeros((len(words), len(self.languages)))
        if not words or not self.languages:
            return out
        # ^word$^word$...: the spans of words and n-grams are places in one array
        codes, sizes = _codes(f"^{'$^'.join(words)}$"), np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes + 2) - sizes - 1
        rows = self.words.rows(span_hashes(codes, first, first + sizes))
        known = rows >= 0
        out[known] = self.words.matrix[rows[known]]
        left = np.flatnonzero(~known)
        for n in range(ORDER, 0, -1):
            edge = 1 if n > 1 else 0
            counts = sizes[left] + 2 * edge - n + 1
            long = left[counts > 0]
            counts = counts[counts > 0]
            if not len(long):
                continue
            ends = np.cumsum(counts)
            begin = np.repeat(first[long] - edge - ends + counts, counts) + np.arange(ends[-1])
            rows = self.grams[n].rows(span_hashes(codes, begin, begin + n))
            there = rows >= 0
            found = np.zeros((len(rows), len(self.languages)))
            found[there] = self.grams[n].matrix[rows[there]]
            hits = np.add.reduceat(there.astype(np.int64), ends - counts)
            sums, some = np.add.reduceat(found, ends - counts, axis=0), hits > 0
            out[long[some]] = sums[some] / hits[some, None] * self.penalty ** ((ORDER - n) / ORDER)
            left = np.setdiff1d(left, long[some], assume_unique=True)
        return out

    def score(self, word: str) -> np.ndarray:
        return self.scores([word])[0]


def fit(words: dict[str, dict[str, int]], by_n: dict[int, dict[str, dict[str, int]]] | None = None) -> Model:
    """Model of word -> language -> count, and the same of the n-grams for each n (counted here if not given).

    Frequencies are add-half smoothed and centred over the languages.
    """
    languages = sorted({lang for by in words.values() for lang in by})
    place = {lang: i for i, lang in enumerate(languages)}

    def table(counts: dict[str, dict[str, int]]) -> Table:
        counted = np.full((len(counts), len(languages)), 0.5)
        for i, by in enumerate(counts.values()):
            for lang, n in by.items():
                counted[i, place[lang]] += n
        logs = np.log(counted / counted.sum(axis=0))
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        ends = np.cumsum(sizes)
        hashes = span_hashes(_codes("".join(counts)), ends - sizes, ends)
        order = np.argsort(hashes)
        return Table(hashes[order], (logs - logs.mean(axis=1, keepdims=True))[order])

    return Model(languages, table(words), {n: table(t) for n, t in (by_n or gram_counts(words)).items()})


def gram_counts(words: dict[str, dict[str, int]]) -> dict[int, dict[str, dict[str, int]]]:
    """n -> n-gram -> language -> count, of words with their counts by language."""
    out: dict[int, dict[str, dict[str, int]]] = {n: defaultdict(lambda: defaultdict(int)) for n in range(1, ORDER + 1)}
    for word, by in words.items():
        for n, to in out.items():
            for g in grams(word, n):
                for lang, count in by.items():
                    to[g][lang] += count
    return out


class Scorer(dict):
    """word -> row of the score table; words that are new are scored together before their texts."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.table, self.new = model, np.zeros((1 << 14, len(model.languages))), []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def predict(self, texts: list[str | None], evidence: int = 20) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if len(self) > CACHED_WORDS:
            self.clear()
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        first, new, self.new = len(self) - len(self.new), self.new, []
        while len(self.table) < len(self):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : len(self)] = self.model.scores(new)
        names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        some = np.flatnonzero(counts)
        if not len(some) or not self.model.languages:
            return names.tolist(), scores
        starts = (np.cumsum(counts) - counts)[some]
        mean = np.add.reduceat(self.table[index], starts, axis=0) / counts[some, None]
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(counts[some], evidence)[:, None])
        names[some] = np.array(self.model.languages, object)[best]
        scores[some] = 1 / odds.sum(axis=1)
        return names.tolist(), scores


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


COUNTED = "lang string, size int, key string, n long"


def _counted(found: dict[tuple[str, int, str], int]) -> pa.RecordBatch:
    lang, size, key = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(key, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "size", "key", "n"])


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> counts of the words, as size 0."""
    for batch in batches:
        found: dict[tuple[str, int, str], int] = defaultdict(int)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word in words_of(text.as_py()):
                found[lang, 0, word] += 1
        yield _counted(found)


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n -> counts of the n-grams of each size."""
    for batch in batches:
        found: dict[tuple[str, int, str], int] = defaultdict(int)
        for lang, word, count in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for n in range(1, ORDER + 1):
                for g in grams(word, n):
                    found[lang, n, g] += count
        yield _counted(found)


def learn(labelled: DataFrame, sample: int = 4000) -> Model:
    """Model of labelled(doc_id, text, lang), fitted on at most ``sample`` rows (see the module)."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")
    # the sample's bound is a hash, found on the hashes alone; the texts stay where they are
    cut = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return Model([])
    once = rows.where(F.col("h") <= cut).groupBy("h").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    total = lambda df: df.groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))
    words = stored(total(once.select("lang", "text").mapInArrow(_sampled_words, COUNTED)), "words")
    found = total(words.select("lang", "key", "n").mapInArrow(_sampled_grams, COUNTED))
    counts: dict[int, dict[str, dict[str, int]]] = {n: defaultdict(dict) for n in range(ORDER + 1)}
    for r in words.unionByName(found).orderBy("size", "key", "lang").toLocalIterator():
        counts[r["size"]][r["key"]][r["lang"]] = r["n"]
    return fit(counts.pop(0), counts)


def _predicted(shared, evidence: int, names: list[str]):
    sent = ["text", *(n for n in names if n != "text")]
    kept = [sent.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for()
        scorer = Scorer(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                found, scores = scorer.predict(batch.column(0).to_pylist(), evidence)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def predict(texts: DataFrame, model: Model, keep: dict[str, str] | None = None, evidence: int = 20) -> DataFrame:
    """The columns of ``keep`` (name -> type; doc_id if not given; text may be one) with lang_pred and score of each whole text."""
    keep = keep or {"doc_id": "long"}
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{k} {v}" for k, v in [*keep.items(), ("lang_pred", "string"), ("score", "double")])
    return texts.select("text", *(k for k in keep if k != "text")).mapInArrow(_predicted(shared, evidence, list(keep)), schema)


def identify(documents: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    rows = documents.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(rows.where("NOT held_out"), sample)
    return predict(rows, model, {"doc_id": "long", "held_out": "boolean"})


def crc_of(doc_id: int) -> int:
    """The remainder that decides who is held out, for tests and callers outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 4

