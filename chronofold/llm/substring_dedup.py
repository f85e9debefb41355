"""Substring dedup: words covered by windows that also start in a document with a smaller doc_id.

A window is ``WINDOW`` consecutive words of one text. Windows are the suffixes of the texts, cut at that
depth; two of them are equal where they meet in a node of the suffix tree at that depth or deeper. The
tree of all texts does not fit anywhere, so suffixes are split by prefixes into groups that do:

- Prefix. Each window takes the smallest hash of the ``GRAM``-word grams it begins or contains (its
  minimiser). Equal windows take equal grams, so a group, all suffixes at one gram, is complete. Windows
  in a row mostly share their gram: a group gets them as one piece of text (a snippet), where a prefix at
  the window's own start would need ``WINDOW`` words for every single suffix.
- Grams that occur in one doc_id only cannot hold a repeat across documents; they are dropped before any
  text moves.
- Variable length. A group of more than ``GROUP`` suffixes is split by the longest prefix there is, all
  ``WINDOW`` words (as two 64-bit hashes): each of its parts is one node of the tree at full depth, of
  which only the smallest doc_id is needed, an aggregate with partial sums and no group in memory.
- Subtrees. Each other group's tree is built in memory as a suffix order with the depths at which neighbours
  part (longest common prefixes). A run of leaves that part no higher than a window's depth is an internal node that
  deep: a repeat, maximal to the right within its pieces. Its leaves in other than the smallest document are marked.

Marks become word intervals, which meet their document in one join. The texts are exchanged by document
once; the snippets and the result read the same exchange.

Words are compared by hashes: paths by 64 bits (128 for the longest prefix), and in the subtrees each of
the words of a path by 32 bits more.

Defined results: null text has no words. A text under ``WINDOW`` words keeps them all. A null doc_id is
smaller than none and has no smaller: its text stays and removes nothing. Rows that repeat a doc_id are
judged row by row and do not remove each other's words. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import row_uid, stored, worker_cache, working_for

WINDOW, GRAM = 50, 10
#: Suffixes that one group holds in memory; beyond, the prefix is lengthened.
GROUP = 50_000
#: Distinct words whose hashes a worker holds before it starts anew.
CACHED_WORDS = 300_000
#: Odd numbers that the rolling hashes count in.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_hashes = _WordHashes()
worker_cache("words", _hashes.clear)


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(4096, 2 * n)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[base] = (out[0], out[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the first base and of its inverse."""
    return _power(BASES[0], n)


def rolling(words: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of so many words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power(base, len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    value = (sums[width:] - sums[:-width]) * down[:n]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of so many values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, first window, windows) of each run of windows that share their prefix."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = sliding_min(rolling(words, gram), window - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    return low[first].view(np.int64), first, np.diff(np.append(first, len(low)))


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or "").encode().split()


def _prefixes(window: int, gram: int):
    """doc_id, uid, text -> a row for each prefix of a text with the number of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("words")
        for batch in batches:
            at, prefixes, counts = [], [], []

            def out() -> pa.RecordBatch:
                where = pa.array(np.concatenate(at))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), batch.column(0).take(where), batch.column(1).take(where), pa.array(np.concatenate(counts))], names=["prefix", "doc_id", "uid", "n"])

            size = 0
            for i, text in enumerate(batch.column(2)):
                prefix, _, n = runs(hashed(_words(text)), window, gram)
                prefix, which = np.unique(prefix, return_inverse=True)
                at.append(np.full(len(prefix), i))
                prefixes.append(prefix)
                counts.append(np.bincount(which, weights=n, minlength=len(prefix)).astype(np.int64))
                size += len(prefix)
                if size > 200_000:
                    yield out()
                    at, prefixes, counts, size = [], [], [], 0
            if at:
                yield out()

    return run


SNIPPETS = "long boolean, prefix long, second long, doc_id long, uid long, first int, words binary"


def _snippets(window: int, gram: int):
    """doc_id, uid, text, shared -> the pieces of text of small groups, the single windows of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("words")
        schema = pa.schema([("long", pa.bool_()), ("prefix", pa.int64()), ("second", pa.int64()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("first", pa.int32()), ("words", pa.binary())])
        for batch in batches:
            held: list[list] = [[] for _ in schema]

            def add(*columns) -> None:
                for to, column in zip(held, columns):
                    to += column

            for doc_id, uid, text, shared in zip(*(batch.column(i) for i in range(4))):
                if not shared.is_valid or not len(shared.values):
                    continue
                words = hashed(_words(text))
                prefix, first, n = runs(words, window, gram)
                known = shared.values.field(0).to_numpy()
                order = np.argsort(known)
                found = np.searchsorted(known[order], prefix)
                there = (found < len(known)) & (known[order][np.minimum(found, len(known) - 1)] == prefix)
                large = there & shared.values.field(1).to_numpy(zero_copy_only=False)[order][np.minimum(found, len(known) - 1)]
                small = np.flatnonzero(there & ~large)
                k, short = len(small), words.astype(np.uint32)
                add([False] * k, prefix[small].tolist(), [0] * k, [doc_id.as_py()] * k, [uid.as_py()] * k, first[small].tolist(), [short[a : a + m + window - 1].tobytes() for a, m in zip(first[small], n[small])])
                if large.any():
                    each = np.concatenate([np.arange(a, a + m) for a, m in zip(first[large], n[large])])
                    one, two = (rolling(words, window, b)[each].view(np.int64) for b in BASES)
                    k = len(each)
                    add([True] * k, one.tolist(), two.tolist(), [doc_id.as_py()] * k, [uid.as_py()] * k, each.tolist(), [None] * k)
                if len(held[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema)], schema=schema)
                    held = [[] for _ in schema]
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema)], schema=schema)

    return run


#: Words that count as one letter where suffixes are put in order.
LETTER = 8


def suffix_order(text: np.ndarray, at: np.ndarray, groups: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at ``at``, by group and then letter by letter, and the depth of each with the one before.

    A letter is ``LETTER`` words, the last one what is left of the window; letters are in the order of their hashes,
    as any order makes a tree. The depth is the longest common prefix in words: down to the first letter that differs
    by the letters, and inside that one word by word; suffixes of two groups have none.
    """
    starts = list(range(0, window, LETTER))
    letters = []
    for k in starts:
        width = min(LETTER, window - k)
        letters.append(rolling(text, width)[at + k])
    order = np.lexsort((*letters[::-1], groups))
    at, groups = at[order], groups[order]
    same = groups[1:] == groups[:-1]
    depth = np.zeros(len(at), np.int64)
    for k, letter in zip(starts, letters):
        letter = letter[order]
        equal = same & (letter[1:] == letter[:-1])
        # those that part in this letter have some of its words in common
        part = np.flatnonzero(same & ~equal) + 1
        left = part
        for step in range(k, min(k + LETTER, window)):
            left = left[text[at[left] + step] == text[at[left - 1] + step]]
            if not len(left):
                break
            depth[left] += 1
        depth[np.flatnonzero(equal) + 1] = min(k + LETTER, window)
        same = equal
    return order, depth


def deep_nodes(groups: np.ndarray, pieces: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves (piece, place, node) of the internal nodes of the groups' suffix trees that are a window deep or deeper.

    The tree is held as the order of its leaves and the depth at which neighbours part. A run of neighbours that part
    at a window's depth or below is the topmost node that deep, with all nodes under it: the repeats of its leaves.
    Equal letters were compared by hash; leaves of a run are compared word by word, so that a node never holds two
    different texts.
    """
    text = np.concatenate(pieces).astype(np.uint64)
    begins = np.cumsum([0, *(len(p) for p in pieces[:-1])])
    n = np.array([len(p) - window + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), n)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = begins[piece] + place
    order, depth = suffix_order(text, at, groups[piece], window)
    piece, place, at = piece[order], place[order], at[order]
    meets = np.zeros(len(at), bool)
    candidate = np.flatnonzero(depth >= window)
    for i in range(0, len(candidate), 50_000):
        c = candidate[i : i + 50_000]
        steps = np.arange(window)
        meets[c] = (text[at[c][:, None] + steps] == text[at[c - 1][:, None] + steps]).all(axis=1)
    node = np.cumsum(~meets)
    keep = meets | np.append(meets[1:], False)
    return piece[keep], place[keep], node[keep]


def _marks(window: int):
    """Rows of small groups in order of their prefix -> marked windows as (doc_id, uid, first, windows)."""

    def marked(prefix: np.ndarray, doc_id: np.ndarray, uid: np.ndarray, first: np.ndarray, pieces: list[np.ndarray]) -> pa.RecordBatch:
        piece, place, node = deep_nodes(prefix, pieces, window)
        low = np.full(int(node.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, node, doc_id[piece])
        hit = doc_id[piece] > low[node]
        piece, place = piece[hit], place[hit]
        order = np.lexsort((place, piece))
        piece, place = piece[order], place[order]
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)]) if len(piece) else np.empty(0, bool)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(piece)))
        return pa.RecordBatch.from_arrays([pa.array(doc_id[piece[at]]), pa.array(uid[piece[at]]), pa.array((first[piece[at]] + place[at]).astype(np.int64)), pa.array(n.astype(np.int64))], names=["doc_id", "uid", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.empty(0, np.int64)] * 4 + [[]]
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                now = [part.column(k).to_numpy() for k in range(4)]
                held = [np.concatenate([x, y.astype(np.int64)]) for x, y in zip(held[:4], now)] + [held[4] + [np.frombuffer(x.as_py(), np.uint32) for x in part.column(4)]]
                cut = int(np.searchsorted(-(held[0] != held[0][-1]).astype(int), 0)) if len(held[0]) else 0
                if cut:  # the last group may go on
                    yield marked(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield marked(*held)

    return run


def _kept(window: int):
    """doc_id, text, marks -> counts and the hash of the words that stay, with their text if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, texts = [], [], [], []
            for text, marks in zip(batch.column(1), batch.column(2)):
                words = _words(text)
                if marks.is_valid and len(marks.values):
                    first, n = marks.values.field(0).to_numpy(), marks.values.field(1).to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    left = [words[i] for i in np.flatnonzero(stays)]
                else:
                    left = words
                joined = b" ".join(left)
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def marked_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, uid, first, n): runs of windows of rows (doc_id, uid, text) that also start in a smaller doc_id."""
    rows = rows.select("doc_id", "uid", "text")
    prefixes = rows.where("doc_id IS NOT NULL").mapInArrow(_prefixes(window, gram), "prefix long, doc_id long, uid long, n long")
    prefixes = stored(prefixes, "prefixes")
    shared = prefixes.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n")).where("low < high")
    shared = stored(shared.select("prefix", (F.col("n") > group).alias("long")), "shared")
    wanted = prefixes.select("prefix", "doc_id", "uid").join(shared, "prefix").distinct()
    wanted = wanted.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("prefix", "long")).alias("shared"))
    wanted = stored(wanted, "wanted")
    # a left join as for the result, so that both take the same exchange of the texts
    text = F.when(F.col("shared").isNotNull(), F.col("text")).alias("text")
    cut = rows.join(wanted, ["doc_id", "uid"], "left").select("doc_id", "uid", text, "shared").mapInArrow(_snippets(window, gram), SNIPPETS)
    small = cut.where("NOT long").select("prefix", "doc_id", "uid", F.col("first").cast("long").alias("first"), "words")
    small = small.repartition("prefix").sortWithinPartitions("prefix")
    marks = small.mapInArrow(_marks(window), "doc_id long, uid long, first long, n long")
    node = F.xxhash64("prefix", "second").alias("node")
    long = stored(cut.where("long").select(node, "prefix", "second", "doc_id", "uid", F.col("first").cast("long").alias("first")), "long")
    low = long.groupBy("prefix", "second").agg(F.min("doc_id").alias("low"))
    # joined by a hash of the path alone, so that both sides are exchanged and a large node can be split
    low = low.select(F.xxhash64("prefix", "second").alias("to"), F.col("prefix").alias("p"), F.col("second").alias("s"), "low")
    same = (F.col("prefix").bitwiseXOR(F.col("p")) == 0) & (F.col("second").bitwiseXOR(F.col("s")) == 0)
    again = long.join(low, (F.col("node") == F.col("to")) & same & (F.col("doc_id") > F.col("low")))
    return marks.unionByName(again.select("doc_id", "uid", "first", F.lit(1).cast("long").alias("n")))


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of each row (see the module)."""
    if not 1 <= gram <= window:
        raise ValueError("a gram has 1 to window words")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", row_uid("doc_id", "text"))
    marks = marked_windows(rows, window, gram, group).groupBy("doc_id", "uid").agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    joined = rows.join(marks, ["doc_id", "uid"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
