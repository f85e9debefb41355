"""SimHash near-duplicates found through Golay-code keys.

A text's fingerprint has 64 bits: bit b is 1 if it is set in over half of the hashes (XXH64, seed 42)
of the text's word shingles. Two fingerprints link at ``max_distance`` (4) or fewer differing bits; the
classes are the connected components of the links.

Candidates. The fingerprint is cut into segments of 23, 23 and 18 bits. Each is a word of the perfect
binary Golay code [23, 12, 7] (the last one padded with zeros): every word lies within 3 bits of exactly
one codeword, D(x). K(x) are the codewords that x or a word one bit from x decodes to (6 at most); two
words that differ in up to 2 bits share one of them, as the word between them is one bit from both.

By the pigeonhole, 4 errors in three segments leave two segments with 2 errors between them at most:
(2, 0), (0, 2), (1, 1) or fewer. So for each pair of segments (i, j) a fingerprint gets the keys
{(a, D_j) : a in K_i} and {(D_i, b) : b in K_j}, 24 bits each. (2, 0): the pair shares (a, D_j). (1, 1):
D_i(y) is in K_i(x) and D_j(x) in K_j(y), so both hold (D_i(y), D_j(x)). No pair within 4 bits is lost.

Work. Equal fingerprints are one candidate, represented by their smallest doc_id, so that copies cost
nothing. Members of a key's bucket are compared by their bits (verification); a bucket emits a spanning
forest of its links, never all its pairs. Buckets beyond ``TILE`` members are cut into tiles by a hash
and compared tile by tile, all tiles with all, which is exact. Components are found by alternating large-
and small-star steps over tables in the shared folder.

Defined results: a text without words has the fingerprint zero and links like any other; null text counts
as empty. A null doc_id gets its fingerprint and the component of its equals and neighbours, null if all
are null, and never becomes a component's name. Repeated rows give repeated results. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import give_back, stored, working_for
from chronofold.llm.substring_dedup import rolling

MAX_DISTANCE = 4
#: Members of a bucket that are compared in one piece.
TILE = 2048
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0xAE3


# fingerprints


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit fingerprint of a text's shingles of so many words, lower-cased in ASCII."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(tokens) - words + 1))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row, in the shared folder."""
    return stored(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long"), "fingerprints")


# Golay keys


def _remainders() -> np.ndarray:
    """Remainder by the generator of each value of the upper 12 of 23 bits."""
    out = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _syndrome(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[words >> 11] ^ (words & 2047)


class Golay:
    """Decodes words of 23 bits to the index (12 bits) of the only codeword within 3 bits."""

    def __init__(self) -> None:
        self.table = _remainders()
        patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
        self.errors = np.zeros(2048, np.int64)
        self.errors[_syndrome(patterns, self.table)] = patterns

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[_syndrome(words, self.table)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """For each word, the indices of itself and of the words one of the bits away; repeats are -1."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (uint64); rows ascend within each pair of segments."""
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    nearest = [golay.index(p) for p in parts]
    near = [golay.near(p, bits) for p, (_, bits) in zip(parts, SEGMENTS)]
    rows, keys = [], []
    for n, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        left = np.where(near[i] < 0, -1, near[i] << 12 | nearest[j][:, None])
        # (D_i, D_j) is in both sets: it is taken from the first
        right = np.where((near[j] < 0) | (near[j] == nearest[j][:, None]), -1, nearest[i][:, None] << 12 | near[j])
        both = np.concatenate([left, right], axis=1)
        row, column = np.nonzero(both >= 0)
        rows.append(row)
        keys.append(both[row, column] | n << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and representative -> a row for each key."""
    golay = Golay()
    for batch in batches:
        fps, reps = (batch.column(i).to_numpy() for i in range(2))
        for i in range(0, len(fps), 20_000):
            row, key = keys_of(fps[i : i + 20_000].view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + 20_000][row]), pa.array(reps[i : i + 20_000][row])], names=["key", "fp", "rep"])


# links


def forest(fps: np.ndarray, max_distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the links between the fingerprints of one bucket, as positions."""
    left, out_a, out_b = np.arange(len(fps)), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            linked = np.bitwise_count(fps[left] ^ fps[at]) <= max_distance
            if linked.any():
                new = left[linked]
                out_a.append(np.full(len(new), at))
                out_b.append(new)
                queue += new.tolist()
                left = left[~linked]
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _links(max_distance: int):
    """Sorted rows (bucket, fp, rep) of one partition -> links (a, b) between representatives."""

    def found(bucket: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(bucket)))
        a, b = [], []
        # small buckets side by side: the rows d places apart in one bucket
        small = np.repeat(sizes <= 8, sizes)
        group = np.cumsum(new)
        for d in range(1, 8):
            i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else np.empty(0, np.int64)
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_distance]
            a.append(i)
            b.append(i + d)
        for at, n in zip(first[sizes > 8], sizes[sizes > 8]):
            x, y = forest(fps[at : at + n], max_distance)
            a.append(at + x)
            b.append(at + y)
        pairs = np.unique(np.sort(np.stack([reps[np.concatenate(a)], reps[np.concatenate(b)]], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0, 3), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            now = [np.stack(columns[:3], axis=1), columns[3].view(np.uint64), columns[4]]
            held = [np.concatenate([x, y]) for x, y in zip(held, now)]
            if len(held[0]):  # the last bucket may go on
                cut = len(held[0]) - int(np.argmax((held[0] != held[0][-1]).any(axis=1)[::-1])) if (held[0] != held[0][-1]).any() else 0
                if cut:
                    yield found(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield found(*held)

    return run


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints (fp, rep); they connect all that are near."""
    keyed = distinct.where("rep IS NOT NULL").mapInArrow(_keyed, "key long, fp long, rep long")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    rows = keyed.join(large, "key", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a tile meets itself and every other tile of its bucket
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("own", "other").cast("long").alias("t1"), F.greatest("own", "other").cast("long").alias("t2"), "fp", "rep")
    near = rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").mapInArrow(_links(max_distance), "a long, b long")
    return near.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, of all nodes with a link, by alternating star steps."""
    edges = stored(edges.where("a <> b"), "links")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u points to the smallest node around u
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        # small star: u and its smaller neighbours point to the smallest of them
        least = stored(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        small = small.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(small, "small")
        # the links as a whole no longer change: compared by count and sums of hashes
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(documents: DataFrame, words: int = 4, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row (see the module)."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the keys are complete up to {MAX_DISTANCE} differing bits")
    fps = fingerprints(documents, words)
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct, max_distance))
    classes = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    classes = stored(classes, "classes")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# classes of similar texts

#: One text of so many is read for the order of the shingles; in these texts a common one occurs so often; the list's length. They change the work, never the result.
SAMPLED, OFTEN, COMMON = 16, 3, 100_000
#: Members of a bucket that are all proposed to each other at once, and in which links are grown by estimate.
SMALL, GROWN = 8, 256
#: Members of a bucket's tile; a shingle that is expected in more texts than the second is spread over tasks from the start.
PIECE, HOT = 512, 4096
#: Power of two of the bits that say which texts are in a candidate pair, and of those of a text's parities.
BITMAP, PARITY = 22, 10
SHINGLE = (1 << 40) - 1


def signature(text: str | None, words: int = 5) -> tuple[int, bytes]:
    """A 128-bit digest of the whole text's words, and the hashes of its distinct shingles (40 bits, as uint64, sorted)."""
    tokens = (text or "").encode().lower().split()
    whole = xxhash.xxh3_128_intdigest(b" ".join(tokens), 1)
    if not tokens:
        return whole, b""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t, 42) for t in tokens), np.uint64, len(tokens))
    return whole, np.unique(rolling(hashes, min(words, len(tokens))) >> np.uint64(24)).tobytes()


def packed(shingles: bytes) -> bytes:
    """Five bytes for each hash."""
    return np.frombuffer(shingles, np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(shingles: bytes) -> np.ndarray:
    out = np.zeros((len(shingles) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(shingles, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct shingles that two texts have in common."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each value of the last bits of a hash, whether the set holds an odd number of such hashes.

    Each shingle that only one of two sets has turns one bit, so the parities differ in no more bits than the sets
    in shingles: what is proven to differ too much needs no comparison.
    """
    low = (shingles & np.uint64((1 << PARITY) - 1)).astype(np.int64)
    return np.packbits(np.bincount(low, minlength=1 << PARITY) & 1, bitorder="little").view("<u8")


def _signed64(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working_for()
    for batch in batches:
        found = [xxhash.xxh3_128_intdigest(b" ".join((t.as_py() or "").encode().lower().split()), 1) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed64([f >> 64 for f in found]), _signed64([f & (1 << 64) - 1 for f in found])], names=["uid", "doc_id", "high", "low"])


def _sets(words: int, repeated):
    """Texts -> digest, fingerprint, shingles, and whether another row may have the digest too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                texts = [t.as_py() for t in batch.column(0).slice(i, 1000)]
                found = [signature(t, words) for t in texts]
                high, low = (_signed64(x) for x in ([f[0] >> 64 for f in found], [f[0] & (1 << 64) - 1 for f in found]))
                again = _marked(repeated.value, low.to_numpy() & ((1 << BITMAP) - 1))
                fps = _signed64([fingerprint(t) for t in texts])
                yield pa.RecordBatch.from_arrays([high, low, fps, pa.array([packed(f[1]) for f in found], pa.binary()), pa.array(again)], names=["high", "low", "fp", "shingles", "again"])
        give_back()

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(x.as_py()).view(np.int64))], names=["h"])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of the texts, the rarest first, and in how many texts each is expected."""
    sample = texts.where(F.pmod(F.xxhash64("whole"), F.lit(SAMPLED)) == 0).select("shingles").mapInArrow(_exploded, "h long")
    counted = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    rows = counted.orderBy(F.desc("n"), "h").limit(COMMON).collect()[::-1]
    return np.array([r["h"] for r in rows], np.int64).astype(np.uint64), np.array([r["n"] for r in rows], np.int64) * SAMPLED


def _prefixes(common, similarity: float):
    """whole, shingles -> a row for each shingle of the text's prefix in the order of shingles, with its place.

    Rows of a shingle that is expected in very many texts bear a part of the text's number above the 40 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, expected = common.value
        rank = np.argsort(shingles)
        values, parts = shingles[rank], -(-expected[rank] // HOT)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                hashes, sizes, places, reps = [], [], [], []
                for rep, packed_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = unpacked(packed_)
                    n = len(own)
                    if not n:
                        continue
                    k = n - math.ceil(similarity * n - 1e-9) + 1
                    if len(values):  # others by hash, then the common ones by frequency
                        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                        known = values[at] == own
                        first = np.argsort(np.where(known, rank[at], -1), kind="stable")[:k]
                        spread = np.where(known & (parts[at] > 1), 1 + rep % parts[at], 0)[first].astype(np.uint64)
                        own = own[first] | spread << np.uint64(40)
                    hashes.append(own[:k])
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
                    reps.append(np.full(k, rep))
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([h.view(np.int64) for h in hashes], sizes, places, reps)], names=["h", "n", "place", "rep"])

    return run


def _may(n, place, i, j, similarity: float) -> np.ndarray:
    """Whether texts that meet at these places for the first time can share enough shingles."""
    needed = np.ceil((n[i] + n[j]) * (similarity / (1 + similarity)) - 1e-6)
    return np.minimum(n[i] - place[i], n[j] - place[j]) >= needed


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut between values of the first one."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or held and held[-1][0][-1] != now[0][0]:
            held.append([x[:cut] for x in now])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _pairs(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.sort(np.stack([rep[a], rep[b]], axis=1), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _met(similarity: float):
    """Sorted rows (h, n, place, rep) -> all pairs (a, b) of small buckets, and the rows of the others again with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, place, rep in _buckets(batches):
            new = np.append(True, h[1:] != h[:-1])
            sizes = np.diff(np.append(np.flatnonzero(new), len(h)))
            group, small = np.cumsum(new), np.repeat(sizes <= SMALL, sizes) & (h <= SHINGLE)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d in range(1, SMALL):
                i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else np.empty(0, np.int64)
                a.append(i)
                b.append(i + d)
            a, b = np.concatenate(a), np.concatenate(b)
            may = _may(n, place, a, b, similarity)
            pairs = _pairs(rep, a[may], b[may])
            yield pa.RecordBatch.from_arrays([*pairs.columns, *(pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "h", "n", "place"])
            rest = np.flatnonzero(~small)
            yield pa.RecordBatch.from_arrays([pa.array(rep[rest]), pa.nulls(len(rest), pa.int64()), pa.array(h[rest] & SHINGLE), pa.array(n[rest]), pa.array(place[rest])], names=["a", "b", "h", "n", "place"])

    return run


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parities(unpacked(x.as_py())).tobytes() for x in batch.column(1)], pa.binary())], names=["whole", "parity"])


def _differing(parity: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(parity[others] ^ parity[i]).sum(axis=1, dtype=np.int64)


def likely(n: np.ndarray, parity: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions, of the links that the parities of the members of one bucket make likely."""
    bits, left, out_a, out_b = 1 << PARITY, np.arange(len(n)), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            # of d differing shingles about bits (1 - e^(-2 d / bits)) / 2 parities differ
            free = 1 - 2 * _differing(parity, at, left) / bits
            apart = np.where(free > 0.02, -bits / 2 * np.log(np.maximum(free, 0.02)), np.inf)
            both = n[left] + n[at]
            linked = both - apart >= similarity * (both + apart)
            if linked.any():
                out_a.append(np.full(int(linked.sum()), at))
                out_b.append(left[linked])
                queue += left[linked].tolist()
                left = left[~linked]
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _grown(similarity: float):
    """Sorted rows (bucket, n, rep, parity) -> for each bucket a forest of likely links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, n, rep, parity in _buckets(batches):
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            bits, a, b = np.frombuffer(b"".join(parity), "<u8").reshape(len(n), -1), [], []
            for at, end in zip(first.tolist(), np.append(first[1:], len(n)).tolist()):
                x, y = likely(n[at:end], bits[at:end], similarity)
                a.append(at + x)
                b.append(at + y)
            yield _pairs(rep, np.concatenate(a), np.concatenate(b))

    return run


def _left(n, place, own, component, parity, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): the pairs of one bucket, or of two of its tiles, that are in no class together and may be similar."""
    names, which, counts = np.unique(component, return_inverse=True, return_counts=True)
    # the largest class comes last: only the others look for partners
    order = np.argsort(counts[which] * len(names) + which, kind="stable")
    classes, two = which[order], own.min() != own.max()
    for i in range(len(order) - int(counts.max())):
        j = np.flatnonzero((classes[i + 1 :] != classes[i]) & ((own[order[i + 1 :]] != own[order[i]]) | (not two))) + i + 1
        x, y = np.full(len(j), order[i]), order[j]
        may = _may(n, place, x, y, similarity)
        x, y = x[may], y[may]
        if len(y):
            both = n[x] + n[y]
            may = _differing(parity, int(order[i]), y) <= both - 2 * np.ceil(both * (similarity / (1 + similarity)) - 1e-6)
            yield x[may], y[may]


def _rest(similarity: float):
    """Sorted rows (bucket, own, n, place, rep, component, parity) -> the pairs (a, b) that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own, n, place, rep, component, parity in _buckets(batches):
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            bits, held, rows = np.frombuffer(b"".join(parity), "<u8").reshape(len(n), -1), [], 0
            for at, end in zip(first.tolist(), np.append(first[1:], len(n)).tolist()):
                for a, b in _left(*(x[at:end] for x in (n, place, own, component, bits)), similarity):
                    held.append((at + a, at + b))
                    rows += len(a)
                    if rows > 500_000:
                        yield _pairs(rep, *(np.concatenate(x) for x in zip(*held)))
                        held, rows = [], 0
            if held:
                yield _pairs(rep, *(np.concatenate(x) for x in zip(*held)))

    return run


def _marks(low: DataFrame) -> np.ndarray:
    """The values of the only column, 0 to 2^BITMAP - 1, as a bitmap."""
    low = low.toDF("low").select((F.col("low") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(low & 63 AS int))").alias("bit"))
    bits = np.zeros((1 << BITMAP) // 64, np.int64)
    for r in low.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    return bits


def _marked(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (bits[low >> 6] >> (low & 63) & 1).astype(bool)


def _in_pairs(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for()
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(_marked(bits.value, batch.column(2).to_numpy())))
        give_back()

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [resemblance(unpacked(x.as_py()), unpacked(y.as_py())) >= similarity for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return run


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts (whole, shingles) that share enough of their whole sets of shingles."""
    spark = texts.sparkSession
    low = lambda c: F.xxhash64(c).bitwiseAND((1 << BITMAP) - 1)
    bits = _marks(pairs.select(F.explode(F.array("a", "b")).alias("id")).select(low("id")))
    # a fixed bitmap keeps most texts that are in no pair out of the joins; the joins drop the rest
    met = texts.select("whole", "shingles", low("whole").alias("low")).mapInArrow(_in_pairs(spark.sparkContext.broadcast(bits)), "whole long, shingles binary")
    both = pairs.join(met.select(F.col("whole").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(met.select(F.col("whole").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_verified(similarity), "a long, b long"), "similar")


def fingerprint_links(texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of texts (whole, fp, shingles): found within 4 bits by the Golay keys, then held against the shingles.

    Of equal fingerprints each text is tried with the first one; of others the spanning forests of links().
    """
    distinct = stored(texts.groupBy("fp").agg(F.min("whole").alias("rep")), "distinct")
    same = texts.select("fp", "whole").join(distinct, "fp").where("whole <> rep").select(F.col("rep").alias("a"), F.col("whole").alias("b"))
    return similar(stored(links(distinct).unionByName(same), "near"), texts, similarity)


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in no class (node, component) together."""
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}")), c, "left")
    return pairs.where("NOT coalesce(class_a = class_b, false)").select("a", "b")


def _edges(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("node").alias("a"), F.col("component").alias("b"))


def similar_texts(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of all texts (whole, fp, shingles) that are similar to another, directly or through others."""
    spark = texts.sparkSession
    near = stored(components(fingerprint_links(texts, similarity)), "near_classes")
    common = spark.sparkContext.broadcast(common_shingles(texts))
    keyed = texts.select("whole", "shingles").mapInArrow(_prefixes(common, similarity), "h long, n int, place int, rep long")
    rows = keyed.repartition("h").sortWithinPartitions("h", "n", "rep")
    first = stored(rows.mapInArrow(_met(similarity), "a long, b long, h long, n int, place int"), "first")
    pairs, large = first.where("b IS NOT NULL").select("a", "b"), first.where("b IS NULL").select("h", "n", "place", F.col("a").alias("rep"))
    sizes = large.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    large = stored(large.join(sizes, "h"), "large")
    # parities are joined last, so that they move as seldom as can be
    parity = stored(texts.select("whole", "shingles").mapInArrow(_parity_rows, "whole long, parity binary"), "parities")
    with_parity = lambda df: df.join(parity, F.col("rep") == F.col("whole")).drop("whole")
    # links that are likely, grown in parts of the buckets; other shingles cut the same texts into other parts
    part = F.xxhash64("h", F.pmod(F.xxhash64("h", "rep"), F.ceil(F.col("size") / GROWN))).alias("bucket")
    rows = with_parity(large.select(part, "n", "rep")).repartition("bucket").sortWithinPartitions("bucket", "n", "rep")
    pairs = pairs.unionByName(rows.select("bucket", "n", "rep", "parity").mapInArrow(_grown(similarity), "a long, b long")).distinct()
    # what the fingerprints have put into one class is not compared again
    pairs = stored(apart(pairs, near), "pairs")
    found = stored(components(_edges(near).unionByName(similar(pairs, texts, similarity))), "classes")
    # then all pairs of a bucket that the links have not put into one class, tile by tile
    known = large.join(found, large["rep"] == found["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    known = stored(known, "known")
    several = known.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("h")
    rows = known.join(several, "h").withColumn("tiles", F.ceil(F.col("size") / PIECE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    bucket = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("bucket")
    rows = with_parity(rows.select(bucket, "own", "n", "place", "rep", "component")).repartition("bucket").sortWithinPartitions("bucket", "n", "rep")
    rows = rows.select("bucket", "own", "n", "place", "rep", "component", "parity")
    more = stored(rows.mapInArrow(_rest(similarity), "a long, b long").distinct(), "more")
    return components(_edges(found).unionByName(similar(more, texts, similarity)))


def one_of_each(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of documents that stay when one of each class of similar texts does: the smallest doc_id.

    Similar texts share ``similarity`` of their distinct shingles of ``words`` words; classes are the connected
    components. SimHash comes first: fingerprints within 4 bits meet by their Golay keys, as in near_duplicates(), and
    link if their texts' whole sets have that similarity (many repeats of one line bring fingerprints of other texts
    together). At 0.8 fingerprints differ in about 10 bits, so a prefix filter then finds the similar pairs that are
    in no class yet: in any one order of all shingles, two sets of n and m with that much in common share one of the
    first n - ceil(similarity * n) + 1 of either, or else too few are left. The order puts the shingles last that are common in a sample of the texts, so that a repeated line does not bring
    its texts together. Texts meet in the buckets of these shingles if their sizes and places there allow the
    similarity, and link if their whole sets have it: no pair is lost. In large buckets a forest of the links that
    the parities of the sets make likely is tried first, and then all pairs whose members the links have not put
    into one class, but for those that the parities prove to differ too much. Equal texts are one candidate.

    Null texts count as empty; texts without words are copies of each other. Null doc_ids come last; of rows that
    are equal in doc_id and text one stays. An empty table gives no rows. All columns are kept, whatever their names.
    """
    rows = documents.toDF(*(f"doc_column_{k}" for k in range(len(documents.columns))))  # no name of the caller's meets one of ours
    doc_id, text = (F.col(f"doc_column_{documents.columns.index(c)}") for c in ("doc_id", "text"))
    uid = F.xxhash64(doc_id, text)
    signed = stored(rows.select(uid.alias("uid"), doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_wholes, "uid long, doc_id long, high long, low long"), "signatures")
    # a fixed bitmap of the digests that more rows have: only texts that it marks move to be told from their copies
    again = signed.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = documents.sparkSession.sparkContext.broadcast(_marks(again.select(F.col("low").bitwiseAND((1 << BITMAP) - 1))))
    sets = rows.select(text.alias("text")).mapInArrow(_sets(words, repeated), "high long, low long, fp long, shingles binary, again boolean")
    sets = stored(sets.withColumn("whole", F.monotonically_increasing_id()), "sets")
    once = sets.where("again").groupBy("high", "low").agg(*(F.min(c).alias(c) for c in ("fp", "shingles", "whole")))
    texts = sets.where("NOT again").drop("again").unionByName(stored(once, "once"))
    found = similar_texts(texts.select("whole", "fp", "shingles"), similarity)
    classes = texts.select("high", "low", "whole").join(found, F.col("whole") == F.col("node"), "left")
    classes = signed.join(classes.select("high", "low", F.coalesce("component", "whole").alias("class")), ["high", "low"])
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("first"))
    stays = stored(first.select(F.col("first.uid").alias("kept_uid"), F.col("first.doc_id").alias("kept_doc_id")), "stays")
    copies = F.row_number().over(Window.partitionBy(doc_id, "row_uid").orderBy(F.lit(1)))
    rows = rows.withColumn("row_uid", uid)
    kept = rows.join(stays, (F.col("row_uid") == F.col("kept_uid")) & doc_id.cast("long").eqNullSafe(F.col("kept_doc_id")), "left_semi")
    return kept.withColumn("copy", copies).where("copy = 1").drop("row_uid", "copy").toDF(*documents.columns)
