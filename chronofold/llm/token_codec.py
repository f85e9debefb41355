"""Token ids as a canonical, length-limited Huffman code in independent blocks.

1. Texts are ordered by doc_id (range partitions, sorted within) and encoded by the tokenizer; the end
   id follows each text. The ids go to the shared folder once, as the code needs their global counts.
2. Each task counts its ids in packed arrays, which are summed in two levels (the vocabulary's counts reach
   the driver), the code lengths come from package-merge under ``LIMIT`` bits, the codes are canonical: the lengths alone,
   written beside the data, define them.
3. Ids are written in frames of whole texts. A frame holds a bit stream, cut into blocks of ``BLOCK``
   ids, and the bit offset of each block; blocks are decoded independently of each other by table, all
   blocks of a frame side by side.

File format (Parquet as the container, so that it is written by committed, repeatable tasks on any
store): ``codebook`` has (id, length); ``frames/part=N`` has, in ascending order of ``start``, the rows
(start, doc_ids, n_tokens, offsets, payload): the number of ids before the frame, its texts' ids and
token counts, the bit offset of each block, and the stream, most significant bit first.

A tokenizer whose rules never look across white space (``encodes_by_word`` compares them) is applied to each
distinct word of a worker once; any other encodes whole texts. Texts are whole however long.

Defined results: null text counts as empty (the end id alone). A null doc_id sorts first. Rows that
repeat a doc_id are all kept, in order of their texts' hash. An empty table gives a codebook and frames
without rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import scratch, stored, worker_cache, working_for

#: Longest code, unless the vocabulary needs more.
LIMIT = 16
#: Ids of a block, and ids after which a frame ends.
BLOCK, FRAME = 256, 1 << 18
#: Distinct words that a worker holds before it forgets those met least.
CACHED_WORDS = 700_000
#: Bytes of the texts that are encoded at once.
CHUNK = 16_000_000


# the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each symbol's code (0: not used) by package-merge, optimal under the limit."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < len(weights))
    take, of_used = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        of_used[:n] += 1
        take = 2 * (take - n)
    lengths[used] = of_used
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes that the lengths define: in order of (length, symbol), each the last plus one."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    code, last = 0, 0
    for s in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next ``width`` bits."""
    width = int(lengths.max(initial=1))
    codes, symbols, sizes = canonical_codes(lengths), np.zeros(1 << width, np.int64), np.zeros(1 << width, np.int64)
    for s in np.flatnonzero(lengths):
        free = width - int(lengths[s])
        at = int(codes[s]) << free
        symbols[at : at + (1 << free)] = s
        sizes[at : at + (1 << free)] = lengths[s]
    return symbols, sizes, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit stream of the ids and the bit offset of each block."""
    sizes = lengths[ids]
    ends = np.cumsum(sizes)
    if not len(ids):
        return b"", np.empty(0, np.int64)
    starts = ends - sizes
    words = starts >> 5
    value = codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
    stream = np.zeros(int(ends[-1] >> 5) + 2, np.uint32)
    first = np.concatenate([[0], np.flatnonzero(np.diff(words)) + 1])
    stream[words[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    stream[words[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    return stream.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::block]


def unpack(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int], block: int = BLOCK) -> np.ndarray:
    """The n ids of a stream: step i decodes the i-th id of every block."""
    symbols, sizes, width = table
    words = np.frombuffer(payload + bytes(-len(payload) % 4 + 8), ">u4").astype(np.uint64)
    out = np.zeros((len(offsets), block), np.int64)
    at = offsets.astype(np.int64).copy()
    last = n - (len(offsets) - 1) * block
    for i in range(min(block, n)):
        live = len(at) if i < last else len(at) - 1
        if not live:
            break
        here = at[:live]
        w = here >> 5
        bits = ((words[w] << np.uint64(32)) | words[w + 1]) << (here & 31).astype(np.uint64)
        index = (bits >> np.uint64(64 - width)).astype(np.int64)
        out[:live, i] = symbols[index]
        at[:live] = here + sizes[index]
    return out.reshape(-1)[:n]


# the tokenizer, word by word


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n values at least, doubled by need."""
    return np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)]) if len(array) < n else array


class _WordIndex(dict):
    """word -> its number; words met for the first time are listed until they are learned."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


#: The rules under which words can be encoded apart: the tokenizer's normaliser, cuts and marks of a word's end.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "truncation": None,
}
#: Settings of the model that WORD_RULES go with.
WORD_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}


def encodes_by_word(rules: dict) -> bool:
    """Whether a tokenizer file's rules are those under which a text's ids are its words' ids, one after another."""
    marks = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in rules.get("added_tokens", ()))
    return marks and all(rules.get(k) == v for k, v in WORD_RULES.items()) and all(rules["model"].get(k) == v for k, v in WORD_MODEL.items())


class WordEncoder:
    """Ids of texts, with each distinct word encoded once by a worker.

    A word of letters with ASCII marks after it is its letters' ids and the marks', as the tokenizer always
    cuts there. A tokenizer with other rules (``encodes_by_word``) encodes whole texts.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = encodes_by_word(json.load(f))
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.words = _WordIndex()
        self.starts, self.sizes, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64)
        self.flat, self.filled = np.zeros(1 << 16, self.kind), 0

    def _forget(self) -> None:
        """Keep the half of the words that were met most, and more than once."""
        n = len(self.words)
        least = max(2, int(np.partition(self.used[:n], n // 2)[n // 2]) + 1)
        keep = np.flatnonzero(self.used[:n] >= least)
        old = list(self.words)
        flat, ends = self._gathered(keep)
        sizes, used = self.sizes[keep], self.used[keep]
        self._clear()
        self.words.update(zip([old[i] for i in keep.tolist()], range(len(keep))))
        for name, values in (("starts", ends - sizes), ("sizes", sizes), ("used", used), ("flat", flat)):
            setattr(self, name, _grown(getattr(self, name), len(values)))
            getattr(self, name)[: len(values)] = values
        self.filled = len(flat)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> list[list[int]]:
        """Words of letters only, many to a call; the ids are cut where a word ends."""
        groups = [stems[i : i + 64] for i in range(0, len(stems), 64)]
        out: list[list[int]] = []
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups])):
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
            else:
                out += self._whole(group)
        return out

    def _pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pieces: words of letters, and whatever else."""
        letters = [x for x in pieces if x.isalpha() and not x.isascii()]
        rest = [x for x in pieces if not x.isalpha()]
        # to ASCII letters no rule applies but lower case and the model's
        model = self.tokenizer.model
        of = {x: [t.id for t in model.tokenize(x.lower())] for x in pieces if x.isascii() and x.isalpha()}
        of |= dict(zip(letters, self._stems(letters)))
        of |= dict(zip(rest, self._whole(rest) if rest else ()))
        return of

    def _add(self, sizes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Note the ids of the words with these numbers, one word's after another's."""
        self.flat = _grown(self.flat, self.filled + len(ids))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.starts[at] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[at] = sizes
        self.filled += len(ids)

    def _gathered(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, and where each word's end."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes, dtype=np.int64)
        # places among the ids of a chunk's words fit 32 bits
        at = np.repeat((self.starts[index] - ends + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], ends

    def _learn(self) -> None:
        """Ids of the words that are new. Letters with marks after them take the ids of either, which are words too."""
        first, met = len(self.words) - len(self.words.new), list(self.words.new)
        marked, parts, number = [], [], self.words.__getitem__
        for i, w in enumerate(met, first):
            if not w.isalpha():
                stem = w.rstrip(self.MARKS)
                if stem and len(stem) < len(w) and stem.isalpha():
                    marked.append(i)
                    parts += (number(stem), number(w[len(stem) :]))
        new, self.words.new = self.words.new, []
        if not new:
            return
        whole = np.ones(len(new), bool)
        whole[np.array(marked, np.int64) - first] = False
        plain = np.flatnonzero(whole)
        self.starts, self.sizes, self.used = (_grown(x, len(self.words)) for x in (self.starts, self.sizes, self.used))
        of = self._pieces([new[i] for i in plain.tolist()])
        found = [of[new[i]] for i in plain.tolist()]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        self._add(sizes, np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), plain + first)
        if marked:
            ids, ends = self._gathered(np.array(parts))
            self._add(np.diff(ends[1::2], prepend=0).astype(np.int32), ids, np.array(marked))

    def encode(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return [np.array(x, self.kind) for x in self._whole(texts.to_pylist())]
        if len(self.words) > CACHED_WORDS:
            self._forget()
        # what stands between ASCII white space, with empty words at the texts' edges, which have no ids
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        own = np.fromiter(map(self.words.__getitem__, words.dictionary.to_pylist()), np.int32, len(words.dictionary))
        self._learn()
        index = own[words.indices.to_numpy()]
        self.used[: len(self.words)] += np.bincount(index, minlength=len(self.words))
        ids, ends = self._gathered(index)
        # where each text's words end, in words and so in ids
        cut = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


_encoders: dict[str, WordEncoder] = {}
worker_cache("tokens", lambda: _encoders.clear())


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# the jobs

#: Ids of which the counts make one row.
COUNTED = 1024
#: Texts with their ids; after them each part has, in place of texts, rows with the counts of ``COUNTED`` ids each.
TOKENS = "part int, doc_id long, local long, n long, ids binary, chunk int, counts binary"
_TOKENS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
FRAMES = "part int, start long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("tokens")
        part, before, encoder = TaskContext.get().partitionId(), 0, _encoder(path)
        size = max(encoder.size, end_id + 1)
        counts = np.zeros(-(-size // COUNTED) * COUNTED, np.int64)
        end = np.array([end_id], "<u2" if size <= 1 << 16 else "<u4")
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).fill_null("")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK)))
                ids = [np.concatenate([x.astype(end.dtype, copy=False), end]) for x in encoder.encode(texts.slice(i, j - i))]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                local = before + np.cumsum(n) - n
                before += int(n.sum())
                counts += np.bincount(np.concatenate(ids), minlength=len(counts))
                own = [pa.array(np.full(len(ids), part, np.int32)), doc_ids[i:j], pa.array(local), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(ids), t) for t in _TOKENS.types[5:])], schema=_TOKENS)
                i = j
        blocks = counts.reshape(-1, COUNTED)
        used = np.flatnonzero(blocks.any(axis=1))
        own = [pa.array(used.astype(np.int32)), pa.array([blocks[k].astype("<i8").tobytes() for k in used], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), *(pa.nulls(len(used), t) for t in _TOKENS.types[1:5]), *own], schema=_TOKENS)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, counts) -> one row for each chunk of the task, with the sum of its counts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def global_counts(found: DataFrame) -> np.ndarray:
    """How often each id occurs, from the parts' count rows: summed by chunk and a 64th of the parts, then by chunk."""
    schema = "chunk int, counts binary"
    rows = found.where("chunk IS NOT NULL").withColumn("of", F.pmod("part", F.lit(64)))
    some = rows.repartition("chunk", "of").select("chunk", "counts").mapInArrow(_summed, schema)
    # what reaches the driver is the vocabulary's counts, whatever the corpus
    total = {r["chunk"]: np.frombuffer(r["counts"], "<i8") for r in some.repartition("chunk").mapInArrow(_summed, schema).collect()}
    counts = np.zeros((max(total, default=-1) + 1, COUNTED), np.int64)
    for chunk, part in total.items():
        counts[chunk] = part
    return counts.reshape(-1)


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype(np.int64)


def _framed(lengths: np.ndarray, before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for()
        codes = canonical_codes(lengths)
        held: list[tuple[int, int, int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids = np.concatenate([x[3] for x in held])
                payload, offsets = pack(ids, codes, lengths)
                part, start = held[0][0], before[held[0][0]] + held[0][1]
                row = {"part": part, "start": start, "doc_ids": [x[2] for x in held], "n_tokens": [len(x[3]) for x in held], "offsets": offsets.tolist(), "payload": payload}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]))
                held.clear()

        size = 0
        for batch in batches:
            for part, doc_id, local, n, blob in zip(*(batch.column(i) for i in range(5))):
                part, local, n = part.as_py(), local.as_py(), n.as_py()
                follows = held and held[-1][0] == part and held[-1][1] + len(held[-1][3]) == local
                if held and (not follows or size + n > FRAME):
                    yield from flush()
                if not held:
                    size = 0
                held.append((part, local, doc_id.as_py(), _ids(blob.as_py(), n)))
                size += n
        yield from flush()

    return run


def _read(lengths: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for()
        table = decode_table(lengths)
        for batch in batches:
            for start, doc_ids, n_tokens, offsets, payload in zip(*(batch.column(i) for i in range(5))):
                sizes = n_tokens.values.to_numpy()
                ids = unpack(payload.as_py(), offsets.values.to_numpy(), int(sizes.sum()), table).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                out = [doc_ids.values, pa.array(start.as_py() + starts), pa.array(sizes), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def write_tokens(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, limit: int = LIMIT) -> None:
    """Write the files of documents(doc_id, text) below path (see the module)."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # by the texts' hash too, so that a repeated doc_id is cut as well
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(_tokenised(tokenizer_path, end_id), TOKENS), "tokens")
    tokens = found.where("chunk IS NULL").drop("chunk", "counts")
    # one row per partition reaches the driver
    parts = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for part, n in parts:
        before[part], total = total, total + n
    lengths = code_lengths(global_counts(found), limit)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id long, length int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    frames = tokens.mapInArrow(_framed(lengths, before), FRAMES)
    frames.write.mode("overwrite").partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/frames")


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each text, decoded from the files below path; ids too if asked."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=-1) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames").select("start", "doc_ids", "n_tokens", "offsets", "payload")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return frames.mapInArrow(_read(lengths, with_ids), schema)


def round_trip(documents: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files (below a path of their own in the shared folder, if none is given) and read them back."""
    spark = documents.sparkSession
    path = path or scratch(spark, "token-files")
    write_tokens(documents, tokenizer_path, path, end_id)
    return read_tokens(spark, path)
