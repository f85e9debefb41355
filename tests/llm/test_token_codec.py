import heapq
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import token_codec as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=1500), st.integers(6, 16))
def test_code_round_trip(ids, limit):
    ids = np.array(ids, np.int64)
    lengths = tc.code_lengths(np.bincount(ids, minlength=1), limit)
    payload, offsets = tc.pack(ids, tc.canonical_codes(lengths), lengths, 64)
    assert tc.unpack(payload, offsets, len(ids), tc.decode_table(lengths), 64).tolist() == ids.tolist()
    # a block is decoded alone from its offset
    if len(ids) > 64:
        assert tc.unpack(payload, offsets[1:], len(ids) - 64, tc.decode_table(lengths), 64).tolist() == ids[64:].tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=80))
def test_lengths_are_huffmans_where_the_limit_is_wide(counts):
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], len(counts)))
    lengths = tc.code_lengths(np.array(counts), 60)
    assert int((lengths * np.array(counts)).sum()) == cost
    short = tc.code_lengths(np.array(counts), 7)
    assert short.max() <= 7 and sum(2.0 ** -int(x) for x in short) <= 1


TEXTS = [
    None, "", " \n\t ", "It's the Word's END, isn't it?!", "a b c\x1cd e f", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> ab<|EndOfText|>", "É THE The<|endoftext|>THE!", "É́te ẹ́ ΟΔΟΣ İstanbul ﬁne 漢字かな 한국 한",
    "x" * 3000, "abc### d%%% 12,5 +1 (974) 555", "ERTIWH,!! a_b__c ''s 's 'll ''", "😀😀 word😀 ¿que? «non» naïve—dash", "The the THE the. the, " * 300,
]


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_encoder_equals_the_tokenizer():
    want = [plain().encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in tc.WordEncoder(PATH).encode([t or "" for t in TEXTS])] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=5, max_size=20))
def test_word_encoder_equals_the_tokenizer_on_any_text(texts):
    want = [plain_cached().encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder().encode(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_rules_mean_whole_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own = tc.WordEncoder(path)
    assert own.by_word == name.startswith("word")
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in own.encode([t or "" for t in TEXTS])] == want


def test_words_that_are_forgotten_are_learned_again(monkeypatch):
    monkeypatch.setattr(tc, "CACHED_WORDS", 30)
    own = tc.WordEncoder(PATH)
    for k in range(30):
        texts = [f"the the, and and; word{k} {'abc' * (k % 5)}. x{k}", t if (t := TEXTS[k % len(TEXTS)]) else "", "the and abcabc"]
        assert [x.tolist() for x in own.encode(texts)] == [plain_cached().encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.words) < 100


def test_counts_of_all_parts_are_summed(spark):
    rows = [(i, "the cat " * (i % 7 + 1)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = docs.mapInArrow(tc._tokenised(PATH, 1), tc.TOKENS)
    counts = tc.global_counts(found)
    want = np.bincount([i for _, t in rows for i in [*plain_cached().encode(t, add_special_tokens=False).ids, 1]], minlength=len(counts))
    assert counts.tolist() == want.tolist()


_kept = {}


def plain_cached():
    return _kept.setdefault("plain", _kept.get("plain") or plain())


def encoder():
    return _kept.setdefault("encoder", _kept.get("encoder") or tc.WordEncoder(PATH))


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 3 - 4, t, "x") for i, t in enumerate(TEXTS)] + [(5, "again", "x"), (5, "again", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, ids string")
    tc.write_tokens(docs, PATH, f"file://{tmp_path}/out")
    got = sorted((tuple(r) for r in tc.read_tokens(spark, f"file://{tmp_path}/out", with_ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in got if r[0] is not None] == sorted(r[0] for r in rows if r[0] is not None) and got[0][0] is None
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(plain().encode(t or "", add_special_tokens=False).ids + [1])
    at = 0
    for d, start, n, crc, ids in got:
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        want[d].remove(list(ids))
        at += n
    assert not any(want.values()) and os.path.isdir(tmp_path / "out" / "frames")


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tc.round_trip(docs, PATH).count() == 0
