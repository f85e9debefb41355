import hashlib

import numpy as np
import pytest

from chronofold.llm import substring_dedup as sd


def brute(rows, window=50):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for p in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[p : p + window])] < d:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" for i in range(40)]
    passage = [" ".join(rng.choice(words, n)) for n in (49, 50, 51, 80, 200)]
    out = [None, "", " \n\t", "from " * 130, "from " * 70, "a b"]
    for i in range(60):
        parts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(3)]
        for k in range(int(rng.integers(0, 4))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), passage[int(rng.integers(5))])
        out.append("\n".join(parts))
    return [*out, out[10], out[20] + " x", passage[4] * 3]


@pytest.mark.parametrize("group", [50_000, 30])
def test_matches_brute_force(spark, group):
    rng = np.random.default_rng(2)
    t = texts(1)
    ids = rng.permutation(len(t)).tolist()
    rows = [*zip(ids, t), (None, t[12]), (5, t[13]), (5, t[13]), (7, t[14])]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, first int")
    got = sorted((tuple(r)[:4] for r in sd.dedup(docs, group=group).collect()), key=str)
    assert got == brute(rows)
    assert any(r[2] for r in got)


def test_short_windows(spark):
    rows = [(2, "a b c d e"), (1, "x b c d y"), (3, "b c d b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in sd.dedup(docs, window=3, gram=2).collect()), key=str)
    assert got == brute(rows, 3)
    assert {r["doc_id"]: r["kept"] for r in sd.dedup(docs, window=3, gram=2).collect()} == {1: "x b c d y", 2: "a e", 3: ""}


def test_sliding_min_and_rolling():
    rng = np.random.default_rng(4)
    for n, w in ((1, 1), (5, 5), (100, 7), (83, 41)):
        v = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        assert sd.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(n - w + 1)]
    a = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    assert sd.rolling(np.concatenate([a, a]), 20)[:41].tolist() == sd.rolling(np.concatenate([a, a]), 20)[60:].tolist()


def test_empty(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_and_depths():
    rng = np.random.default_rng(3)
    for window in (1, 3, 8, 13, 50):
        text = rng.integers(0, 3, 400).astype(np.uint64)
        text[200:300] = text[50:150]
        at = np.arange(len(text) - window + 1)
        groups = rng.integers(0, 2, len(at))
        order, depth = sd.suffix_order(text, at, groups, window)
        assert sorted(order.tolist()) == at.tolist() and (np.diff(groups[order]) >= 0).all()
        paths = [tuple(text[i : i + window].tolist()) for i in order]
        for k in range(1, len(order)):
            common = next((d for d in range(window) if paths[k][d] != paths[k - 1][d]), window) if groups[order[k]] == groups[order[k - 1]] else 0
            assert depth[k] == common
        # leaves that share their first letters stand together, so that each node is one run
        for d in range(sd.LETTER, window + 1, sd.LETTER):
            heads = [(groups[i], p[:d]) for i, p in zip(order, paths)]
            assert len({*heads}) == 1 + sum(a != b for a, b in zip(heads, heads[1:]))
