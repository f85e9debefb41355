import math

import numpy as np
from pyspark.sql import functions as F

from chronofold.llm import topk


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([-0.5, 0.25, 0.1, 1.0], 8)]) for i in range(300)]
    rows += [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (401, [float("inf")] * 8), (450, []), (451, []), (500, [1.0]), (501, [2.0])]
    assert got(spark, rows, shard_rows=37, tile_rows=3, fan_in=2) == brute(rows)
    assert got(spark, rows) == brute(rows)


def test_very_large_components_stay_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 1.0])]
    assert [r[2:] for r in got(spark, rows)] == [r[2:] for r in [(0, 1, 1, min(2**63 - 1, (3 * 10**9 * 256) ** 2 + 2 * 65536)), (0, 2, 2, min(2**63 - 1, (3 * 10**9 * 256) ** 2 + 65536))]]


def test_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, shard int, score long")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert got(spark, [(0, [1.0]), (1, [1.0]), (1, [1.0])]) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]
