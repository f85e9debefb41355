"""Exact top-k by integer inner product: tiled matrix products, partial selection, tree merging.

Vectors are quantised to floor(scale * x). The base is cut into shards of at most ``shard_rows`` rows
and the queries into tiles of ``tile_rows``; a task holds one shard and streams the query tiles past
it, so its memory is one shard, one tile and their product. Each tile keeps k candidates per query by
partial selection; the lists of a query then merge in a tree: first within a bundle of ``fan_in``
shards, then across bundles.

The query set is a stated share of the table, so the work is queries x rows, in blocks; what is
shuffled is the queries once per shard.

Defined results: vectors that are null, hold a null or a non-finite component take no part. Only
vectors of equal length are compared (empty ones score 0). Rows that repeat an id are ranked one by
one, and a row is never its own candidate by id. Ties go to the smaller id. Scores beyond the range
of a long are clamped to it. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Above this, sums of products may leave the integers that a double holds exactly.
EXACT = 2**53
LONG = 2**63 - 1
#: Rows of a shard where none are given: a 256th of the table between these bounds, so that a task's memory is bounded.
MIN_SHARD, MAX_SHARD = 512, 65536


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as doubles, null for a vector that takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: _floor(x, scale)))


def _floor(x: Column, scale: int) -> Column:
    """floor as a double: F.floor gives a long, too small for the largest floats."""
    y = x.cast("double") * F.lit(float(scale))
    return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)


def _products(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Integer inner products, through doubles where they are exact and Python integers elsewhere."""
    bound = (np.abs(queries).max(initial=0.0)) * (np.abs(base).max(initial=0.0)) * max(1, queries.shape[1])
    if bound < EXACT:
        return (queries @ base.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], dtype=object).reshape(queries.shape)
    other = np.array([[int(x) for x in row] for row in base], dtype=object).reshape(base.shape)
    exact = np.array([[sum(a * b for a, b in zip(q, v)) for v in other] for q in whole], dtype=object).reshape(len(whole), len(other))
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def select_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (query, id, score) of a tile by partial selection; ties at the cut go to the smaller id."""
    if not len(query_ids) or not len(ids):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    scores = _products(queries, base)  # base is in order of id, so position breaks ties
    own = query_ids[:, None] == ids[None, :]
    keep = min(k, len(ids))
    out_q, out_v, out_s = [], [], []
    for i, row in enumerate(scores):
        there = np.flatnonzero(~own[i])
        row = row[there]
        if len(row) > keep:
            cut = np.partition(row, len(row) - keep)[len(row) - keep]
            above = np.flatnonzero(row > cut)
            best = np.concatenate([above, np.flatnonzero(row == cut)[: keep - len(above)]])
        else:
            best = np.arange(len(row))
        out_q.append(np.full(len(best), query_ids[i]))
        out_v.append(ids[there[best]])
        out_s.append(row[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _stream(k: int, tile_rows: int):
    """Rows of one partition in order of (dim, shard, role, id): a shard's base first, then the queries past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, tile = None, ([], []), ([], [])
        held: tuple[np.ndarray, np.ndarray] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tile
            if not tile[0]:
                return
            dim, shard = now
            if held is None:
                order = np.argsort(np.array(base[0], np.int64), kind="stable")
                held = np.array(base[0], np.int64)[order], np.array(base[1], float).reshape(len(base[0]), dim)[order]
            q, v, s = select_tile(np.array(tile[0], np.int64), np.array(tile[1], float).reshape(len(tile[0]), dim), *held, k)
            tile = ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(np.full(len(q), shard, np.int64))], names=["query_id", "vec_id", "score", "shard"])

        for batch in batches:
            dims, shards, roles, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat = batch.column(4)
            for i in range(batch.num_rows):
                if now != (dims[i], shards[i]):
                    yield from flush()
                    now, base, tile, held = (int(dims[i]), int(shards[i])), ([], []), ([], []), None
                to = tile if roles[i] else base
                to[0].append(ids[i])
                to[1].append(flat[i].values.to_numpy(zero_copy_only=False))
                if len(tile[0]) >= tile_rows:
                    yield from flush()
        if now is not None:
            yield from flush()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int | None = None, tile_rows: int = 256, fan_in: int = 16) -> DataFrame:
    """Each query's k best other rows: query_id, rank from 1, vec_id, score. See the module for defined results."""
    if k < 1 or (shard_rows is not None and shard_rows < 1) or tile_rows < 1:
        raise ValueError("k, shard_rows and tile_rows must be positive")
    n = vectors.count()
    shard_rows = shard_rows or min(MAX_SHARD, max(MIN_SHARD, n // 256))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).withColumn("dim", F.size("v"))
    shards = max(1, -(-n // shard_rows))
    base = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("role"), "id", "v")
    asked = rows.where("is_query").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), F.lit(1).alias("role"), "id", "v")
    tiles = base.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "role", "id")
    partial = tiles.mapInArrow(_stream(k, tile_rows), "query_id long, vec_id long, score long, shard long")
    best = [F.desc("score"), F.asc("vec_id")]
    bundled = partial.withColumn("bundle", F.floor(F.col("shard") / fan_in))
    merged = bundled.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "bundle").orderBy(*best))).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
