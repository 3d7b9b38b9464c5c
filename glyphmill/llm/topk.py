"""Exact top-k search by inner product over tiles of queries and candidates.

Rows are hashed by id into shards and each shard is packed into one matrix. A tile is one
block of queries against one shard of candidates: one matrix product, then a partial
selection of each query's k best. The tiles' lists are merged in a tree, a bounded number at
a time, so no task sees more than a tile or the lists of a few tiles. Shard and block counts
follow the row counts, so that tiles keep their size whatever the input.

Components are turned into floor(scale * x), whole numbers of any size where a double can't hold the
product; inner products are summed in float32, float64 or whole numbers of any size, the first in
which they are exact.

Defined results: vectors that are null or hold a null or non-finite component, and rows without
an id, take no part; an empty vector scores 0 with all others, and shorter vectors are padded
with zeros; rows that repeat an id are rows of their own: each is a candidate for the others,
and each that is a query brings its own list; ties go to the smaller id; scores beyond the
range of a long stand at its ends and tie there; fewer than k candidates give fewer rows; an
empty table gives no row; other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PACKED = "shard int, n int, width int, whole boolean, ids binary, data binary"
LISTS = "block int, part int, queries binary, ids binary, scores binary"
FAN_IN = 8


def _pack(shard: int, ids: np.ndarray, data: np.ndarray) -> pd.DataFrame:
    whole = data.dtype == object
    return pd.DataFrame([(shard, len(ids), data.shape[1], whole, ids.tobytes(), pickle.dumps(data) if whole else data.tobytes())], columns=["shard", "n", "width", "whole", "ids", "data"])


def _matrix(n: int, width: int, whole: bool, data: bytes) -> np.ndarray:
    return pickle.loads(data) if whole else np.frombuffer(data, np.float64).reshape(n, width)


def scaled(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles, or as Python's whole numbers if a product is beyond a double."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * v)
    return out if np.isfinite(out).all() else np.array([math.floor(Fraction(scale) * Fraction(x)) for x in v.tolist()], object)


def _shards(df: DataFrame, count: int, scale: float) -> DataFrame:
    """Packed matrices of about equal size, rows in order of id."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [scaled(np.asarray(v, float), scale) for v in frame["v"]]
        data = np.zeros((len(frame), max(map(len, rows))), object if any(r.dtype == object for r in rows) else float)
        for k, r in enumerate(rows):
            data[k, : len(r)] = r
        ids = frame["id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        return _pack(key[0], ids[order], data[order])

    return df.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("shard"), "id", "v").groupBy("shard").applyInPandas(run, PACKED)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64, in the cheapest type that is exact."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    most = np.inf if object in (q.dtype, c.dtype) else float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)  # any size, slowly
    return np.clip(whole(q) @ whole(c).T, int(LOW) + 1, (1 << 63) - 1).astype(np.int64)


def own_places(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where each query stands among the candidates: the first row with its id and vector, -1 if none has. Rows that repeat both are alike, so any of them will do."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    out = np.full(len(queries), -1)
    at, end = np.searchsorted(ids, queries), np.searchsorted(ids, queries, side="right")
    live = np.flatnonzero(at < end)
    while len(live):
        same = (q[live] == c[at[live]]).all(axis=1)
        out[live[same]] = at[live[same]]
        at[live] += 1
        live = live[~same]
        live = live[at[live] < end[live]]
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row; ids (the same shape) of -1 << 63 stand for no candidate."""
    if scores.shape[1] > k:
        # all above the k-th best score, then the smallest ids at that score
        edge = ~np.partition(~scores, k - 1, axis=1)[:, k - 1 : k]  # ~x falls as x rises, without overflow
        rows, cols = np.nonzero(scores >= edge)
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    s, i = scores[rows, cols], ids[rows, cols]
    order = np.lexsort((i, ~s, rows))
    rows, s, i = rows[order], s[order], i[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    width = min(k, scores.shape[1])
    keep = rank < width
    out_i, out_s = np.full((len(scores), width), NONE), np.full((len(scores), width), LOW)
    out_i[rows[keep], rank[keep]], out_s[rows[keep], rank[keep]] = i[keep], s[keep]
    return out_i, out_s


NONE = LOW = np.int64(-(1 << 63))


def _lists(block: int, part: int, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([(block, part, queries.tobytes(), ids.tobytes(), scores.tobytes())], columns=["block", "part", "queries", "ids", "scores"])


def top_k(
    df: DataFrame, is_query: Column, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 1024
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for each query row."""
    value = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    sound = F.forall(F.col(f"`{vec_col}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    shards = _shards(rows, n_shards, scale)
    blocks = _shards(rows.where("q"), n_blocks, scale).withColumnRenamed("shard", "block")

    # every tile is one key; both sides are sent once for each tile that needs them
    left = blocks.select(*(F.col(c).alias(f"q_{c}") for c in ("n", "width", "whole", "ids", "data")), "block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    right = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    tiles = left.join(right.hint("shuffle_hash"), ["block", "shard"])

    def tile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                queries = np.frombuffer(row.q_ids, np.int64)
                ids, data = np.frombuffer(row.ids, np.int64), _matrix(row.n, row.width, row.whole, row.data)
                asked = _matrix(row.q_n, row.q_width, row.q_whole, row.q_data)
                scores, own = products(asked, data), own_places(queries, asked, ids, data)
                scores[np.flatnonzero(own >= 0), own[own >= 0]] = LOW
                found, at = best(np.broadcast_to(ids, scores.shape), scores, k)
                yield _lists(row.block, row.shard, queries, found, at)

    lists = tiles.mapInPandas(tile, LISTS)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        queries = np.frombuffer(frame["queries"].iloc[0], np.int64)
        shape = (len(queries), -1)
        ids, scores = (np.concatenate([np.frombuffer(x, np.int64).reshape(shape) for x in frame.sort_values("part")[c]], axis=1) for c in ("ids", "scores"))
        return _lists(key[0], key[1], queries, *best(ids, scores, k))

    left_over = n_shards
    while left_over > 1:
        lists = lists.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)")).groupBy("block", "part").applyInPandas(merge, LISTS)
        left_over = -(-left_over // FAN_IN)

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                queries = np.frombuffer(row.queries, np.int64)
                ids, scores = (np.frombuffer(x, np.int64).reshape(len(queries), -1) for x in (row.ids, row.scores))
                r, c = np.nonzero(scores > LOW)
                yield pd.DataFrame({"query_id": queries[r], "rank": (c + 1).astype(np.int32), "vec_id": ids[r, c], "score": scores[r, c]})

    return lists.mapInPandas(rank, "query_id long, rank int, vec_id long, score long")
