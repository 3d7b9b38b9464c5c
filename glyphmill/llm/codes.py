"""Compression of vectors to short codes: product quantisation with integer codebooks.

Components become whole numbers, floor(scale * x), and vectors are cut into equal consecutive
parts. Equal parts of one position are one row with a weight, so copies of a vector cost a round
nothing. Each round of Lloyd's method is one pass over the distinct parts: the codebooks (a few
hundred entries) are sent to the tasks, a task assigns its parts and adds them up with their
weights, and what reaches the driver is one sum for each entry and component. In the end codes and
squared errors are joined back to the vectors by position and part; parts that very many vectors
share are sent to them, so that none of them is one task's.

All sums and distances are whole numbers: in float64 where that is exact, else in whole numbers of
any size. A mean is floor(sum / count).

Defined results: rows whose vector is null or holds a null or non-finite component are left out; rows
without an id are coded too and start a codebook only where fewer rows than entries have one; rows that repeat an id are rows of their
own; rows with one id are put in order by their components; with fewer rows than entries a codebook
has as many entries as there are rows; vectors shorter than the longest are filled with zeros, and so
is a width that the parts don't divide; an empty vector is all zeros; components beyond the range of a
long, and errors beyond it, stand at its ends; an empty table gives no row; other columns take no part,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

TOP = (1 << 63) - 1
#: Distances held at once.
HELD = 1 << 20


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (int64) the nearest entry, ties to the earlier, and the squared distance, as float64 if that is exact, else as Python's whole numbers."""
    most = max(abs(int(f(x))) for x in (parts, book) for f in (np.min, np.max)) if parts.size and book.size else 0
    kind = float if 8 * parts.shape[1] * most**2 < 1 << 53 else object
    x, c = parts.astype(kind), book.astype(kind)
    at, error = [], []
    for lo in range(0, len(x), max(1, HELD // max(len(c), 1))):
        some = x[lo : lo + max(1, HELD // max(len(c), 1))]
        far = (some * some).sum(axis=1)[:, None] - 2 * (some @ c.T) + (c * c).sum(axis=1)[None, :]
        at.append(np.argmin(far, axis=1))
        error.append(far[np.arange(len(some)), at[-1]])
    return (np.concatenate(at), np.concatenate(error)) if at else (np.zeros(0, int), np.zeros(0))


def _matrices(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, parts, weights) of a batch of distinct parts."""
    parts = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, width)
    return batch.column(0).to_numpy(zero_copy_only=False), parts, batch.column(2).to_numpy(zero_copy_only=False)


def _summed(books: np.ndarray):
    """One row for each task, entry and component: how many parts the entry got, and their sum."""
    n_parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((n_parts, entries), object), np.zeros((n_parts, entries, width), object)
        for batch in batches:
            pos, parts, weight = _matrices(batch, width)
            for p in np.unique(pos).tolist():
                mine = np.flatnonzero(pos == p)
                at, _ = nearest(parts[mine], books[p])
                # sums of int64 stay exact up to this; beyond, Python's whole numbers
                safe = int(weight[mine].sum()) * max(abs(int(parts[mine].min(initial=0))), abs(int(parts[mine].max(initial=0)))) <= TOP
                w, x = (weight[mine], parts[mine]) if safe else (weight[mine].astype(object), parts[mine].astype(object))
                got, add = np.zeros(entries, w.dtype), np.zeros((entries, width), w.dtype)
                np.add.at(got, at, w)
                np.add.at(add, at, x * w[:, None])
                count[p] += got.astype(object)
                total[p] += add.astype(object)
        p, e = np.nonzero(count)
        rows = [(a, b, k, count[a, b], Decimal(total[a, b, k])) for a, b in zip(p.tolist(), e.tolist(), strict=True) for k in range(width)]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["pos", "entry", "k", "n", "total"])

    return run


def _assigned(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, parts, _ = _matrices(batch, books.shape[2])
            code, error = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p in np.unique(pos).tolist():
                mine = np.flatnonzero(pos == p)
                code[mine], far = nearest(parts[mine], books[p])
                error[mine] = [min(int(x), TOP) for x in far] if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["pos", "part", "n", "entry", "far"])

    return run


def _back(rows: DataFrame, known: DataFrame, keys: list[str], total: int) -> DataFrame:
    """What is known by key (``n`` rows have it) for each row, keys that are null being equal. Keys of very many rows are sent to the rows."""
    least = max(1000, total // 1000)
    names = {k: f"_{k}" for k in keys}
    known = known.withColumnsRenamed(names)
    hot, rest = F.broadcast(known.where(F.col("n") >= least)), known.where(F.col("n") < least)  # 1000 rows a position at most

    def same(other: DataFrame):
        out = F.lit(True)
        for k, own in names.items():
            out = out & rows[k].eqNullSafe(other[own])
        return out

    some = rows.join(hot, same(hot))
    others = rows.join(hot, same(hot), "left_anti")
    return some.unionByName(others.join(rest, same(rest))).drop("n", *names.values())


def vector_codes(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 4096.0, n_parts: int = 8, entries: int = 16, rounds: int = 6
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error of each row; the codebooks, by part, entry and component)."""
    if entries > 256:
        raise ValueError("an entry has two hexadecimal digits")
    vec = F.col(f"`{vec_col}`")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))  # beyond a long: its ends
    rows = df.where(F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), whole.alias("v"))
    rows = stored(rows, "codes-vectors")
    total, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, -(-(longest or 0) // n_parts))

    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * n_parts) - F.size("v")))
    cut = rows.withColumn("v", filled).select("row", "vec_id", "label", F.array(*(F.slice("v", 1 + p * width, width) for p in range(n_parts))).alias("parts"))
    parts = cut.select("row", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    distinct = stored(parts.groupBy("pos", "part").agg(F.count("*").alias("n")), "codes-parts")

    first = cut.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = np.array([r["parts"] for r in first], np.int64).reshape(-1, n_parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums = distinct.mapInArrow(_summed(books), "pos int, entry int, k int, n long, total decimal(38,0)").groupBy("pos", "entry", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in sums.collect():  # one for each entry and component
            books[r["pos"], r["entry"], r["k"]] = int(r["total"]) // r["n"]

    codes = distinct.mapInArrow(_assigned(books), "pos int, part array<long>, n long, entry int, far long")
    codes = stored(codes, "codes-assigned")
    drop(distinct)
    found = _back(parts, codes, ["pos", "part"], total).groupBy("row").agg(
        F.first("vec_id").alias("vec_id"),
        F.first("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("pos", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("h")))).alias("c"),  # one for each part
        F.sum(F.col("far").cast("decimal(38,0)")).alias("error"),
    )
    found = stored(found.select("vec_id", "label", F.array_join(F.transform("c", lambda x: x["h"]), "").alias("code"), F.least("error", F.lit(TOP)).cast("long").alias("error")), "codes-found")
    by_label = found.groupBy("label").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP)).cast("long").alias("label_error"))
    return _back(found, by_label, ["label"], total), books


def books_sha256(books: np.ndarray) -> str:
    """Of all components in decimal digits, by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
