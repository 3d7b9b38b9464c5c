"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised at their own quantiles, the cell's index on the
Hilbert curve orders the rows, and runs of that order with equal row counts become shards, so
that each shard's file covers a compact box of the metadata and statistics prune files in
every dimension.

Defined results: null metadata take the lowest coordinate; a null text has size 16 and the
CRC of the empty string; ties on the curve are ordered by size, CRC, id and all dimensions,
and rows that still tie are the same in every output column; repeated rows are rows of their
own; very long texts and strings are taken whole; an empty table gives an empty table; input columns other than the id, the text and the
dimensions take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, shuffle_partitions, stored


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(rank, next state) for state * 2**dims + cell, from the Gray-code construction of the curve.

    A state is an entry corner and a direction. Seen from them, the cell's rank is the inverse
    Gray code; the subcell's own entry and direction follow from its rank.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    inverse = {gray(i): i for i in range(size)}

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def turn(i: int) -> int:
        if i == 0:
            return 0
        return trailing_ones(i - 1 if i % 2 == 0 else i) % dims

    ranks, states = [], []
    for corner in range(size):
        for way in range(dims):
            for cell in range(size):
                rank = inverse[rotate(cell ^ corner, -(way + 1))]
                ranks.append(rank)
                states.append((corner ^ rotate(entry(rank), way + 1)) * dims + (way + turn(rank) + 1) % dims)
    return ranks, states


def curve_index(coords: list[str], bits: int) -> str:
    """SQL for the Hilbert index of integer columns in [0, 2**bits); a fold from the highest bit, so it stays small."""
    dims, size = len(coords), 1 << len(coords)
    ranks, states = curve_tables(dims)
    literal = lambda xs: f"array({', '.join(map(str, xs))})"
    cell = " + ".join(f"(shiftright(`{c}`, i) & 1) * {1 << j}" for j, c in enumerate(coords))
    at = f"a.s * {size} + {cell} + 1"
    step = f"named_struct('h', a.h * {size} + element_at({literal(ranks)}, {at}), 's', element_at({literal(states)}, {at}))"
    return f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 's', 0), (a, i) -> {step}).h"


def _string_cuts(df: DataFrame, name: str, bits: int) -> list[str]:
    """Values that cut the column's rows into about equal parts, by whole strings: exactly, from all distinct values.

    They are sorted by range over all tasks; how many rows stand before one comes from the sums of the ranges (a row each) and
    from the order within its range. At most 2**bits - 1 of them reach the driver.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    sorted_ = stored(counts.repartitionByRange(shuffle_partitions(df.sparkSession), "v").sortWithinPartitions("v").withColumn("__at", F.monotonically_increasing_id()), "shard-strings")
    part = sorted_.select("v", "n", "__at", F.shiftright("__at", 33).alias("__part"))
    sums = part.groupBy("__part").agg(F.sum("n").alias("__n"))
    offsets = sums.selectExpr("__part", "sum(__n) over (order by __part) - __n as __before", "sum(__n) over () as __all")
    own = part.withColumn("__seen", F.expr("sum(n) over (partition by __part order by __at)"))
    placed = own.join(F.broadcast(offsets), "__part").withColumn("__seen", F.col("__seen") + F.col("__before"))
    crossed = f"(__seen - n) * {2**bits} div __all <> __seen * {2**bits} div __all and __seen < __all"
    cuts = sorted((r["v"].encode(), r["v"]) for r in placed.where(crossed).select("v").collect())
    drop(sorted_)
    return [v for _, v in cuts]


def _under(cuts: Column, value: Column) -> Column:
    return F.filter(cuts, lambda c: c < value)


def quantised(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Columns __c0, __c1, ... with each dimension's number of quantile cuts below the value; strings are compared whole."""
    kinds = dict(df.dtypes)
    number = {}
    for i, d in enumerate(dims):
        if kinds[d] in ("date", "timestamp", "timestamp_ntz"):
            number[i] = F.unix_micros(F.col(d).cast("timestamp")).cast("double")
        elif kinds[d] != "string":
            number[i] = F.col(d).cast("double")
    at = F.array(*(F.lit(k / 2**bits) for k in range(1, 2**bits)))
    cuts = df.agg(*(F.percentile_approx(c, at, F.lit(10_000)).alias(f"c{i}") for i, c in number.items())).first() if number else None
    out = df
    for i, d in enumerate(dims):
        if i in number:
            below, value = F.array(*(F.lit(float(c)) for c in cuts[f"c{i}"] or [])).cast("array<double>"), number[i]
        else:
            below, value = F.array(*(F.lit(c) for c in _string_cuts(df, d, bits))).cast("array<string>"), F.col(d)
        out = out.withColumn(f"__c{i}", F.when(value.isNull(), 0).otherwise(F.size(_under(below, value))))
    return out


def hilbert_shards(
    df: DataFrame, *, dims: list[str], n_shards: int = 40, bits: int = 5, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 16
) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions' cell index on the curve, shard and slot of each row.

    The counts of the shards differ by one at most. Only the id, size, CRC and dimensions are
    shuffled, once, by range; ranks come from the rows' order within their range and from the
    counts of the ranges (one row for each shuffle partition), never from a single task.
    """
    spark = df.sparkSession
    bytes_ = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    narrow = stored(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.length(bytes_) + row_overhead).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            *(F.col(f"`{d}`").alias(f"__d{i}") for i, d in enumerate(dims)),
        ),
        "shard-keys",
    )
    names = [f"__d{i}" for i in range(len(dims))]
    curve = quantised(narrow, names, bits).withColumn("curve", F.expr(curve_index([f"__c{i}" for i in range(len(dims))], bits)))
    order = ["curve", "size", "text_crc32", "doc_id", *names]
    ranged = curve.select(*order).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(ranged.select("doc_id", "size", "text_crc32", "curve", F.monotonically_increasing_id().alias("__at")), "shard-order")

    part = placed.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__pos"))
    counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.selectExpr("__part", "sum(__n) over (order by __part) - __n as __before", "sum(__n) over () as __all")
    ranked = part.join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + F.col("__pos"))
    return ranked.withColumn("shard", F.expr(f"cast((__rank * {n_shards}) div __all as int)")).select(
        "doc_id",
        "size",
        "text_crc32",
        "curve",
        "shard",
        F.expr(f"__rank - (shard * __all + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
    )
