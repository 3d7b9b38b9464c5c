r"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns, its members the conversations that start with it.
Each node belongs to its smallest member. Deeper nodes have fewer members, so a conversation
owns a suffix of its path and every node has one owner. What a subtree sums up is therefore
found on its members' paths: all that they meet from the node on, less what they own from there
on (a node met by n members is met n times and owned once); the leaves are those that they own.

Texts don't move: a turn goes by a 256-bit digest. One streaming pass over each sorted
conversation chains the digests, so that a node has one key. A group-by of keys finds owners,
a join by (conversation, depth), which no hot node touches, marks the nodes that each path owns,
windows from the end of each path sum them up, and one group-by of keys gives the nodes. Both
group-bys combine on the map side, so the root, whose members are all, is no task's burden.

The digest of a node's ending members is one hash over sorted ids: ranges of ids are joined to
blocks in parallel, and a node's blocks are streamed. A conversation is one sequence; one task
streams it in bounded memory after an external sort, whatever its length.

Defined results: turns are ordered by turn, nulls first; turns of one conversation that tie are
ordered by their digests, rows that repeat being turns of their own; null roles and texts are
empty; rows without a conversation take no part; a conversation may have no turn, if
``conversations`` lists it, and is then a member of the root alone; an empty table has no node, not
even the root; very long texts are digested whole; other columns take no part, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of joined ids in a block.
BLOCK_BYTES = 1 << 16


def turn_items(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), item (the digest of role and text) and n_bytes (of the text, UTF-8) of each turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    item = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), item.alias("item"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "item")
    return rows.where("conv_id is not null").select("conv_id", F.row_number().over(order).alias("pos"), "item", "n_bytes")


def borrowed(items: DataFrame, lender: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: the first ``heads`` (``most`` at most) turns of conversation ``lender``, both functions of conv_id, then the own ones after as many. Returns (items, all conversations)."""
    convs = items.select("conv_id").distinct()
    asks = convs.select(F.col("conv_id").alias("c"), lender.alias("b"), heads.cast("int").alias("h"))
    lent = items.where(F.col("pos") <= most).withColumnRenamed("conv_id", "b")
    first = asks.join(lent, "b").where("pos <= h").select(F.col("c").alias("conv_id"), "pos", "item", "n_bytes")
    rest = items.where(F.col("pos") > heads).withColumn("pos", F.col("pos") + most)  # behind all that is lent
    return first.union(rest), convs


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted conversations, each led by a row without an item, the nodes that they meet."""
    conv = held = None
    depth, key = 0, b""
    for batch in batches:
        out = []
        for c, item, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held is not None:
                out.append((*held, c != conv))
            if c != conv or held is None:
                conv, depth, parent, key = c, 0, None, bytes(16)
            else:
                depth, parent, key = depth + 1, key, hashlib.blake2b(key + item, digest_size=16).digest()
            held = (c, depth, key, parent, n)
        if out:
            yield _batch(out)
    if held is not None:
        yield _batch([(*held, True)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["c", "d", "key", "up", "n_bytes", "ends"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) in order: blocks of a key's ids, joined by commas."""
    now, first, ids, size = None, 0, [], 0
    for batch in batches:
        out = []
        for key, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (key != now or size > BLOCK_BYTES):
                out.append((now, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                now, first = key, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield _blocks(out)
    if ids:
        yield _blocks([(now, first, ",".join(ids))])


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of key and id: one digest for each key."""
    now, state = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == now:
                state.update(b",")
            else:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def prefix_trie(items: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of sequences given as (conv_id, pos, item, n_bytes): conv_id (the smallest member, which with depth names the node), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, the bytes of each node's last turn for all members but one) and ends_sha256 (of the ids that end there)."""
    convs = items.select("conv_id").distinct() if conversations is None else conversations.select("conv_id")
    roots = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("n_bytes"))
    rows = roots.union(items.select("conv_id", F.col("pos").cast("int"), "item", "n_bytes")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    met = stored(rows.select("conv_id", "item", "n_bytes").mapInArrow(_chained, "c long, d long, key binary, up binary, n_bytes long, ends boolean"), "trie-paths")

    owners = stored(met.groupBy("key").agg(F.min("c").alias("c"), F.first("d").alias("d"), F.first("up").alias("up"), F.min("ends").alias("leaf")), "trie-owners")
    marked = met.select("c", "d", "key", "n_bytes").join(owners.select("c", "d", F.col("leaf").cast("long").alias("leaf")), ["c", "d"], "left")
    down = Window.partitionBy("c").orderBy(F.col("d").desc())
    own = F.col("leaf").isNotNull()
    paths = marked.select(
        "c",
        "key",
        F.sum(F.when(own, 0).otherwise(F.col("n_bytes"))).over(down).alias("saved"),  # met less owned
        F.coalesce(F.sum("leaf").over(down), F.lit(0)).alias("leaves"),
        F.lag(own.cast("long"), 1, 0).over(down).alias("child"),
    )
    nodes = paths.groupBy("key").agg(F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    # the root's owner is the smallest of all: its children, who may be very many, needn't ask for it
    least = owners.where("d = 0").agg(F.min("c")).first()[0]
    near = owners.where("d < 2").withColumn("parent_conv_id", F.when(F.col("d") == 1, F.lit(least).cast("long")))
    far = owners.where("d >= 2").join(owners.select(F.col("key").alias("up"), F.col("c").alias("parent_conv_id")), "up")
    named = near.select("key", "c", "d", "parent_conv_id").union(far.select("key", "c", "d", "parent_conv_id"))

    blocks = met.where("ends").select("key", "c").repartitionByRange("c").sortWithinPartitions("key", "c").mapInArrow(_joined, "key binary, first long, ids string")
    ended = blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digested, "key binary, ends_sha256 string")
    return (
        named.join(nodes, "key").join(ended, "key", "left")
        .select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )
