"""Media columns: content-defined chunks, kept once, and chunk lists that rebuild the media.

A text's bytes, padded with zeros to whole frames, are the samples of an 8-bit mono WAV, and that
file, header included, is the medium that is stored. A rolling gear hash cuts it where its content
says so; chunks go by their digest. Spark joins find one owner among all media for every digest, and
the store, a table bucketed by the digest of the samples, has one row for each distinct medium: its
ordered chunk list and the bytes of those chunks alone that it owns. To read a medium back, its
chunks owned elsewhere are joined in by digest, the parts are put in order, and the samples found in the
rebuilt file must hash to its key.

Only digests are exchanged to find owners. Media bytes move once, compressed by block
sorting, which does best on short texts, and each task
sends a payload that it meets again only once, so groups of copies don't pile up.

Defined results: a null or empty text is one frame of zeros; very long texts are stored whole; equal texts share one stored
payload and have equal values; repeated rows give repeated rows; null ids are kept; an empty
table gives an empty table; columns other than the id and the text take no part.
"""

from __future__ import annotations

import bz2
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop, shuffle_partitions, shuffles_released, stored

FRAME, LEAST, MEAN_BITS, MOST = 64, 512, 11, 8192
RATE = 8000
SENT_KEPT = 100_000
FREQUENT = 1000

MANIFEST = "n_bytes long, media binary, digests array<binary>, sizes array<int>"
PAYLOADS = "media binary, sizes array<int>, packed binary"
STORE = "media binary, digests array<binary>, sizes array<int>, owned array<boolean>, packed binary"
FACTS = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gear_table() -> np.ndarray:
    """256 fixed random numbers, drawn by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling the window."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))  # the right side is computed first
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Chunk sizes of each payload. A cut lies at least LEAST bytes after the one before, so that no window reaches another payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    # the top bits depend on the whole window
    marks = np.flatnonzero(gear_hash(data) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, start = [], 0
    for p in payloads:
        end, at, sizes = start + len(p), start, []
        near = marks[np.searchsorted(marks, start) : np.searchsorted(marks, end)].tolist()
        for m in near:
            while m - at > MOST:
                sizes.append(MOST)
                at += MOST
            if m - at >= LEAST and m < end:
                sizes.append(m - at)
                at = m
        while end - at > MOST:
            sizes.append(MOST)
            at += MOST
        sizes.append(end - at)
        out.append(sizes)
        start = end
    return out


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def parts(data: bytes, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, found by its own headers."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    return media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")]


def feature(samples: bytes) -> str:
    """Peak, mean, root mean square about the midpoint, crossings of the midpoint, and the commonest sample."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    values = np.arange(256, dtype=np.int64)
    square = int((count * (values - 128) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"peak={int(values[count > 0][-1])} sum={int((count * values).sum())} rms={(square / len(x)) ** 0.5:.6f} cross={crossings} mode={int(count.argmax())}"


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, texts in slices(whole, "text"):
            made = [payload(t) for t in texts]
            media = [wav(p) for _, p in made]
            sizes = cuts(media)
            digests = [[digest(c) for c in parts(m, s)] for m, s in zip(media, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([hashlib.sha256(p).digest() for _, p in made], pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "media", "digests", "sizes"],
            )


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent: set[bytes] = set()
    for whole in batches:
        for _, texts in slices(whole, "text"):
            fresh = {}
            for t in texts:
                p = payload(t)[1]
                if (key := hashlib.sha256(p).digest()) not in sent:
                    fresh[key] = wav(p)
                    if len(sent) < SENT_KEPT:  # a payload sent twice is dropped by its receiver
                        sent.add(key)
            if fresh:
                data = list(fresh.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(fresh), pa.binary()), pa.array(cuts(data), pa.list_(pa.int32())), pa.array([bz2.compress(m) for m in data], pa.binary())],
                    ["media", "sizes", "packed"],
                )


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of payload digest: the first of each, with the bytes that it owns."""
    last = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["media"] == last:
                continue
            last, seen, kept, owned, names = r["media"], set(r["own"] or []), [], [], []
            for c in parts(bz2.decompress(r["packed"]), r["sizes"]):
                names.append(d := digest(c))
                owned.append(d in seen)
                if d in seen:
                    seen.discard(d)  # a chunk that comes back within the payload is kept once
                    kept.append(c)
            rows.append((last, names, r["sizes"], owned, bz2.compress(b"".join(kept))))
        if rows:
            kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["media", "digests", "sizes", "owned", "packed"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks that a row owns and others ask for."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            wanted = set(r["wanted"])
            own = [i for i, o in enumerate(r["owned"]) if o]
            for i, c in zip(own, parts(bz2.decompress(r["packed"]), [r["sizes"][i] for i in own]), strict=True):
                if (d := r["digests"][i]) in wanted:
                    rows.append((d, bz2.compress(c)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["digest", "chunk"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media rebuilt from the store, verified, and what they hold."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = {x["digest"]: bz2.decompress(x["chunk"]) for x in r["foreign"] or []}
            own = [i for i, o in enumerate(r["owned"]) if o]
            found |= zip([r["digests"][i] for i in own], parts(bz2.decompress(r["packed"]), [r["sizes"][i] for i in own]), strict=True)
            media = b"".join([found[d] for d in r["digests"]])
            samples = samples_of(media)
            key = hashlib.sha256(samples)
            if key.digest() != r["media"]:
                raise ValueError(f"stored media {r['media'].hex()} can't be rebuilt")
            rows.append((r["media"], len(samples), key.hexdigest(), zlib.crc32(samples[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], re.findall(r"(\w+) \w+(?:,|$)", FACTS))


def store_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(manifest: doc_id, n_bytes, media, digests, sizes of each row; the name of the store: one row for each payload, a table bucketed by payload digest).

    The table lies in ``spark.sql.warehouse.dir``, which must be a folder that all machines share; it is the caller's to drop.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    manifest = stored(docs.mapInArrow(_manifest, f"doc_id {dict(docs.dtypes)['doc_id']}, {MANIFEST}"), "media-manifest")
    lists = manifest.groupBy("media").agg(F.min("digests").alias("digests"))
    owners = lists.select("media", F.explode(F.array_distinct("digests")).alias("digest")).groupBy("digest").agg(F.min("media").alias("media"))
    # a table of its own, so that its shuffles are gone before payloads move
    own = stored(owners.groupBy("media").agg(F.collect_list("digest").alias("own")), "media-own")
    n = shuffle_partitions(spark)
    payloads = docs.select("text").mapInArrow(_payloads, PAYLOADS).repartition(n, "media")
    rows = payloads.join(own.hint("merge"), "media", "left").sortWithinPartitions("media").mapInArrow(_owned, STORE)
    name = f"media_store_{uuid.uuid4().hex}"
    with shuffles_released(spark):
        rows.write.bucketBy(n, "media").saveAsTable(name)
    drop(own)
    return manifest, name


def read_media(store: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(one row for each stored medium, rebuilt from chunk lists: see FACTS; the tables that it reads, to drop when it is written).

    Chunks that very many media ask for are sent to the tasks, at most FREQUENT of them; the others meet their askers by digest.
    """
    listed = store.select("media", F.arrays_zip("digests", "owned").alias("c")).select("media", F.explode("c").alias("c")).select("media", "c.digests", "c.owned")
    owners = listed.where("owned").select(F.col("digests").alias("digest"), F.col("media").alias("owner"))
    # chunks that a payload lists without owning them
    missing = listed.groupBy("media", F.col("digests").alias("digest")).agg(F.max("owned").alias("owned")).where("not owned").select("media", "digest")
    missing = stored(missing, "media-missing")
    least = max(FREQUENT, missing.count() // FREQUENT)
    asked = missing.select("digest").distinct().join(owners, "digest").groupBy("owner").agg(F.collect_list("digest").alias("wanted"))
    chunks = store.join(asked.withColumnRenamed("owner", "media"), "media").select("digests", "sizes", "owned", "packed", "wanted").mapInArrow(_chunks, "digest binary, chunk binary")
    often = missing.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("digest", F.lit(True).alias("often"))
    chunks = stored(chunks.join(often, "digest", "left"), "media-chunks")
    sent = F.broadcast(chunks.where("often").select("digest", "chunk"))  # at most FREQUENT chunks of MOST bytes
    rest = missing.join(sent.select("digest"), "digest", "left_anti").join(chunks.where("often is null").select("digest", "chunk"), "digest")
    foreign = missing.join(sent, "digest").unionByName(rest).groupBy("media").agg(F.collect_list(F.struct("digest", "chunk")).alias("foreign"))
    return store.join(foreign, "media", "left").select("media", "digests", "sizes", "owned", "packed", "foreign").mapInArrow(_facts, FACTS), [missing, chunks]


def media_features(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_bytes of each row, with the facts of its media as read back from the store."""
    spark = df.sparkSession
    manifest, name = store_media(df, id_col=id_col, text_col=text_col)
    try:
        read, held = read_media(spark.table(name))
        facts = stored(read, "media-facts")
        drop(*held)
    finally:
        spark.sql(f"drop table {name}")
    return manifest.select("doc_id", "n_bytes", "media").join(facts, "media").drop("media")
