"""What several operators share: reading tables, cutting lineage, safe internal names."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The bytes that the contracts call white space: space and \x09 to \x0D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_mixers = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered, one to one; the multipliers are odd, any would do."""
    x = (x ^ (x >> np.uint64(32))) * _mixers[0]
    x = (x ^ (x >> np.uint64(29))) * _mixers[1]
    return x ^ (x >> np.uint64(32))


#: Odd multipliers; any would do.
P, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xE7037ED1A0B428DB)
#: Words of more bytes are hashed by a library call.
LONG = 512
_spaces = np.zeros(256, bool)
_spaces[[0x20, *range(0x09, 0x0E)]] = True
#: The first 0 to 8 bytes of a little-endian number.
_bytes = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit hashes) of the words of lower-cased bytes that end with white space.

    A word is taken in eight bytes at a time, each scattered before the next; very long ones are hashed by their bytes at once.
    """
    data = np.frombuffer(raw + bytes(8), np.uint8)
    edges = np.flatnonzero(np.diff(_spaces[data[:-8]], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))  # the eight bytes from each place
    size = ends - starts
    h = size.astype(np.uint64) * C
    live, at, left = np.arange(len(starts)), starts, size
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _bytes[np.minimum(left, 8)])) * P
        go = (left > 8) & (size[live] <= LONG)
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return starts, h


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table doesn't use, whether or not the session minds case."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(f"{lead}{w}".lower() in taken for w in wanted):
        lead += "_"
    return [f"{lead}{w}" for w in wanted]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where none is set, a local master, as in tests, gets a temporary one; a cluster has no folder that all its machines see."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile gives its shuffle files back once it is written: the table takes their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Folders of stored tables that still stand, in order.
_standing: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and the rows survive lost executors.

    The table stands until ``drop`` is called with it or ``drop_stored`` for the session.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _standing.append(path)
    with shuffles_released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > 0.6 * heap.maxMemory():  # what planning left behind goes before more is asked for
        spark.sparkContext._jvm.System.gc()
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _standing:
        _standing.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing unwritten reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.stored_path)


def drop_stored(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables stored since there were ``since``, but for ``keep``. To be called once the results that read them are written."""
    kept = getattr(keep, "stored_path", None)
    for path in _standing[since:]:
        if path != kept:
            _delete(spark, path)


def standing() -> int:
    """How many stored tables stand."""
    return len(_standing)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def give_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel whose worker returns freed memory to the system after each task: workers live on, beside others."""

    def kernel(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return kernel
