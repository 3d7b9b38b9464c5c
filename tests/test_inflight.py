"""Calls under way: overlap, order, back-pressure, attempts, and tables that are deleted."""

import threading
import time

import pandas as pd
import pytest

from glyphmill.functions.schema import KEYWORD_SCHEMA
from glyphmill.operators import datasets, extraction, tables
from glyphmill.operators.clients import canned, canned_pairs
from glyphmill.operators.inflight import answered, in_order, one_each


class Slow:
    """Counts how many calls are under way."""

    def __init__(self, wait=0.02):
        self.wait, self.now, self.most, self.lock = wait, 0, 0, threading.Lock()

    def __call__(self, x):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(self.wait * (1 + x % 3))
        with self.lock:
            self.now -= 1
        return x * x


@pytest.mark.parametrize("width", [1, 2, 8])
def test_order_and_overlap(width):
    slow = Slow()
    began = time.time()
    assert list(in_order(iter(range(40)), slow, width)) == [x * x for x in range(40)]
    assert slow.most == width
    if width == 8:
        assert time.time() - began < 40 * 0.04 / 2


def test_back_pressure():
    """Rows are read only so far ahead of the answers that are taken."""
    read = []

    def rows():
        for k in range(1000):
            read.append(k)
            yield k

    got = in_order(rows(), Slow(0.001), 4, ahead=10)
    for taken in range(1, 50):
        next(got)
        assert len(read) <= taken + 10
    got.close()
    assert len(read) < 70 and not [t for t in threading.enumerate() if t.name.startswith("ThreadPoolExecutor") and t.is_alive()]


def test_failures_come_in_their_place():
    def call(x):
        if x == 5:
            raise ValueError("five")
        return x

    got = in_order(iter(range(10)), call, 3)
    assert [next(got) for _ in range(5)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="five"):
        next(got)


def test_batches_stay_as_they_were():
    frames = [pd.DataFrame({"a": range(n), "b": range(n)}) for n in (3, 0, 1, 20, 7)]
    out = list(answered(iter(frames), ["a", "b"], lambda a, b: a * 100 + b, 5))
    assert [len(f) for f, _ in out] == [3, 1, 20, 7] and all(got == [x * 101 for x in f["a"]] for f, got in out)
    made = []
    client = one_each(lambda: made.append(threading.get_ident()) or len(made))
    list(in_order(iter(range(50)), lambda x: (time.sleep(0.002), client())[1], 4))
    assert 1 < len(made) <= 4 and len(set(made)) == len(made)


def test_extraction_overlaps(spark):
    """Same answers, attempts and order of batches whether or not calls overlap; much less time."""

    def sleepy():
        plain = canned()

        def client(system, user, params):
            time.sleep(0.05)
            return plain(system, user, params)

        return client

    words = ["alpha", "beta", "gamma!", "delta", "epsilon"]
    rows = spark.createDataFrame([(str(k), f"{words[k % 5]} {words[k % 3]} screen") for k in range(60)], "id string, text string").coalesce(1)
    took, got = {}, {}
    for width in (1, 12):
        config = extraction.Config(thread_workers=width, filter_not_in_original=False, max_keyword_length=40)
        began = time.time()
        found = extraction.extract(rows, KEYWORD_SCHEMA, sleepy, config)
        got[width] = sorted((r["id"], r["data"], r["attempts"]) for r in found.collect())
        took[width] = time.time() - began
    assert got[1] == got[12] and {r[2] for r in got[1]} == {1, 2}
    calls = sum(r[2] for r in got[1])
    assert took[1] - took[12] > 0.5 * 0.05 * calls


def test_generation_overlaps_in_order(spark):
    rows = spark.createDataFrame([(k, f"屏幕很好用{'的' * k}") for k in range(40)], "index long, comment string").coalesce(2)
    one, many = ({r["index"]: r["record"] for r in datasets.generated(rows, canned_pairs, workers=w).collect()} for w in (1, 15))
    assert one == many and set(one) == set(range(40))


def test_settled_tables_are_deleted(spark):
    tables.release(spark)
    rows = spark.createDataFrame([("1", "alpha beta")], "id string, text string")
    assert extraction.extract(rows, KEYWORD_SCHEMA, canned, extraction.Config(enable_preprocess=False)).count() == 1
    path = tables._standing[-1]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    exists = lambda: fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs.Path(path))
    assert exists() and tables.release(spark) >= 1 and not exists() and tables.release(spark) == 0
