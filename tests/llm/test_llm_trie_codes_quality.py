"""The prefix trie, the vector codes and the quality model against brute force, held-out labels, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from glyphmill.llm import codes, quality, queries, trie

SF = "/root/testdata/sf0.01"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_trie(sequences):
    """Nodes of {conv_id: [(role, text), ...]}, by their definition."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted(c for c in own if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(own), len(p), parent, len(own), kids[p], sum(not kids[q] for q in below), saved, SHA(",".join(map(str, ends)))))
    return out


def nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = df.select(*columns).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


CONV = "conv_id long, turn long, role string, text string, c long, d long, key string, pos int, item string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], CONV).repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, seed):
    random.seed(seed)
    texts = ["", None, "é", "one", "two", "a" * 30_000]
    rows = [(c, t, random.choice(["user", None, ""]), random.choice(texts[: random.randint(1, 6)])) for c in range(-5, 60) for t in range(random.randint(1, 9))]
    rows += [(99, t, "user", "one") for t in range(700)] + [(None, 0, "user", "one")]
    random.shuffle(rows)
    given = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        given.setdefault(c, []).append((role or "", text or ""))
    assert nodes(trie.prefix_trie(trie.turn_items(conversations(spark, rows)))) == brute_trie(given)


def test_trie_of_borrowed_heads(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    given = {}
    for r in spark.read.parquet(path).orderBy("conv_id", "turn").collect():
        given.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    del given[0]
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = given.get(c - c % 5, [])[:h] + own[h:]
    assert any(not t for t in built.values())
    import pyspark.sql.functions as F

    items = trie.turn_items(spark.read.parquet(path).where("conv_id <> 0"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    assert nodes(trie.prefix_trie(*trie.borrowed(items, F.col("conv_id") - F.col("conv_id") % 5, heads, 8))) == brute_trie(built)


def test_trie_on_odd_input(spark):
    assert trie.prefix_trie(trie.turn_items(conversations(spark, []))).count() == 0
    assert nodes(trie.prefix_trie(trie.turn_items(conversations(spark, [(None, 1, "user", "a")])))) == set()
    # null turns come first; turns that tie are the same in every conversation that has them, as are repeated rows
    rows = [(c, t, "user", x) for c in (4, 7) for t, x in ((None, "first"), (1, "b"), (1, "a"), (1, "a"), (2, "z"))]
    got = nodes(trie.prefix_trie(trie.turn_items(conversations(spark, rows))))
    assert len(got) == 6 and {(r[0], r[3], r[6]) for r in got} >= {(4, 2, 9), (4, 2, 1)}


def test_many_ids_end_at_one_node(spark, monkeypatch):
    """Blocks of ids are joined in order, whatever their size."""
    ids = random.Random(5).sample(range(-(10**9), 10**12), 5000)
    rows = [(c, 0, "user", "hi") for c in ids]
    ended = {r["ends_sha256"] for r in trie.prefix_trie(trie.turn_items(conversations(spark, rows))).where("depth = 1").collect()}
    assert ended == {SHA(",".join(map(str, sorted(ids))))}


def brute_codes(rows, scale=4096, n_parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) sorted, and the codebooks, in Python's whole numbers."""
    top = (1 << 63) - 1
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for r in kept), default=0)
    w = max(1, -(-longest // n_parts))
    whole = []
    for i, v, label in kept:
        x = [min(top, max(-top - 1, math.floor(Fraction(x) * scale))) for x in v] + [0] * (w * n_parts - len(v))
        whole.append((i, [tuple(x[p * w : p * w + w]) for p in range(n_parts)], label))
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(n_parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(n_parts):
            got = {}
            for _, x, _ in whole:
                got.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [tuple(sum(c) // len(got[k]) for c in zip(*got[k], strict=True)) if k in got else e for k, e in enumerate(books[p])]
    found = []
    for i, x, label in whole:
        best = [near(x[p], books[p]) for p in range(n_parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in best), min(top, sum(min(top, e) for e, _ in best)), label))
    sums = Counter()
    for _, _, e, label in found:
        sums[label] += e
    return sorted(((i, c, e, min(top, sums[label])) for i, c, e, label in found), key=str), [c for p in books for e in p for c in e]


VECTORS = "vec_id long, embedding array<double>, label int, n long, pos int, part string, row long"


def coded(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], VECTORS).repartition(3)
    found, books = codes.vector_codes(df)
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()), key=str), books.ravel().tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_codes(spark, seed):
    random.seed(seed)
    make = lambda n, s=1.0: [random.gauss(0, s) for _ in range(n)]
    rows = [(k, make(16), random.choice([0, 1, None])) for k in range(60)]
    rows += [(5, rows[5][1], 1), (5, make(16), 2)] + [(100 + k, rows[0][1], 0) for k in range(30)] + [(None, make(16), 1)]
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")], 0), (203, [float("-inf")] * 16, 0), (204, [], 1), (205, make(5), 1)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_on_odd_input(spark):
    assert coded(spark, []) == ([], [])
    few = [(3, [0.5, -0.5, 1 / 3], 0), (1, [-1e-9] * 17, None), (None, [2.0] * 9, 1)]
    assert coded(spark, few) == brute_codes(few)
    empty = [(1, [], 0), (2, [], 0)]
    assert coded(spark, empty) == brute_codes(empty)
    huge = [(k, [x * (k + 1) for x in (1e4, -3e8, 1e300, -1e18, 0.1, 5e9, -1e307, 1e12)], k % 2) for k in range(20)]
    assert coded(spark, huge) == brute_codes(huge)
    ties = [(k, [float(k % 2)] * 8, 0) for k in range(40)]
    assert coded(spark, ties) == brute_codes(ties)


def test_parts_of_very_many_vectors(spark):
    """Parts and labels of thousands of rows are sent to the rows; the result is the same."""
    random.seed(4)
    common = [random.gauss(0, 1) for _ in range(8)]
    rows = [(k, common if k % 3 else [random.gauss(0, 1) for _ in range(8)], k % 2 if k % 5 else None) for k in range(3000)]
    assert coded(spark, rows) == brute_codes(rows)


def test_nearest_is_exact():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    book = np.array([[(1 << 40) + 1, -(1 << 40)], [1 << 40, 1 - (1 << 40)], [0, 0]], np.int64)
    at, error = codes.nearest(x, book)
    assert at.tolist() == [0, 2] and [int(e) for e in error] == [1, 25]


def brute_features(text):
    """The shares by plain counting."""
    raw = (text or "").encode()
    words = raw.lower().split()
    if not words:
        return [0.0] * len(quality.NAMES)
    letters = lambda b: 65 <= b < 91 or 97 <= b < 123 or b > 127
    marks = b".,;:!?'\"()-"
    symbol = lambda b: 33 <= b < 127 and not letters(b) and not 48 <= b < 58 and b not in marks
    run, longest = 0, 0
    for k, b in enumerate(raw):
        run = run + 1 if k and raw[k - 1] == b else 1
        longest = max(longest, run if b not in b" \t\n\x0b\x0c\r" else 0)
    pairs = list(zip(words, words[1:], strict=False))
    n, m, size = len(words), max(len(pairs), 1), len(raw)
    return [
        math.log1p(size), math.log1p(n), sum(map(len, words)) / n, math.log1p(max(map(len, words))), size / (raw.count(b"\n") + 1), sum(65 <= b < 91 for b in raw) / max(sum(letters(b) and b < 128 for b in raw), 1),
        sum(48 <= b < 58 for b in raw) / size, sum(b in marks for b in raw) / size, sum(map(symbol, raw)) / size, raw.count(b"!") / size, sum(b > 127 for b in raw) / size,
        sum(not any(map(letters, w)) for w in words) / n, sum(symbol(w[-1]) or w[-1] in marks for w in words) / n, 1 - len(set(words)) / n, sum(a == b for a, b in pairs) / m, max(Counter(words).values()) / n,
        1 - len(set(pairs)) / m if pairs else 0.0, math.log1p(longest),
    ]


TEXTS = ["", None, " \n\t", "one", "One one ONE two.\n\nThree | four!! $$$ 12", "é é É aaa\x0b--", "x" * 70_000, "the the cat " * 4000, "|" * 9, "tail\n"]


def test_features(spark):
    assert np.allclose(quality.features(TEXTS), [brute_features(t) for t in TEXTS])
    df = spark.createDataFrame([(k, t, "s", None) for k, t in enumerate(TEXTS)], "doc_id long, text string, features string, _text long").repartition(3)
    got = {r["doc_id"]: r for r in quality.text_features(df).collect()}
    assert got[4].asDict().keys() == {"doc_id", "_text", "features"}
    assert all(np.allclose(got[k]["features"], brute_features(t)) for k, t in enumerate(TEXTS))


def test_quality_on_odd_input(spark):
    schema = "doc_id long, text string, score string, weight string, extra int"
    docs = spark.createDataFrame([(k, t, None, None, 7) for k, t in enumerate([*TEXTS, "one"])] + [(None, "one", None, None, 7)], schema)
    rows = quality.text_features(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality(rows, quality.fit_quality(rows, none)).collect()
    assert len(got) == 12 and {r["score"] for r in got} == {0.5} and {r["extra"] for r in got} == {7}
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1), (6, 0), (7, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    model = quality.fit_quality(rows, some)
    got = quality.quality(rows, model).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[3] == scores[10] == scores[None] and scores[0] == scores[1] == scores[2]
    assert quality.quality(rows.limit(0), model).count() == 0


def test_scores_are_sums_of_table_entries(spark):
    random.seed(7)
    texts = [" ".join(random.choices(["junk", "word", "good", "|", "$$$"], k=random.randint(1, 80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t.count("|") < len(t) / 18)) for k, t in enumerate(texts)], "doc_id long, quality int")
    rows = quality.text_features(docs)
    model = quality.fit_quality(rows, labels, bags=3, pairs=3, rounds=40)
    assert len(model.pairs) == 3 and len(model.tables) == len(quality.NAMES)
    for r in quality.quality(rows, model).collect():
        x = quality.features([texts[r["doc_id"]]])[0]  # a last digit may decide about a bin
        cell = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        terms = [t[c] for t, c in zip(model.tables, cell, strict=True)] + [t[cell[i], cell[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True)]
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.base + sum(terms))))) < 1e-9 and abs(r["weight"] - min(terms)) < 1e-9
    again = quality.fit_quality(rows.repartition(5), labels.repartition(2), bags=3, pairs=3, rounds=40)
    assert all(np.allclose(a, b) for a, b in zip(model.tables + model.pair_tables, again.tables + again.pair_tables, strict=True))


def test_trees():
    g, h, n = np.array([1.0, 1, -2, -2, 3]), np.ones(5), np.full(5, 20)
    assert quality.leaves(g, h, n, 3, 10).tolist() == pytest.approx([2 / 3, 2 / 3, -4 / 3, -4 / 3, 3 / 2])
    assert quality.leaves(g, h, n, 2, 60).tolist() == pytest.approx([1 / 6] * 5)
    gain, table = quality.crossed(np.array([[2.0, -2], [-2, 2]]), np.ones((2, 2)))
    assert gain == pytest.approx(8) and table.tolist() == [[1, -1], [-1, 1]]


def test_quality_query(spark):
    """Held-out rows aren't learnt from, and are told apart."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op13_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    tested = [r for r in got if r["doc_id"] in labels and r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in tested)
    assert len(tested) > 50 and right >= 0.95 * len(tested)
