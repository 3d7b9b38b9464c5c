"""Toxicity by the nearest labelled examples.

Fitting takes a bounded sample of the labelled rows (``sample`` and ``sample_chars``, the
documented bounds); each of them is an example, whatever its label, and every word of the
sample is a term. A term's weight in a text is (1 + ln tf) * idf * relevance: document
frequencies count all documents, and the relevance, from the sample's labels, is the term's
likelihood ratio between the two classes, for whichever of them it speaks. No term is left out.

A text is scored by its exact nearest examples by cosine. The index is inverted: posting lists
are cut into blocks of examples with the largest weight of each term in each block, and a
block is opened only if its bound can reach the k-th cosine found so far. Votes weighted by
distance are calibrated by isotonic regression on the sample, each example left out of its own
vote.

Defined results: null and empty texts, and texts that share no term with any example, get the
sample's rate of label 1 among such texts; very long texts are read whole; labels that are
null, rows of unknown documents and repeated label rows (the largest label counts) are
harmless, and an id that has several texts is an example for each; without labelled rows every
score is 0; rows without an id are scored like others; repeated rows get equal scores, and
examples that tie count in order of id and text; an empty table gives no row; other columns
pass through, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, give_back, stored, trim

_word = re.compile(r"[^\W\d_]+")
BLOCK = 32
#: Blocks opened before the first cut.
OPENED = 16


def words_of(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def spans(starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the value of the range that each is from."""
    size = ends - starts
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + size, size), np.repeat(value, size)


class BlockMaxIndex:
    """Unit vectors by term: postings in order of example, cut into blocks of examples; an entry is one term's part of one block."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(examples)
        term = np.concatenate([t for t, _ in examples]) if examples else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in examples])
        weight = np.concatenate([w for _, w in examples]) if examples else np.zeros(0)
        order = np.lexsort((doc, term))
        self.docs, self.weights, term = doc[order].astype(np.int32), weight[order], term[order]
        block = self.docs // BLOCK
        head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.begin = np.append(head, len(term)).astype(np.int64)  # of each entry's postings
        self.block = block[head].astype(np.int32)
        # a bound must not fall short by rounding
        self.most = np.nextafter(np.maximum.reduceat(self.weights, head).astype(np.float32), np.float32(2)) if len(head) else np.zeros(0, np.float32)
        self.entries = np.searchsorted(term[head], np.arange(n_terms + 1)).astype(np.int64)  # of each term
        self.blocks = -(-self.n // BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine (ties to the earlier) and their cosines; only positive ones."""
        entry, share = spans(self.entries[terms], self.entries[terms + 1], weights)
        at = self.block[entry]
        bound = np.bincount(at, share * self.most[entry], self.blocks) * (1 + 1e-5)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, scores, edge = np.zeros(0, np.int64), np.zeros(0), 0.0
        for some in (order[:OPENED], order[OPENED:]):  # the most promising blocks set the edge, then all that can reach it
            mark = np.zeros(self.blocks, bool)
            mark[some[bound[some] >= edge]] = True
            use = np.flatnonzero(mark[at])
            opened = entry[use]
            post, part = spans(self.begin[opened], self.begin[opened + 1], share[use])
            got = np.bincount(self.docs[post], part * self.weights[post], self.n)
            ids = np.flatnonzero(got)
            ids = ids[ids != leave]
            if len(ids) > k:
                ids = ids[got[ids] >= -np.partition(-got[ids], k - 1)[k - 1]]
            found, scores = np.concatenate([found, ids]), np.concatenate([scores, got[ids]])
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            edge = scores[-1] if len(scores) == k else 0.0
        return found, scores


def arranged(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> list[int]:
    """An order in which blocks hold examples that are alike, which makes their bounds sharp: halved along the widest of six main directions of the heaviest terms."""
    total = np.zeros(n_terms)
    for t, w in vectors:
        total[t] += w * w
    heavy = np.argsort(-total, kind="stable")[:256]
    place = np.full(n_terms, -1)
    place[heavy] = np.arange(len(heavy))
    dense = np.zeros((len(vectors), len(heavy)))
    for i, (t, w) in enumerate(vectors):
        p = place[t]
        dense[i, p[p >= 0]] = w[p >= 0]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    spread = dense - dense.mean(axis=0)
    flat = dense @ np.linalg.eigh(spread.T @ spread)[1][:, -6:]
    out, waiting = [], [np.arange(len(vectors))]
    while waiting:
        part = waiting.pop()
        if len(part) <= BLOCK:
            out += part.tolist()
            continue
        part = part[np.argsort(flat[part, np.argmax(flat[part].var(axis=0))], kind="stable")]
        half = -(-len(part) // (2 * BLOCK)) * BLOCK
        waiting += [part[half:], part[:half]]
    return out


@dataclass
class ToxicityModel:
    """Terms, weights, index and calibration; its size is bounded by the sample's text."""

    ids: dict[str, int]
    weight: np.ndarray
    index: BlockMaxIndex | None
    labels: np.ndarray
    example_ids: list
    k: int
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, of unit length."""
        get = self.ids.get
        found = [t for w in words_of(text) if (t := get(w)) is not None]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, times = np.unique(np.array(found, np.int64), return_counts=True)
        return terms, unit(times, self.weight[terms])

    def near(self, text: str | None, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        terms, weights = self.vector(text)
        return self.index.nearest(terms, weights, self.k, leave) if self.index and len(terms) else (np.zeros(0, np.int64), np.zeros(0))

    def vote(self, found: np.ndarray, scores: np.ndarray) -> float:
        weight = 1 / (0.1 + (1 - scores))
        return float((weight * self.labels[found]).sum() / weight.sum())

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        found, scores = self.near(text)
        return float(np.interp(self.vote(found, scores), *self.steps)) if len(found) else self.base, found, scores


def unit(times: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = (1 + np.log(times)) * weight
    return w / max(math.sqrt(float((w * w).sum())), 1e-300)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through (x, y) by pooling neighbours that are out of order, as points to interpolate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, n
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a1, b1, n1 = pools.pop()
            pools[-1] = [pools[-1][0] + a1, pools[-1][1] + b1, pools[-1][2] + n1]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * 0.1) / (p[2] + 0.1) for p in pools])


def relevance(with1: np.ndarray, with0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio of a term's presence between the classes, by the documents of each that hold it; 1 more, so that no term weighs nothing."""

    def side(a: np.ndarray, n: float, q: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / np.maximum(n * q, 1e-300)), 0.0)

    q = (with1 + with0) / max(n1 + n0, 1)
    return 1 + 2 * np.maximum(side(with1, n1, q) + side(n1 - with1, n1, 1 - q) + side(with0, n0, q) + side(n0 - with0, n0, 1 - q), 0)


def _frequencies(docs: DataFrame, sent: Broadcast, size: int) -> tuple[np.ndarray, int]:
    """Of all documents: how many hold each term, and how many there are."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total, n = sent.value.get, np.zeros(size, np.int64), 0
        for batch in frames:
            for text in batch.column(0).to_pylist():
                n += 1
                total[[t for w in set(words_of(text)) if (t := get(w)) is not None]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))], ["t", "n"])

    found = docs.select("text").mapInArrow(give_back(count), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    t, n = found.column("t").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(size, np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return out, int(n[t < 0].sum())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4_000, sample_chars: int = 16_000_000, k: int = 15
) -> ToxicityModel:
    """``labels`` holds the rows that may be learnt from; ``sample`` of them, chosen by hash, are used. If their texts have more than ``sample_chars`` characters together, the longest of them are left out, so that no text takes the place of others."""
    spark = docs.sparkSession
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(sample)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    whole = rows = stored(plain.join(F.broadcast(chosen), "id").distinct(), "toxicity-sample")  # at most `sample` rows of two numbers
    size = F.coalesce(F.length("text"), F.lit(0))
    over = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > sample_chars
    if over:
        upto = Window.orderBy(size, F.xxhash64("id"), "id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fits = rows.select("id", F.xxhash64("text").alias("h"), F.sum(size).over(upto).alias("upto")).where(F.col("upto") <= sample_chars)  # three numbers for each row of the sample
        rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(fits), ["id", "h"], "left_semi").drop("h")
    rows = rows.select("id", "y", "text")

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            tallies = [sorted(Counter(words_of(t)).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[w for w, _ in t] for t in tallies], pa.list_(pa.string())), pa.array([[n for _, n in t] for t in tallies], pa.list_(pa.int32()))], ["id", "y", "words", "times"]
            )

    kind = dict(rows.dtypes)["id"]
    table = rows.mapInArrow(give_back(counted), f"id {kind}, y int, words array<string>, times array<int>").toArrow()  # bounded by `sample` and `sample_chars`
    if not table.num_rows:
        return ToxicityModel({}, np.zeros(0), None, np.zeros(0), [], k)
    y = (table.column("y").to_numpy() > 0).astype(int)
    flat = pc.list_flatten(table.column("words")).combine_chunks().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    words = flat.dictionary.to_pylist()
    ids = {w: t for t, w in enumerate(sorted(words))}  # nothing hangs on the order of rows
    term = np.array([ids[w] for w in words], np.int64)[flat.indices.to_numpy()]
    times = pc.list_flatten(table.column("times")).to_numpy()
    sizes = pc.fill_null(pc.list_value_length(table.column("words")), 0).to_numpy()
    owner = np.repeat(np.arange(len(y)), sizes)

    told = spark.sparkContext.broadcast(ids)
    spread, n_docs = _frequencies(plain, told, len(ids))
    told.unpersist()
    n1 = int(y.sum())
    weight = (np.log((1 + n_docs) / (1 + spread)) + 1) * relevance(*(np.bincount(term[y[owner] == c], minlength=len(ids)) for c in (1, 0)), n1, len(y) - n1)
    ends = np.cumsum(sizes)
    vectors = [(term[a:b], unit(times[a:b], weight[term[a:b]])) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    own = table.column("id").to_pylist()
    # the rows come in any order; ids, then texts, put them in one
    some = sorted((i for i in range(len(y)) if sizes[i]), key=lambda i: (own[i], vectors[i][0].tolist()))
    order = [some[i] for i in arranged([vectors[i] for i in some], len(ids))] if some else []
    empty = y[sizes == 0]
    model = ToxicityModel(
        ids, weight, BlockMaxIndex([vectors[i] for i in order], len(ids)) if order else None, y[order].astype(float), [own[i] for i in order], k, float((empty.sum() + 0.05) / (len(empty) + 1))
    )
    drop(whole)
    examples = [vectors[i] for i in order]
    del table, flat, words, term, times, owner, vectors, some
    trim()
    if order:
        model.steps = _calibration(spark, model, examples)
    return model


def _calibration(spark, model: ToxicityModel, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each example's vote without itself, against its label; the votes are taken by tasks."""
    sent = spark.sparkContext.broadcast(pickle.dumps((model.index, model.labels, model.k, vectors)))
    vectors, count = None, len(vectors)
    trim()

    def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, labels, k, own = pickle.loads(sent.value)
        judge = ToxicityModel({}, np.zeros(0), index, labels, [], k)
        for frame in frames:
            found = [(i, *index.nearest(*own[i], k, leave=i)) for i in frame["id"].tolist()]
            yield pd.DataFrame({"id": [i for i, f, _ in found if len(f)], "vote": [judge.vote(f, c) for _, f, c in found if len(f)]}).astype({"id": "int64", "vote": "float64"})

    rows = spark.range(0, count, 1, spark.sparkContext.defaultParallelism).mapInPandas(votes, "id long, vote double").toPandas()  # one for each example
    sent.unpersist()
    if not len(rows):
        return np.zeros(1), np.full(1, float(model.labels.mean()))
    rows = rows.sort_values("id")
    return isotonic(rows["vote"].to_numpy(), model.labels[rows["id"].to_numpy()])


def toxicity(text: Column, model: ToxicityModel, spark) -> Column:
    """A struct of score, example_ids and cosines (the evidence) for a text column."""
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    trim()
    state: dict = {}

    @F.pandas_udf("score double, example_ids array<string>, cosines array<double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = state.get("model") or state.setdefault("model", pickle.loads(sent.value))
        for column in texts:
            out = [own.score(t if isinstance(t, str) else "") for t in column]
            yield pd.DataFrame({
                "score": [min(1.0, max(0.0, s)) for s, _, _ in out],
                "example_ids": [[str(own.example_ids[i]) for i in f.tolist()] for _, f, _ in out],
                "cosines": [c.tolist() for _, _, c in out],
            })

    return score(text)
