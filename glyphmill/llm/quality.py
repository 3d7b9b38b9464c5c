"""Quality by a generalised additive model with pairwise interactions.

A text becomes a row of numbers: lengths, shares of kinds of characters, repetition of words and
of pairs of words, taken from the whole text. Texts are read once and don't move; the rows of
numbers are stored, and labels meet those.

The model is a lookup table for each number and for a few pairs of numbers. Numbers are cut
into bins at quantiles of the sample. Boosting goes round the numbers in turn; each step is a tree
of at most three leaves over the bins of one number, fitted to the gradient of the logistic loss,
and is added to that number's table. Then all pairs are tried on what is left, and the best get
tables of their own in the same way, from trees that cut each number once. Several bags of the sample are fitted by
tasks of their own, each until its left-out rows get no better, and their tables are averaged. A score is a
sum of table entries, added bin by bin for a batch at once; the term that speaks most against a text is its evidence.

Fitting takes a bounded sample of the labelled rows (``sample``, the documented bound).

Defined results: null and empty texts are a row of zeros and are scored like others; very long texts are
read whole; labels that are null, rows of unknown documents and repeated label rows (the largest
label counts) are harmless, and an id that has several texts is an example for each; without
labelled rows every score is 0.5; rows without an id are scored like others; equal texts get equal scores;
an empty table gives no row; other columns pass through, and those named like an output column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import free_names, give_back, mix, word_hashes

NAMES = (
    "bytes", "words", "word_length", "longest_word", "line_length", "upper", "digits", "marks", "symbols", "exclamations", "beyond_ascii", "bare_words",
    "marked_words", "repeated_words", "same_as_before", "commonest_word", "repeated_pairs", "longest_run",
)

_kind = {name: np.zeros(256, bool) for name in ("upper", "letter", "digit", "mark", "symbol", "space")}
_kind["upper"][65:91] = True
_kind["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_kind["digit"][48:58] = True
_kind["mark"][[*b".,;:!?'\"()-"]] = True
_kind["space"][[0x20, *range(0x09, 0x0E)]] = True
_kind["symbol"][33:127] = True
_kind["symbol"] &= ~(_kind["letter"] | _kind["digit"] | _kind["mark"])


def _commonest(owner: np.ndarray, code: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many distinct codes it has, and how often the commonest stands."""
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(code)))
    most = np.zeros(count)
    np.maximum.at(most, owner[head], times)
    return np.bincount(owner[head], minlength=count), most


def features(texts: list[str | None]) -> np.ndarray:
    """A row of NAMES for each text."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    whole = b"\n".join(raw) + b"\n"
    size = np.array([len(r) for r in raw])
    end = np.cumsum(size + 1) - 1
    begin = end - size
    data = np.frombuffer(whole, np.uint8)

    def share(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[end] - upto[begin]

    space = _kind["space"][data]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edges[::2], edges[1::2]
    owner = np.searchsorted(end, start)
    length = stop - start
    letters, marked = _kind["letter"][data], _kind["symbol"][data] | _kind["mark"][data]
    upto = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    bare = upto[stop] == upto[start]
    words = np.bincount(owner, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    _, code = word_hashes(whole.lower())
    distinct, most = _commonest(owner, code, n)
    next_ = owner[1:] == owner[:-1]
    again = np.bincount(owner[1:][next_ & (code[1:] == code[:-1])], minlength=n)
    pairs = np.bincount(owner[1:][next_], minlength=n)
    pairs_distinct, _ = _commonest(owner[1:][next_], mix(code[:-1] * np.uint64(3) + code[1:])[next_], n)
    turn = np.flatnonzero(np.r_[True, data[1:] != data[:-1]])
    run = np.zeros(n)
    np.maximum.at(run, np.searchsorted(end, turn), np.where(space[turn], 0, np.diff(np.append(turn, len(data)))))

    some, some_words, some_pairs = np.maximum(size, 1), np.maximum(words, 1), np.maximum(pairs, 1)
    ascii_letters = share(letters & (data < 128))
    out = [
        np.log1p(size), np.log1p(words), np.bincount(owner, length, n) / some_words, np.log1p(longest), size / (share(data == 10) + 1), share(_kind["upper"][data]) / np.maximum(ascii_letters, 1),
        share(_kind["digit"][data]) / some, share(_kind["mark"][data]) / some, share(_kind["symbol"][data]) / some, share(data == 33) / some, share(data > 127) / some,
        np.bincount(owner[bare], minlength=n) / some_words, np.bincount(owner[marked[stop - 1]], minlength=n) / some_words, 1 - distinct / some_words, again / some_pairs, most / some_words,
        np.where(pairs > 0, 1 - pairs_distinct / some_pairs, 0), np.log1p(run),
    ]
    return np.where((words > 0)[:, None], np.column_stack(out), 0.0)


def text_features(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input without the text, and ``features`` (array<double>, in order of NAMES)."""
    spare = free_names(df, "text")[0]
    keep = [c for c in df.columns if c not in (text_col, "features")]
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(spare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, spare, 1 << 20):
                x = features(texts)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*keep, "features"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.drop(spare).dtypes)
    return rows.mapInArrow(give_back(run), f"{schema}{', ' if schema else ''}features array<double>")


def leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, most: int, least: int) -> np.ndarray:
    """The value of each bin by a tree of at most ``most`` leaves that hold at least ``least`` rows: gradient over curvature, a unit added."""
    cuts = [0, len(g)]
    for _ in range(most - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            gain[(ns < least) | (ns[-1] - ns < least)] = 0
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), a + k + 1))
        if best[1] < 0:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Of a table of two numbers: the gain of the best cross of one cut in each, and the values of its four leaves."""
    gs, hs = (x.cumsum(0).cumsum(1) for x in (g, h))

    def corners(s: np.ndarray) -> list[np.ndarray]:
        a, down, right = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
        return [a, down - a, right - a, s[-1, -1] - down - right + a]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gc, hc = corners(gs), corners(hs)
    gain = sum(a**2 / (b + 1) for a, b in zip(gc, hc, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [a[i, j] / (b[i, j] + 1) for a, b in zip(gc, hc, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j] - gs[-1, -1] ** 2 / (hs[-1, -1] + 1)), out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def boosted(codes: list[np.ndarray], shapes: list[tuple[int, ...]], y: np.ndarray, start: np.ndarray, bag: int, rate: float, rounds: int, patience: int) -> list[np.ndarray]:
    """Tables of one bag: round after round over all terms, up to the round that suits the left-out fifth best."""
    left = np.random.default_rng(bag).random(len(y)) < 0.2
    use = np.flatnonzero(~left)
    tables = [np.zeros(s) for s in shapes]
    best, since, keep = np.inf, 0, [t.copy() for t in tables]
    at, total = [c[use] for c in codes], start.copy()
    counts = [np.bincount(a, minlength=int(np.prod(s))) for a, s in zip(at, shapes, strict=True)]
    for _ in range(rounds):
        for k, s in enumerate(shapes):
            p = sigmoid(total[use])
            g, h = (np.bincount(at[k], x, counts[k].size) for x in (y[use] - p, p * (1 - p)))
            step = leaves(g, h, counts[k], 3, 10) if len(s) == 1 else crossed(g.reshape(s), h.reshape(s))[1]
            tables[k] += rate * step
            total += rate * step.ravel()[codes[k]]
        check = left if left.any() else ~left
        p = np.clip(sigmoid(total[check]), 1e-9, 1 - 1e-9)
        loss = float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
        since += 1
        if loss < best - 1e-5:
            best, since, keep = loss, 0, [t.copy() for t in tables]
        if since >= patience:
            break
    return keep


@dataclass
class QualityModel:
    """Bins and tables; of a fixed size."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def terms(self, x: np.ndarray) -> np.ndarray:
        """The table entry of each term for each row."""
        b = self.bins(x)
        return np.column_stack([*(t[b[k]] for k, t in enumerate(self.tables)), *(t[b[i], b[j]] for (i, j), t in zip(self.pairs, self.pair_tables, strict=True))])


def fit_quality(
    rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = 20_000, bins: int = 32, bags: int = 8, pairs: int = 8, rate: float = 0.1, rounds: int = 300, patience: int = 25
) -> QualityModel:
    """``rows`` holds ids and features; ``labels`` the rows that may be learnt from, of which ``sample``, chosen by hash, are used."""
    spark = rows.sparkSession
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(sample)
    known = rows.select(F.col(f"`{id_col}`").alias("id"), "features").join(F.broadcast(chosen), "id").distinct()  # at most `sample` rows of two numbers
    found = known.orderBy(F.xxhash64("id"), "id", "features").limit(sample).toArrow()  # bounded by `sample`
    if not found.num_rows:
        return QualityModel()
    x = np.array(found.column("features").to_pylist())
    y = (found.column("y").to_numpy() > 0).astype(float)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    model = QualityModel(float(np.log(rate_1 / (1 - rate_1))), [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T])
    codes = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    # `sample` rows of a byte for each number
    sent = spark.sparkContext.broadcast((np.column_stack(codes).astype(np.uint8 if bins <= 256 else np.uint16), y))

    def averaged(shapes: list[tuple[int, ...]], picked: list[tuple[int, int]], start: np.ndarray) -> list[np.ndarray]:
        """The bags, a task each."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grid, truth = sent.value
            own = [grid[:, i].astype(np.int64) * (sizes[j] if i != j else 1) + (grid[:, j] if i != j else 0) for i, j in picked]
            for frame in frames:
                for bag in frame["id"].tolist():
                    tables = boosted(own, shapes, truth, start, bag, rate, rounds, patience)
                    yield pd.DataFrame({"bag": bag, "term": range(len(tables)), "table": [t.ravel().tolist() for t in tables]})

        got = spark.range(0, bags, 1, bags).mapInPandas(run, "bag long, term int, table array<double>").orderBy("bag", "term").collect()  # tables of a fixed size
        return [np.mean([r["table"] for r in got if r["term"] == k], axis=0).reshape(s) for k, s in enumerate(shapes)]

    alone = [(k, k) for k in range(len(sizes))]
    model.tables = averaged([(s,) for s in sizes], alone, np.full(len(y), model.base))
    start = model.base + model.terms(x).sum(axis=1)

    both = [(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes))]

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid, truth = sent.value
        p = sigmoid(start)
        for frame in frames:
            gains = []
            for k in frame["id"].tolist():
                i, j = both[k]
                code, shape = grid[:, i].astype(np.int64) * sizes[j] + grid[:, j], (sizes[i], sizes[j])
                g, h = (np.bincount(code, w, shape[0] * shape[1]).reshape(shape) for w in (truth - p, p * (1 - p)))
                gains.append(crossed(g, h)[0])
            yield pd.DataFrame({"pair": frame["id"], "gain": gains})

    gains = spark.range(0, len(both), 1, bags).mapInPandas(tried, "pair long, gain double").toPandas().sort_values(["gain", "pair"], ascending=[False, True])
    model.pairs = [both[k] for k in gains["pair"].head(pairs).tolist()]
    model.pair_tables = averaged([(sizes[i], sizes[j]) for i, j in model.pairs], model.pairs, start) if model.pairs else []
    sent.unpersist()
    return model


def quality(rows: DataFrame, model: QualityModel) -> DataFrame:
    """The input without its features, with ``score`` (0 to 1), ``against`` (the term that speaks most against the text) and ``weight`` (what it adds to the logit)."""
    keep = [c for c in rows.columns if c not in ("features", "score", "against", "weight")]
    names = [*NAMES, *(f"{NAMES[i]} and {NAMES[j]}" for i, j in model.pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy().reshape(-1, len(NAMES))
            terms = model.terms(x) if model.tables else np.zeros((len(x), len(NAMES)))
            worst = terms.argmin(axis=1)
            score = sigmoid(model.base + terms.sum(axis=1))
            out = [pa.array(score), pa.array([names[k] for k in worst.tolist()], pa.string()), pa.array(terms[np.arange(len(x)), worst])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*keep, "score", "against", "weight"])

    plain = rows.select(*(F.col(f"`{c}`") for c in keep), "features")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in plain.drop("features").dtypes)
    return plain.mapInArrow(run, f"{schema}{', ' if schema else ''}score double, against string, weight double")
