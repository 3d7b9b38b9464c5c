"""Removal of repeated passages, exact over all documents, by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Every such
window is routed by its minimiser, so equal windows meet; consecutive windows with the same
minimiser are a run. Runs whose bytes are equal as a whole (by a 128-bit digest of the bytes)
are one string with several places: all but the first place are repeats. What is left are
different runs around one minimiser. Their texts are dealt to shards; each shard sorts its own
rotations once and keeps its transform, and the transforms are merged by refining the
interleave: in each round the merged transform, cut into symbols of a few bytes, deals the
interleave out anew in stable order, which orders it a symbol deeper. Blocks that stay
together to the window's length have that common prefix: they are the repeated intervals, and
in each the earliest window stays. No suffixes of different shards are sorted together.

A minimiser with very many different surroundings would be one long list. Those are found in a
part of the documents chosen by hash; their windows are routed by the bytes of the whole window
instead, so that only equal windows meet. Which minimisers these are steers the work alone:
the route follows from a window's bytes, and the result is the same for every choice. Where a route
still has more than WIDE bytes of different runs, which their exact sums tell, its runs don't meet in one
task either: each of their windows goes by the digest of its bytes, as those of crowded minimisers do.
So a merge holds at most CHUNK + WIDE bytes, whatever the table's size.

Defined results: a null or empty text has nothing to remove; texts shorter than the window
stay whole; very long texts are read whole, in one piece; rows without an id take no part and
stay whole; rows that repeat an id and a text count as one document and get equal results;
rows that repeat an id with another text are documents of their own, in order of their texts'
digests; an empty table gives an empty table; other columns pass through whatever their names,
but an input column that is named like an output column is replaced.
Where the result is text (``remove_repeats``), a character goes only if all its bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import drop, free_names, give_back, mix, stored

U = np.uint64
ANCHOR = 32
CHUNK, SHARD = 1 << 16, 1 << 14
HELD = 1 << 19
#: Bytes of different runs around one minimiser that are merged; and into how many parts a wider route is dealt.
WIDE, SALTS = 1 << 22, 64
#: One in so many documents is looked at for minimisers with at least CROWD different surroundings there.
LOOK, CROWD = 32, 8
#: An odd multiplier and its inverse modulo 2**64; 256 scattered numbers for the bytes.
P = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(P), -1, 1 << 64))
_letters = mix(np.arange(1, 257, dtype=U) * P)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((P, BACK)):
            step = np.full(n, base, U)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=U)
    return _powers[0], _powers[1]


def digests(pieces: list[bytes]) -> np.ndarray:
    """128 bits of each piece, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)


def runs(texts: list[bytes], length: int, anchor: int, crowded: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each run of windows with one minimiser: text, first start, last start, route, digest of all its bytes (two columns).

    The route is the hash of the minimiser; windows of crowded minimisers (sorted hashes) are
    runs of their own, routed by their digest. Only routes come from the rolling hash; equality is the digest's.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    total, wide = len(data), length - anchor + 1
    if total < length:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U), np.zeros((0, 2), np.int64))
    power, back = _power(total + 1)
    sums = np.zeros(total + 1, U)
    np.cumsum(_letters[data] * power[:total], out=sums[1:], dtype=U)
    grams = mix((sums[anchor:] - sums[:-anchor]) * back[: total - anchor + 1])
    n = len(grams)
    # the upper half of a gram's hash, then its place: the choice depends on the window's bytes alone, whatever surrounds them
    low = U((1 << 32) - 1)
    key = np.concatenate([(grams & ~low) | np.arange(n, dtype=U), np.full(-n % wide, ~U(0))]).reshape(-1, wide)
    # the least key of each window, from least keys up to and from the borders of blocks
    upto = np.minimum.accumulate(key, axis=1).ravel()
    since = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(since[: n - wide + 1], upto[wide - 1 : n]) & low).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    change = np.zeros(len(place) + 1, np.int32)
    fit = sizes >= length
    np.add.at(change, begin[fit], 1)
    np.add.at(change, (begin + sizes - length + 1)[fit], -1)
    start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[start[1:]] != place[start[:-1]]) | (start[1:] != start[:-1] + 1)
    alone = np.zeros(0, np.int64)
    if crowded is not None and len(crowded):
        gram = grams[place[start]]
        single = crowded[np.minimum(np.searchsorted(crowded, gram), len(crowded) - 1)] == gram
        fresh |= single
        alone = np.flatnonzero(single[fresh])
    head = np.flatnonzero(fresh)
    first, last = start[head], start[np.append(head[1:], len(start)) - 1] if len(head) else start
    text = np.searchsorted(begin + sizes, first, side="right")
    whole = digests([joined[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)])
    route = grams[place[first]]
    route[alone] = whole[alone, 0].view(U) ^ whole[alone, 1].view(U)
    return text, first - begin[text], last - begin[text], route, whole


class Transform:
    """The rotations of a shard's strings in order, and the symbol before each; the shard is one stretch of positions."""

    def __init__(self, at: np.ndarray, ahead: dict[int, np.ndarray], before: np.ndarray, symbol: np.ndarray, depth: int):
        # ranks of ever longer prefixes, by joining the ranks of two halves
        rank, span = symbol[at].astype(np.int64), min(ahead, default=depth)
        while span < depth:
            joined = rank << 32 | rank[ahead[span][at] - at[0]]
            rank = np.unique(joined, return_inverse=True)[1]
            span *= 2
        self.order = at[np.argsort(rank, kind="stable")]
        self.before = symbol[before[self.order]]


def common_blocks(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, block) over the joined strings, each with an end mark: rotations in merged order; equal blocks share their first ``depth`` bytes.

    Every string has at least ``depth`` bytes; blocks of rotations that reach an end mark mean nothing.
    """
    step = next(k for k in (4, 3, 2, 1) if depth % k == 0)  # bytes in a symbol
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    codes = np.zeros(total, np.uint64)
    marks = np.zeros(total, bool)
    marks[begin + sizes - 1] = True
    codes[~marks] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + 1
    at = np.arange(total)
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset, size = at - begin[owner], sizes[owner]

    def shifted(by: int) -> np.ndarray:
        return begin[owner] + (offset + by) % size

    gram = codes
    for k in range(1, step):
        gram = gram * U(257) + codes[shifted(k)]
    alphabet, symbol = np.unique(gram, return_inverse=True)
    symbol = symbol.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    before = shifted(-step)
    ahead, span = {}, step
    while span < depth:
        ahead[span] = shifted(span)
        span *= 2
    # shards are stretches of whole strings
    cut = np.unique(np.searchsorted(begin, np.arange(0, total, SHARD), side="right") - 1)[:250]
    bounds = [*begin[cut].tolist(), total]
    shards = [Transform(np.arange(a, b), ahead, before, symbol, depth) for a, b in zip(bounds, bounds[1:], strict=False)]
    order, behind = (np.concatenate([getattr(s, x) for s in shards]) for x in ("order", "before"))

    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    block, merged = np.zeros(total, np.int32), np.empty_like(behind)
    for _ in range(depth // step):
        merged[np.argsort(interleave, kind="stable")] = behind
        deal = np.argsort(merged, kind="stable")
        interleave, inner, outer = interleave[deal], block[deal], merged[deal]
        many = block[-1]
        block = np.zeros(total, np.int32)
        np.cumsum((outer[1:] != outer[:-1]) | (inner[1:] != inner[:-1]), out=block[1:])
        if block[-1] == many:
            break  # no block was parted, so none will be
    out = np.empty(total, np.int64)
    out[np.argsort(interleave, kind="stable")] = order
    return out, block


def repeated_windows(strings: list[bytes], docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of all windows of which an earlier one is in the strings; docs, keys and starts tell where a string is from."""
    position, block = common_blocks(strings, length)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begin, position, side="right") - 1
    offset = position - begin[owner]
    keep = offset + length < sizes[owner]
    block, owner, offset = block[keep], owner[keep], offset[keep]
    order = np.lexsort((starts[owner] + offset, keys[owner], docs[owner], block))
    block, owner, offset = block[order], owner[order], offset[order]
    again = np.zeros(len(block), bool)
    again[1:] = block[1:] == block[:-1]
    return owner[again], offset[again]


#: kind 0: a run that waits; 1: bytes a to b go; 2: a run around a contested minimiser. A document is (doc, key): its id and a digest of its text.
ROWS = "kind int, anchor long, w1 long, w2 long, doc long, key long, a long, b long"
_names = ["kind", "anchor", "w1", "w2", "doc", "key", "a", "b"]


def text_key(text: Column) -> Column:
    """Tells texts with one id apart: 60 bits of their SHA-256."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], _names)


def _differ(cols: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return out


def _gone(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Bytes to remove, joined where they meet."""
    order = np.lexsort((b, a, key, doc))
    doc, key, a, b = doc[order], key[order], a[order], b[order]
    other, far = _differ([doc, key]), b.copy()
    if len(doc):
        turn = np.cumsum(other) * (int(b.max()) + 1)
        far = np.maximum.accumulate(b + turn) - turn
    fresh = other.copy()
    fresh[1:] |= a[1:] > far[:-1]
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
    spread = mix(doc[head].astype(U) ^ mix(key[head].view(U))).view(np.int64)  # these rows only pass through the exchange
    none = np.zeros(len(head), np.int64)
    return _batch(1, spread, none, none, doc[head], key[head], a[head], far[tail])


def _settled(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different runs in order of (anchor, digest, document, first start), and which of them are not the first of their kind.

    Rows that repeat an id and a text bring the same run at the same place again; that is one run, no repeat.
    """
    order = np.lexsort(cols[5::-1])
    cols = [c[order] for c in cols]
    fresh = _differ(cols[:6])
    cols = [c[fresh] for c in cols]
    return cols, ~_differ(cols[:3])


def _once(held: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """A task's runs: repeats go, and of each kind the first waits."""
    cols, again = _settled([np.concatenate(c) for c in zip(*held, strict=True)])
    yield _gone(cols[3][again], cols[4][again], cols[5][again], cols[6][again] + length)
    yield _batch(0, *(c[~again] for c in cols))


def _crowded(docs: DataFrame, length: int, anchor: int) -> np.ndarray:
    """Hashes of minimisers with many different surroundings, from one in LOOK documents.

    At most one hash for each CROWD runs looked at, and no more than 100,000: the number asked for rises with the runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, texts in slices(whole, "text", 1 << 20):
                _, _, _, route, digest = runs([(t or "").encode() for t in texts], length, anchor)
                pairs = np.unique(np.column_stack([route.view(np.int64), digest[:, 0]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["anchor", "w1"])

    looked = stored(docs.where(F.pmod(F.xxhash64("doc", "key"), F.lit(LOOK)) == 0).select("text").mapInArrow(give_back(run), "anchor long, w1 long"), "repeat-look")
    least = max(CROWD, looked.count() // 100_000)
    found = looked.distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("anchor").collect()
    drop(looked)
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(U))


def _asked(runs: DataFrame) -> DataFrame:
    """The runs of each document, whose bytes are wanted."""
    return runs.groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("runs"))


def repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """doc, key, spans: for each document (an id and its text's ``text_key``) with repeats, the stretches (a, b) of bytes to remove."""
    text = F.col(f"`{text_col}`").cast("string")
    docs = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_key(text).alias("key"), text.alias("text"))
    anchor = min(ANCHOR, length)
    crowded = df.sparkSession.sparkContext.broadcast(_crowded(docs, length, anchor))  # at most 100,000 numbers

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        for whole in batches:
            for batch, texts in slices(whole, "text", 1 << 20):
                ids, keys = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
                text, first, last, route, digest = runs([(t or "").encode() for t in texts], length, anchor, crowded.value)
                held.append((route.view(np.int64), digest[:, 0], digest[:, 1], ids[text], keys[text], first, last))
                count += len(text)
                if count > HELD:
                    yield from _once(held, length)
                    held, count = [], 0
        if held:
            yield from _once(held, length)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in full order: the first run of each digest stays; it is contested if its route has another digest. One row is held."""
        last: list[np.ndarray] | None = None  # the last run that stayed
        sent = False

        for batch in batches:
            waits = np.asarray(batch.column(0)) == 0
            if not waits.all():
                yield batch.filter(pa.array(~waits))
            cols = [np.asarray(batch.column(k))[waits] for k in range(1, 8)]
            if not len(cols[0]):
                continue
            n = len(cols[0])
            if last is not None:
                cols = [np.concatenate([x, c]) for x, c in zip(last, cols, strict=True)]
            fresh = _differ(cols[:3])
            # rows that repeat an id and a text bring a run twice; it is compared with the first run of its kind
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
            again = ~fresh & np.any([c != c[head] for c in cols[3:6]], axis=0)
            if again.any():
                yield _gone(*(c[again] for c in cols[3:6]), cols[6][again] + length)
            stay = np.flatnonzero(fresh)
            route = cols[0][stay]
            same = np.zeros(len(stay) + 1, bool)
            same[1:-1] = route[1:] == route[:-1]
            contested = same[1:] | same[:-1]
            old = len(cols[0]) > n  # the first row was there before
            if old and len(stay) and sent:
                contested[0] = False
            ready = stay[contested]
            if len(ready):
                yield _batch(2, *(c[ready] for c in cols))
            sent = bool(contested[-1]) or (sent and old and len(stay) == 1)
            last = [c[stay[-1:]] for c in cols]

    # in full order, so that a route's runs stream by in bounded memory
    order = ["anchor", "w1", "w2", "doc", "key", "a"]
    routed = docs.mapInArrow(give_back(local), ROWS).repartition("anchor").sortWithinPartitions(*order)
    marks = stored(routed.mapInArrow(give_back(meet), ROWS), "repeat-marks")

    runs_left = marks.where("kind = 2")
    wide = stored(runs_left.groupBy("anchor").agg(F.sum(F.col("b") - F.col("a") + length).alias("n")).where(F.col("n") > WIDE).select("anchor"), "repeat-wide")
    by_window = None
    if not wide.isEmpty():
        salt = F.pmod(F.xxhash64("doc", "a"), F.lit(SALTS)).cast("int").alias("s")
        salted, several = runs_left.select("*", salt), wide.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        by_window = _asked(salted.join(several, ["anchor", "s"], "left_semi"))
        runs_left = salted.join(several, ["anchor", "s"], "left_anti")
    asked = _asked(runs_left)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text", 1 << 20):
                out = []
                for doc, key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    out += [(r["anchor"], doc, key, r["a"], raw[r["a"] : r["b"] + length]) for r in wanted]
                if out:
                    kinds = (*[pa.int64()] * 4, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "doc", "key", "a", "piece"])

    pieces = docs.join(asked, ["doc", "key"]).mapInArrow(give_back(cut), "anchor long, doc long, key long, a long, piece binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int]] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            strings = list(held)
            docs, keys, starts = (np.array(c, np.int64) for c in zip(*held.values(), strict=True))
            k, offset = repeated_windows(strings, docs, keys, starts, length)
            return _gone(docs[k], keys[k], starts[k] + offset, starts[k] + offset + length).select(["doc", "key", "a", "b"])

        for batch in batches:
            for route, doc, key, a, piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size > CHUNK and route != last:  # equal windows have one route, so a chunk of whole routes is enough
                    yield flush()
                    held, size = {}, 0
                # equal texts under one route are settled before; under two they hold different windows
                if piece not in held:
                    held[piece], size = (doc, key, a), size + len(piece) + 1
                elif (doc, key, a) < held[piece]:
                    held[piece] = (doc, key, a)
                last = route
        if held:
            yield flush()

    merged = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(give_back(merge), "doc long, key long, a long, b long")
    spans = marks.where("kind = 1").select("doc", "key", "a", "b").union(merged)
    if by_window is not None:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each window of the runs asked for as a run that is routed by its own digest."""
            held: list[tuple] = []
            for whole in batches:
                for batch, texts in slices(whole, "text", 1 << 18):
                    for doc, key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
                        raw = (text or "").encode()
                        at = np.unique(np.concatenate([np.arange(r["a"], r["b"] + 1) for r in wanted]))
                        two = digests([raw[k : k + length] for k in at.tolist()])
                        held.append((two[:, 0], two[:, 0], two[:, 1], np.full(len(at), doc), np.full(len(at), key), at, at))
                    if sum(len(h[0]) for h in held) > HELD:
                        yield from _once(held, length)
                        held = []
            if held:
                yield from _once(held, length)

        single = docs.join(by_window, ["doc", "key"]).mapInArrow(give_back(windows), ROWS).repartition("anchor").sortWithinPartitions(*order)
        spans = spans.union(single.mapInArrow(give_back(meet), ROWS).where("kind = 1").select("doc", "key", "a", "b"))
    return spans.groupBy("doc", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _joined(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], min(s["b"], size)) for s in spans or []):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the characters all of whose bytes go."""
    kept, at = [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
            if raw[b] & 0xC0 != 0x80:
                break
        kept.append(raw[at:a])
        at = max(a, b)
    return b"".join([*kept, raw[at:]]).decode()


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """df with the text that is kept, and n_bytes (before), n_removed, n_spans and kept (all remaining bytes, binary)."""
    new = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    fields = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    doc, key, spans = free_names(df, "doc", "key", "spans")
    found = repeats(df, id_col=id_col, text_col=text_col, length=length).toDF(doc, key, spans)
    own = df.select(*(f"`{f.name}`" for f in fields), F.col(f"`{id_col}`").cast("long").alias(doc), text_key(F.col(f"`{text_col}`").cast("string")).alias(key))
    both = own.join(found, [doc, key], "left").select(*(f"`{f.name}`" for f in fields), spans)
    place = [f.name for f in fields].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, text_col):
                kept, facts, left = [], [], []
                for text, found in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    gone = _joined(found, len(raw))
                    ends = [0, *(x for s in gone for x in s), len(raw)]
                    left.append(b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]))
                    kept.append(_whole_characters(raw, gone) if gone else text)
                    facts.append((len(raw), len(raw) - len(left[-1]), len(gone)))
                columns = [*batch.columns[:-1]]
                columns[place] = pa.array(kept, pa.string())
                columns += [pa.array(c, pa.int64()) for c in zip(*facts, strict=True)] + [pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields + new])

    return both.mapInArrow(run, T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in fields), *new]))
