"""N-gram Jaccard join by a grouped prefix join.

A document is its set of distinct word shingles, told apart by their words and named by 64-bit
tokens; a set is named by a 128-bit digest made of the cryptographic digests of its words. In one
global order, with very common shingles last, two sets that reach the threshold share a token within
a short prefix. Documents with equal sets are one member; members with the same prefix and size are
one group. An inverted index over group prefixes gives pairs of groups, which are filtered by
size and by the number of shared prefix shingles, then expanded, and the members are verified
on their words: a tile or a batch of pairs numbers its words and shingles anew, by the words
themselves, so that hashes only propose.

Long lists would pair all members of a family of near copies. Their shingles become cells:
members are dealt to tiles of two blocks, and each tile counts overlaps as a matrix product. A
pair belongs to the smallest cell that it shares, and within a cell to one tile, so every pair
that shares a prefix shingle is verified and every link comes out once. A first round of tiles
without texts finds the members that have a pair to verify there, by sizes, cells and a bound
from their prefixes, and texts are sent to those alone. A tile returns its links as lists of neighbours, a row for each document, with their
numbers and a spanning forest, which is all that the components need. Which shingles become
cells only steers the work; the result doesn't depend on it.

Defined results: null, empty and blank texts have the empty set and link with nothing; with
fewer words than a shingle the whole sequence is one; very long texts are read whole; rows that
repeat a text, with whatever ids, are linked; rows that repeat an id with another text are
documents of their own, and all rows of an id that are linked with anything lie in components
of their own texts; rows without an id get no component of their own, but that of equal texts;
a document without links is its own component; an empty table gives an empty table; other
columns take no part, whatever their names. The links of a row are all other rows with an id
that reach the threshold, repeats of its own text among them; for rows without an id their
number is null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop, give_back, mix, stored
from .components import components

U = np.uint64
#: Odd multipliers; any would do.
P, A, C = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xE7037ED1A0B428DB)
COUNTED = 2_000_000
#: Lists longer than this are cells.
LISTED = 256
#: How many of the smaller cells the first round of tiles looks at; the second looks at all.
LEAD = 16


def shingles(texts: list[str | None], size: int) -> list[tuple[np.ndarray, bytes]]:
    """Of each text the sorted tokens of its distinct shingles, and a digest of their set.

    A word has a 128-bit digest, a shingle two lanes of 64 bits made of its words' digests; the
    first is its token, both go into the digest of the set. Shingles are told apart by their words,
    so there are as many tokens as distinct shingles: those with one token get others in order.
    """
    words, counts = [], []
    for t in texts:
        # bytes.split and bytes.lower know just the contract's white space and letters
        own = (t or "").encode().lower().split()
        words += own
        counts.append(len(own))
    distinct = list(dict.fromkeys(words))
    ids = np.array(list(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, words)), np.int64)
    lanes = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in distinct]), U).reshape(-1, 2)[ids]
    n = max(len(ids) - size + 1, 0)
    runs = np.zeros((2, n), U)
    for k in range(size if n else 0):
        runs[0] = runs[0] * P + lanes[k : k + n, 0]
        runs[1] = runs[1] * A + lanes[k : k + n, 1]
    runs = mix(runs)
    out, at = [], 0
    for count in counts:
        if count >= size:
            out.append(_set(runs[:, at : at + count - size + 1], ids[at : at + count], size))
        elif count:
            one = np.array([count, count], U) * C
            with np.errstate(over="ignore"):
                for lane in lanes[at : at + count]:
                    one = one * np.array([P, A]) + lane
            out.append(_set(mix(one).reshape(2, 1), ids[at : at + count], count))
        else:
            out.append((np.zeros(0, np.int64), b""))
        at += count
    return out


def _set(runs: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, bytes]:
    order = np.argsort(runs[0], kind="stable")
    token = runs[0][order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    again = np.flatnonzero(~fresh)
    one, two = order[again], order[again - 1]
    if all((ids[one + k] == ids[two + k]).all() for k in range(size)):
        token, second = token[fresh], runs[1][order[fresh]]
    else:  # different words, one token
        first = np.unique(ids[np.arange(runs.shape[1])[:, None] + np.arange(size)], axis=0, return_index=True)[1]
        first = first[np.lexsort((runs[1][first], runs[0][first]))]
        token, second = runs[0][first], runs[1][first]
        used: set[int] = set()
        for k, x in enumerate(token.tolist()):
            while x in used:
                x = int(mix(np.array([x], U) + C)[0])
            used.add(x)
            token[k] = x
    digest = hashlib.blake2b(token.tobytes() + second.tobytes(), digest_size=16).digest()
    return np.sort(token.view(np.int64)), digest


def packed(text: str | None) -> bytes:
    """A text's words, one blank between two, in little room."""
    # bytes.split and bytes.lower know just the contract's white space and letters
    return zlib.compress(b" ".join((text or "").encode().lower().split()), 1)


def exact_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of packed texts, none of them empty; shingles have one number if, and only if, they are the same words."""
    index: dict[bytes, int] = {}
    flat, lengths = [], []
    for t in texts:
        found = [index.setdefault(w, len(index)) for w in zlib.decompress(t).split(b" ")]
        found += [-1] * (size - len(found))  # fewer words: the whole sequence
        flat.append(np.array(found, np.int64))
        lengths.append(len(found))
    flat, lengths = np.concatenate(flat), np.array(lengths)
    counts = lengths - size + 1
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(text)) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(counts) + counts, counts)
    code = np.zeros(len(start), U)
    scattered = mix(flat.view(U) + P)
    for k in range(size):
        code = code * P + scattered[start + k]
    order = np.argsort(code, kind="stable")
    start, text, code = start[order], text[order], code[order]
    fresh, same = np.ones(len(code), bool), np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    for k in range(size):
        same[1:] &= flat[start[1:] + k] == flat[start[:-1] + k]
    if (same | fresh).all():
        number = np.cumsum(fresh)
    else:  # a clash of codes: by the words at once
        number = np.unique(flat[start[:, None] + np.arange(size)], axis=0, return_inverse=True)[1].ravel() + 1
    pairs = np.unique(text * (len(number) + 1) + number)
    return pairs // (len(number) + 1), pairs % (len(number) + 1)


def least_overlap(sizes, percent: int):
    """The smallest intersection of two sets with this sum of sizes that reaches the threshold."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _two(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _common(docs: DataFrame, size: int, least: int) -> np.ndarray:
    """Shingles of many documents, the commonest last. Tasks report what they meet three times among COUNTED shingles."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, total = np.unique(np.concatenate(held), return_counts=True)
        keep = total >= 3
        return pa.RecordBatch.from_arrays([pa.array(found[keep]), pa.array(total[keep])], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for whole in batches:
            for _, texts in slices(whole, "text", 1 << 20):
                held.append(np.concatenate([s for s, _ in shingles(texts, size)]))
                if sum(map(len, held)) > COUNTED:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    sums = docs.select("text").mapInArrow(give_back(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # at most (all shingles) / least rows; least grows with the table
    rows = sums.orderBy("n", "token").collect()
    return np.array([r["token"] for r in rows], np.int64)


def _prefix(s: np.ndarray, percent: int, tokens: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in two parts: rare shingles, and common ones (tokens, sorted) by rank."""
    p = prefix_length(len(s), percent)
    if not len(tokens):
        return s[:p], s[:0]
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    hot = tokens[at] == s
    rare = s[~hot][:p]
    return rare, s[hot][np.argsort(ranks[at[hot]])][: p - len(rare)]


def _members(docs: DataFrame, size: int, percent: int, sent: Broadcast) -> DataFrame:
    """Of each row: set size, set hash, group, and, once for each set and task, its prefix in two parts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = sent.value
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch, texts in slices(whole, "text", 1 << 20):
                rows = []
                for s, digest in shingles(texts, size):
                    n = len(s)
                    if not n:
                        rows.append((0, None, None, None, None, None))
                        continue
                    rare, often = _prefix(s, percent, tokens, ranks)
                    one = _two(digest)
                    group = _two(xxhash.xxh3_128_digest(np.concatenate([rare, often, [n]]).tobytes()))[0]
                    if one in seen:
                        rows.append((n, *one, group, None, None))
                    else:
                        if len(seen) < 500_000:
                            seen.add(one)
                        rows.append((n, *one, group, rare, often))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "tk", "n", "s1", "s2", "grp", "rare", "often"])

    return docs.withColumn("tk", F.xxhash64("text")).mapInArrow(give_back(run), f"doc_id {kind}, tk long, n long, s1 long, s2 long, grp long, rare array<long>, often array<long>")


LISTS = "token long, ga long, gb long, na long, nb long"


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Of each list its pairs of groups whose sizes allow a link (token null), or, if it is long, its groups (gb null)."""
    names = LISTS.replace(" long", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, long = None, None  # rows of the last token, at most LISTED; the last token, if its list is long

        def batch(*cols: np.ndarray | None) -> pa.RecordBatch:
            n = next(len(c) for c in cols if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in cols], names)

        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, n, grp = cols
            out, step = [], 1
            left = np.arange(len(token))
            while len(left):  # each row with the step-th row after it
                left = left[left + step < len(token)]
                left = left[(token[left] == token[left + step]) & (100 * n[left] >= percent * n[left + step])]
                if len(left):
                    out.append((left, left + step))
                step += 1
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                swap = grp[a] > grp[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield batch(None, grp[a], grp[b], n[a], n[b])

        for rows in batches:
            cols = [np.asarray(rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in ("token", "n", "grp")]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            fresh = np.ones(len(cols[0]), bool)  # tasks may bring a group more than once
            fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])
            cols = [c[fresh] for c in cols]
            if not len(cols[0]):
                continue
            head = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            count = np.diff(np.append(head, len(cols[0])))
            crowded = np.repeat(count > LISTED, count)
            if long is not None:
                crowded |= cols[0] == long
            if crowded.any():
                yield batch(cols[0][crowded], cols[2][crowded], None, cols[1][crowded], None)
            last = cols[0] == cols[0][-1]  # the last token's list may go on
            yield from pairs([c[~crowded & ~last] for c in cols])
            long = cols[0][-1] if crowded[-1] else None
            rest = None if crowded[-1] else [c[last] for c in cols]
        if rest is not None:
            yield from pairs(rest)

    return postings.repartition("token").sortWithinPartitions("token", "n", "grp").mapInArrow(give_back(run), LISTS)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs (two columns of positions)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = []
    for k, (a, b) in enumerate(pairs.tolist()):
        if (x := top(a)) != (y := top(b)):
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return pairs[keep]


def _overlaps(row: np.ndarray, number: np.ndarray, count: int) -> np.ndarray:
    """The sizes of the intersections of every two of ``count`` sets, given as (row, number)."""
    used, col, times = np.unique(number, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(used), -1)
    place[shared] = np.arange(len(shared))
    col = place[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((count, count), np.float32)  # counts stay below 2**24
    for lo in range(0, len(shared), 2048):
        a, b = np.searchsorted(col, (lo, lo + 2048))
        part = np.zeros((count, min(2048, len(shared) - lo)), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        overlap += part @ part.T
    return overlap.astype(np.int64)


def _meeting(lists: list[np.ndarray]) -> np.ndarray:
    """Which of the lists share a number; one that isn't empty does with itself."""
    sizes = np.array([len(x) for x in lists])
    row = np.repeat(np.arange(len(lists)), sizes)
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(row) else np.zeros(0, np.int64)
    return (_overlaps(row, flat, len(lists)) > 0) | np.diag(sizes > 0)


def _open(frame: pd.DataFrame, column: str, apart: bool) -> np.ndarray:
    """Pairs (upper triangle) that are this tile's: no smaller cell in common, not on one side of a pair of groups, and, in a tile of two blocks, from different ones."""
    kinds, kind = {}, np.empty(len(frame), np.int64)
    for x, key in enumerate(zip(frame[column].map(lambda c: tuple(np.asarray(c).tolist())), frame["tag"].tolist(), strict=True)):
        kind[x] = kinds.setdefault(key, len(kinds))
    tag = np.array([t for _, t in kinds])
    closed = _meeting([np.array(c, np.int64) for c, _ in kinds]) | ((tag[:, None] == tag[None, :]) & (tag[:, None] != 0))
    open_ = np.triu(~closed[kind[:, None], kind[None, :]], 1)
    if apart:
        own = frame["own"].to_numpy()
        open_ &= own[:, None] != own[None, :]
    return open_


SPOTS = "cell long, i int, j int, doc long, own int, tag long, at int"


def _asked(percent: int):
    """The members of a tile that may have a pair there: by their sizes, their first few smaller cells, and what their prefixes share."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key
        open_ = _open(frame, "lead", i != j)
        n = frame["n"].to_numpy(np.int64)
        open_ &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        use = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
        if len(use):
            some, open_ = frame.iloc[use], open_[np.ix_(use, use)]
            n = n[use]
            lists = [np.unique(x) for x in some["sketch"]]
            sizes, whole = (np.array([len(x) for x in c]) for c in (lists, some["sketch"]))
            # shingles of one set that share their 32 bits count as one, so these are added; an empty sketch bounds nothing
            shared = _overlaps(np.repeat(np.arange(len(use)), sizes), np.concatenate(lists), len(use)) + np.minimum(*np.broadcast_arrays((whole - sizes)[:, None], (whole - sizes)[None, :]))
            behind = n - prefix_length(n, percent)
            enough = shared + np.maximum(behind[:, None], behind[None, :]) >= least_overlap(n[:, None] + n[None, :], percent)
            open_ &= enough | (sizes == 0)[:, None] | (sizes == 0)[None, :]
            use = use[open_.any(axis=0) | open_.any(axis=1)]
        some = frame.iloc[use]
        return pd.DataFrame({"cell": cell, "i": i, "j": j, "doc": some["doc"], "own": some["own"], "tag": some["tag"], "at": some["at"]}).astype({"cell": "int64", "i": "int32", "j": "int32"})

    return run


def _tile(size: int, percent: int, every: bool):
    """Of each document, the links that belong to the tile: near, each once, if ``every`` link is asked for; tree, those of a forest; links, the rows at the other ends of all."""

    def rows(doc: np.ndarray, near: list[np.ndarray], tree: list[np.ndarray], links: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"doc": doc, "near": pd.Series(near, dtype=object), "tree": pd.Series(tree, dtype=object), "links": links})

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key
        frame = frame.drop_duplicates("doc")  # rows that repeat an id and a text
        open_ = _open(frame, "before", i != j)
        use = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
        if not len(use):
            return rows(np.zeros(0, np.int64), [], [], np.zeros(0, np.int64))
        frame, open_ = frame.iloc[use], open_[np.ix_(use, use)]
        docs, k = frame["doc"].to_numpy(np.int64), frame["k"].to_numpy(np.int64)
        row, number = exact_sets(frame["packed"].tolist(), size)
        n = np.bincount(row, minlength=len(docs))
        both = _overlaps(row, number, len(docs))
        linked = open_ & (100 * both >= percent * (n[:, None] + n[None, :] - both))
        tree = np.zeros_like(linked)
        kept = _forest(np.column_stack(np.nonzero(linked)))
        tree[kept[:, 0], kept[:, 1]] = True
        links = (linked | linked.T) @ k
        some = np.flatnonzero(links)
        return rows(docs[some], [docs[linked[x]] if every else docs[:0] for x in some], [docs[tree[x]] for x in some], links[some])

    return run


def _linked(docs: DataFrame, *, size: int = 5, percent: int = 80, common_least: int = 64, common_share: int = 2000, block: int = 1024, block_shingles: int = 600_000, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, tk, n, s1, s2 of each row; sets: s1, s2, doc (the set's number), doc_id (its smallest id), k (rows with an id) and more (rows at the other ends of its links); links, tree: as below)."""
    least = max(common_least, docs.count() // common_share)
    common = _common(docs, size, least)
    order = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[order], order))
    rows = stored(_members(docs, size, percent, sent), "jaccard-members")
    found = rows.where("n > 0")
    sets = found.groupBy("s1", "s2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tk"))).alias("first"), F.count("doc_id").alias("k"), F.first("n").alias("n"), F.first("grp").alias("grp"))
    # a set goes by a number of its own, as its id may be that of other sets too
    member = stored(sets.where("first is not null").select("s1", "s2", "k", "n", "grp", "first.*", F.monotonically_increasing_id().alias("doc")), "jaccard-sets")

    postings = found.where("rare is not null").select(F.explode("rare").alias("token"), "n", "grp")
    lists = stored(_pairs(postings, percent), "jaccard-lists")
    own = lists.where("gb is null").select(F.col("ga").alias("grp"), F.col("token").alias("cell"))
    own = own.union(found.where("size(often) > 0").select("grp", F.explode("often"))).groupBy("grp").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    own = stored(own, "jaccard-own")
    # 32 bits of each prefix shingle, for a bound of what two groups share there
    with_cells = found.where("rare is not null").select("grp", "rare", "often").join(own.select("grp"), "grp", "left_semi")
    sketch = with_cells.groupBy("grp").agg(F.first(F.transform(F.concat("rare", "often"), lambda x: x.bitwiseAND((1 << 31) - 1).cast("int"))).alias("sketch"))
    group = member.groupBy("grp").agg(F.count("*").alias("m")).join(own, "grp", "left").select("grp", "m", F.coalesce("cells", F.array().cast("array<long>")).alias("cells"))
    group = stored(group, "jaccard-groups")
    inner = member.select("grp", "doc")

    # pairs of groups: an intersection has the shared prefix shingles, and else only shingles behind the prefix that ends first
    shared = lists.where("gb is not null").groupBy("ga", "gb").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    for x in "ab":
        shared = shared.join(group.selectExpr(f"grp as g{x}", f"m as m{x}", f"cells as cells{x}"), f"g{x}")
    behind = F.greatest(*(F.expr(f"n{x} - (n{x} - ceil({percent} * n{x} / 100) + 1)") for x in "ab"))
    shared = shared.where(F.col("c") + F.least(F.size("cellsa"), F.size("cellsb")) + behind >= F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)))
    shared = stored(shared.where("not arrays_overlap(cellsa, cellsb)").select("ga", "gb", (F.col("ma") * F.col("mb")).alias("m")), "jaccard-groups-near")  # a cell's otherwise
    plain = group.where("size(cells) = 0 and m > 1")
    few = inner.join(plain.where("m <= 32").select("grp"), "grp")
    within = few.withColumnRenamed("doc", "a").join(few.withColumnRenamed("doc", "b"), "grp").where("a < b").select("a", "b")
    across = shared.where("m <= 1024").join(inner.toDF("ga", "a"), "ga").join(inner.toDF("gb", "b"), "gb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(across.union(within).where("a <> b").distinct(), "jaccard-pairs")
    drop(lists)

    # cells: of each group's members, of large groups without cells, and of pairs of large groups
    listed = group.select("grp", "cells", F.posexplode("cells").alias("at", "cell")).select("grp", "cell", F.lit(0).cast("long").alias("tag"), "at", F.expr(f"slice(cells, 1, least(at, {LEAD}))").alias("lead"))
    none = F.array().cast("array<long>").alias("lead")
    large = plain.where("m > 32").select("grp", F.col("grp").alias("cell"), F.lit(0).cast("long").alias("tag"), F.lit(0).alias("at"), none)
    sides = shared.where("m > 1024").select(F.explode(F.array("ga", "gb")).alias("grp"), F.xxhash64("ga", "gb").alias("cell"))
    sides = sides.join(group.select("grp", "cells"), "grp").select("grp", "cell", F.col("grp").alias("tag"), F.size("cells").alias("at"), F.expr(f"slice(cells, 1, {LEAD})").alias("lead"))
    cells = listed.union(large).union(sides).join(sketch, "grp", "left").withColumn("sketch", F.coalesce("sketch", F.array().cast("array<int>"))).join(member.select("grp", "doc", "n"), "grp")
    cells = stored(cells, "jaccard-cells")
    blocks = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
    blocks = blocks.select("cell", F.ceil(F.greatest(F.col("m") / block, F.col("w") / block_shingles)).cast("int").alias("parts"))
    mine = cells.drop("grp").join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int"))
    tiles = mine.select("cell", "doc", "n", "own", "tag", "at", "lead", "sketch", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    tiles = tiles.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))
    spots = stored(tiles.groupBy("cell", "i", "j").applyInPandas(_asked(percent), SPOTS), "jaccard-spots")
    drop(cells, shared)

    asked = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(spots.select("doc")).distinct()
    wanted = stored(member.join(asked, "doc", "left_semi").select("doc", "k", "grp", F.col("doc_id").alias("id"), F.col("tk").alias("t")), "jaccard-wanted")
    keys = wanted.select("id", "t", "doc", "k", "grp")
    small = wanted.count() <= 1_000_000  # 40 bytes each; beyond that both sides are shuffled
    texts = docs.withColumn("tk", F.xxhash64("text")).join(F.broadcast(keys) if small else keys, (F.col("doc_id") == F.col("id")) & (F.col("tk") == F.col("t"))).select("doc", "text", "k", "grp")

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, part in slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(packed, part), pa.binary()), batch.column(2), batch.column(3)], ["doc", "packed", "k", "grp"])

    # rows that repeat an id and a text come more than once
    whole = stored(texts.mapInArrow(give_back(shrunk), "doc long, packed binary, k long, grp long"), "jaccard-texts")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("x", "y"))
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
            keep, at = [], 0
            while at < len(x):  # a few texts at a time, each once
                texts, stop, size_held = {}, at, 0
                while stop < len(x) and size_held < 1 << 20:
                    for doc, text in ((a[stop], x[stop]), (b[stop], y[stop])):
                        if doc not in texts:
                            texts[doc] = text
                            size_held += len(text)
                    stop += 1
                place = {doc: k for k, doc in enumerate(texts)}
                row, number = exact_sets(list(texts.values()), size)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                for k in range(at, stop):
                    one, two = (number[cut[p] : cut[p + 1]] for p in (place[a[k]], place[b[k]]))
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(100 * both >= percent * (len(one) + len(two) - both))
                at = stop
            yield batch.select(["a", "b", "ka", "kb"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(whole.selectExpr("doc as a", "packed as x", "k as ka"), "a").join(whole.selectExpr("doc as b", "packed as y", "k as kb"), "b").select("a", "b", "ka", "kb", "x", "y")
    single = stored(both.mapInArrow(give_back(verified), "a long, b long, ka long, kb long").distinct(), "jaccard-links")
    tiled = spots.join(whole, "doc").join(group.select("grp", "cells"), "grp").select("cell", "i", "j", "doc", "own", "tag", F.expr("slice(cells, 1, at)").alias("before"), "packed", "k")
    tiled = stored(tiled.groupBy("cell", "i", "j").applyInPandas(_tile(size, percent, every), "doc long, near array<long>, tree array<long>, links long"), "jaccard-tiles")
    drop(whole, spots, pairs, own)

    def listed_pairs(column: str) -> DataFrame:
        far = tiled.select("doc", F.explode(column).alias("other"))
        return single.select("a", "b").union(far.select(F.least("doc", "other"), F.greatest("doc", "other")))

    ends = single.select(F.col("a").alias("doc"), F.col("kb").alias("links")).union(single.select("b", "ka")).union(tiled.select("doc", "links"))
    more = ends.groupBy("doc").agg(F.sum("links").alias("more"))
    sets = member.select("s1", "s2", "doc", "doc_id", "k").join(more, "doc", "left")
    return rows.select("doc_id", "tk", "n", "s1", "s2"), sets, listed_pairs("near"), listed_pairs("tree")


def _by_rows(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """What is known of sets, for each row. Sets of very many rows are sent to the rows, so that none of them is one task's."""
    least = max(1000, rows.count() // 1000)
    hot = F.broadcast(sets.where(F.col("k") >= least))  # 1000 rows at most
    some = rows.join(hot, ["s1", "s2"])
    rest = rows.join(hot.select("s1", "s2"), ["s1", "s2"], "left_anti").join(sets.where(F.col("k") < least), ["s1", "s2"], "left")
    links = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("k") - 1, F.lit(0)) + F.coalesce("more", F.lit(0)))
    return some.unionByName(rest).withColumn("n_links", links)


def jaccard_links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, n, s1, s2, doc (its set's number), first_id (its set's smallest id) and n_links of each row; links: every pair a < b of numbers of different sets that reach the threshold, once; tree: links that connect all that is linked)."""
    rows, sets, links, tree = _linked(docs, every=True, **options)
    members = _by_rows(rows, sets.withColumnRenamed("doc_id", "first_id"))
    return members.select("doc_id", "n", "s1", "s2", "doc", "first_id", "n_links"), links, tree


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), n_links (all rows it is linked with itself), text_hash (xxhash64 of the text, which tells rows of one id apart) and component_no (a component's own number, null without shingles or id) of each row."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, sets, _, tree = _linked(docs, size=size, percent=percent, **options)
    # a set is its smallest id and its number, so that the smallest set of a component has its smallest id
    sets = stored(sets.withColumn("v", F.struct(F.col("doc_id").alias("first"), F.col("doc").alias("no"))).drop("doc_id"), "jaccard-info")
    edges = tree
    for x in "ab":
        edges = edges.join(sets.select(F.col("doc").alias(x), F.col("v").alias(f"v{x}")), x)
    found = components(edges.select(F.col("va").alias("a"), F.col("vb").alias("b")))
    known = sets.join(found.select(F.col("id.no").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "v"))
    out = _by_rows(rows, known.select("s1", "s2", "k", "more", F.col("component.first").alias("least"), F.col("component.no").alias("component_no")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "n_links", F.col("tk").alias("text_hash"), "component_no")
