"""Keyword extraction without a model: distinct tokens, TF-IDF and TextRank over a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

Tokenizer = Callable[[Column], Column]
#: The document frequencies of so many keywords, the most frequent ones, are sent to the tasks; those of the others join as a table.
SENT = 500_000
#: And up to so many bytes.
SENT_BYTES = 1 << 26
#: Texts whose words are taken at once.
PART = 256


def _spaced(text: Column) -> Column:
    """The words of ``word_tokens`` with blanks between them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FFF}]+|[\p{L}&&[^\x{4E00}-\x{9FFF}]]+)"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x{4E00}-\x{9FFF}]{2,}"), pairs(r)).otherwise(F.array(r))))
    return F.when(low.rlike(r"[\x{4E00}-\x{9FFF}]"), F.array_join(mixed, " ")).otherwise(F.regexp_replace(low, r"[^\p{L}]+", " "))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, in order; a run of ideographs, which no spaces divide, gives its pairs of neighbours, or itself if it is one.

    A tokenizer may be any function of a Column to an array, so one that knows parts of speech can keep nouns and adjectives alone.
    """
    return F.filter(F.split(_spaced(text), " "), lambda w: w != "")


def simple(df: DataFrame, k: int = 20, score: float = 0.5, tokenizer: Tokenizer = word_tokens, least: int = 2) -> DataFrame:
    """The first k distinct tokens of each text (id, text), with one score."""
    words = F.array_distinct(F.filter(tokenizer(F.col("text")), lambda w: F.length(w) >= least))
    return df.select("id", F.posexplode(F.slice(words, 1, k)).alias("pos", "keyword")).select("id", "keyword", F.lit(score).alias("score"), (F.col("pos") + 1).alias("rank"))


def _kept(text: Column, tokenizer: Tokenizer, least: int) -> Column:
    """Tokens of at least so many letters; two ideographs are a word."""
    return F.filter(tokenizer(text), lambda w: (F.length(w) >= least) | ((F.length(w) == 2) & w.rlike(r"^[\x{4E00}-\x{9FFF}]")))


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as a text's words take many times its bytes as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _list(items: pa.Array, n: np.ndarray) -> pa.Array:
    """Lists of so many items each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), items)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _tallied(lists: pa.Array, least: int) -> list[pa.Array]:
    """words (distinct, in order), times, total of each list: the words of at least so many letters; two ideographs are a word, an empty text is none."""
    coded = lists.flatten().dictionary_encode()
    size = pc.utf8_length(coded.dictionary)
    kept = pc.or_(pc.greater_equal(size, max(least, 1)), pc.and_(pc.equal(size, 2), pc.match_substring_regex(coded.dictionary, r"^[\x{4E00}-\x{9FFF}]")))
    order = pc.sort_indices(coded.dictionary)
    names, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    which = coded.indices.to_numpy()
    own = kept.to_numpy(zero_copy_only=False)[which]
    row = np.repeat(np.arange(len(lists)), _lengths(lists))[own]
    code, times = np.unique(row * max(len(names), 1) + place[which[own]], return_counts=True)
    n = np.bincount(code // max(len(names), 1), minlength=len(lists))
    return [_list(names.take(pa.array(code % max(len(names), 1))), n), _list(pa.array(times, pa.int64()), n), pa.array(np.bincount(row, minlength=len(lists)), pa.int64())]


def _counted(df: DataFrame, tokenizer: Tokenizer, least: int) -> DataFrame:
    """id, words (distinct, in order), times, total: counted within the row, on arrays of the words of many rows. The default words come with blanks between them and are parted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            own = batch.column(1)
            own = own if pa.types.is_list(own.type) or pa.types.is_large_list(own.type) else pc.split_pattern(own, " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), *_tallied(own, least)], ["id", "words", "times", "total"])

    tokens = (_spaced if tokenizer is word_tokens else tokenizer)(F.col("text"))
    return df.select("id", tokens.alias("w")).mapInArrow(run, f"id {dict(df.dtypes)['id']}, words array<string>, times array<long>, total long")


def _near_best(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Places whose weight, somewhere from low to high, may be among the k highest once it is rounded to six digits."""
    if len(low) <= k:
        return np.arange(len(low))
    return np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k] - 2e-6)


def _near_bests(low: np.ndarray, high: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """``_near_best`` within each of the rows, which have n places each: whether a place is among them."""
    row, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    bound, many = np.full(len(n), -np.inf), np.flatnonzero(n > k)
    bound[many] = low[np.lexsort((-low, row))][(ends - n)[many] + k - 1] - 2e-6
    return high >= bound[row]


def _best(df: DataFrame, k: int) -> DataFrame:
    """(id, words, w) to the k words of highest weight of each row, ranked within the row."""
    keyed = F.transform(F.arrays_zip("words", "w"), lambda x: F.struct((-x["w"]).alias("m"), x["words"].alias("keyword")))
    top = df.select("id", F.posexplode(F.slice(F.array_sort(keyed), 1, k)).alias("pos", "x"))
    return top.select("id", F.col("x.keyword").alias("keyword"), F.least(-2 * F.col("x.m"), F.lit(1.0)).alias("score"), (F.col("pos") + 1).alias("rank"))


def _well_known(frequencies: DataFrame, sent: int) -> int:
    """The least document frequency of the words that may be sent: the most frequent ones, at most ``sent`` of them and SENT_BYTES, whole steps of frequency at a time."""
    step = F.floor(F.log2("df") * 16)
    steps = frequencies.groupBy(step.alias("step")).agg(F.min("df").alias("low"), F.max("df").alias("top"), F.count("*").alias("n"), F.sum(F.octet_length("keyword") + 16).alias("size")).collect()  # at most 16 x 64 rows
    least, n, size = 1 + max((r["top"] for r in steps), default=0), 0, 0
    for r in sorted(steps, key=lambda r: -r["low"]):
        n, size = n + r["n"], size + r["size"]
        if n > sent or size > SENT_BYTES:
            break
        least = r["low"]
    return least


def _candidates(counts: DataFrame, told: Broadcast, n: int, least: int, k: int) -> DataFrame:
    """Of each row the words that may be among its best; df is 0 where it isn't told, so anything from 1 to least - 1."""

    def weight(tf: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return tf * (np.log((n + 1.0) / (spread + 1.0)) + 1.0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = told.value.get
        for batch in _in_parts(batches):
            words, times = (batch.column(c).flatten() for c in (1, 2))
            size, coded = _lengths(batch.column(1)), words.dictionary_encode()
            spread = np.array([get(w, 0) for w in coded.dictionary.to_numpy(zero_copy_only=False)], np.int64)[coded.indices.to_numpy()]
            tf = times.to_numpy() / np.repeat(np.maximum(batch.column(3).to_numpy(), 1), size)
            low, high = weight(tf, np.where(spread, spread, max(least - 1, 1))), weight(tf, np.where(spread, spread, 1))
            best = _near_bests(low, high, size, k)
            n = np.diff(np.concatenate([[0], np.cumsum(best)])[np.cumsum(size)], prepend=0)
            columns = [_list(x, n) for x in (words.filter(pa.array(best)), times.filter(pa.array(best)), pa.array(spread[best]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3), batch.column(4)], ["id", "words", "times", "df", "total", "row"])

    return counts.mapInArrow(look, f"id {dict(counts.dtypes)['id']}, words array<string>, times array<long>, df array<long>, total long, row long")


def tfidf(df: DataFrame, k: int = 8, tokenizer: Tokenizer = word_tokens, least: int = 3, idf: DataFrame | None = None, sent: int = SENT) -> DataFrame:
    """The k tokens of highest TF-IDF of each text (id, text), score min(2w, 1); rows are texts of their own.

    Tokens are counted within the row, once, and for the document frequencies only distinct words are
    exchanged, with partial sums. The frequencies of the ``sent`` most frequent words (and SENT_BYTES)
    are looked up within the row. Those of the others lie below a known one, so they bound
    their words' weights, and most words of a row are out of its best k by these bounds. Only the rows
    that the bounds leave open take an exchange, with the words that are left: words that few rows hold join
    their frequencies, then these rows are ranked. The result is exact for any ``sent``. Tables stand in the
    shared folder until ``tables.release``. Where ``idf`` (keyword, idf) is given, it joins as a table.
    """
    counts = _counted(df, tokenizer, least).withColumn("row", F.monotonically_increasing_id())
    if idf is not None:
        rows = counts.select("row", "id", "total", F.explode(F.arrays_zip("words", "times")).alias("x"))
        scored = rows.select("row", "id", F.col("x.words").alias("keyword"), (F.col("x.times") / F.col("total")).alias("tf")).join(idf, "keyword")
        return _ranks(scored.withColumn("w", F.round(F.col("tf") * F.col("idf"), 6)), k)
    counts = settled(counts, "word-counts")  # counted once: for the frequencies and for the ranks
    frequencies = settled(counts.select(F.explode("words").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("df")), "word-frequencies")
    n, known = counts.count(), _well_known(frequencies, sent)
    some = frequencies.where(F.col("df") >= known).toArrow()  # at most `sent` rows and SENT_BYTES
    told = df.sparkSession.sparkContext.broadcast(dict(zip(some.column("keyword").to_pylist(), some.column("df").to_pylist(), strict=True)))
    found = _candidates(counts, told, n, known, k)

    def weight(times: Column, spread: Column) -> Column:
        return F.round(times / F.col("total") * (F.ln((F.lit(float(n)) + 1.0) / (spread + 1.0)) + 1.0), 6)

    if known <= 1:
        return _best(found.select("id", "words", F.zip_with("times", "df", weight).alias("w")), k)
    found = settled(found, "word-candidates")
    unsure = F.array_contains("df", 0)
    sure = _best(found.where(~unsure).select("id", "words", F.zip_with("times", "df", weight).alias("w")), k)
    left = found.where(unsure).select("row", "id", "total", F.explode(F.arrays_zip("words", "times", "df")).alias("x"))
    left = left.select("row", "id", "total", F.col("x.words").alias("keyword"), F.col("x.times").alias("times"), F.col("x.df").alias("df"))
    rare = left.where("df = 0").drop("df").join(frequencies.where(F.col("df") < known), "keyword").select(left.columns)
    both = left.where("df > 0").unionByName(rare)
    return sure.unionByName(_ranks(both.withColumn("w", weight(F.col("times"), F.col("df"))), k))


def _ranks(scored: DataFrame, k: int) -> DataFrame:
    """The k best (keyword, w) of each row, by an exchange by row."""
    rank = Window.partitionBy("row", "id").orderBy(F.desc("w"), "keyword")
    best = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("id", "keyword", F.least(2 * F.col("w"), F.lit(1.0)).alias("score"), "rank")


def _ranked(words: list[str], span: int, rounds: int, damping: float) -> tuple[list[str], np.ndarray]:
    """Ranks in one text's graph. Edges come from positions: each token meets the next span - 1 ones."""
    names = sorted(set(words))
    place = np.array(list(map(dict(zip(names, range(len(names)), strict=True)).__getitem__, words)), np.int64)
    pairs = [place[:-d] * len(names) + place[d:] for d in range(1, span) if d < len(place)]
    code = np.concatenate([np.zeros(0, np.int64), *pairs])
    a, b = code // max(len(names), 1), code % max(len(names), 1)
    code, times = np.unique(np.concatenate([code, b * len(names) + a])[np.tile(a != b, 2)], return_counts=True)
    a, b = code // max(len(names), 1), code % max(len(names), 1)
    live = np.unique(a)
    share = times / np.bincount(a, times, len(names))[a]
    rank = np.ones(len(names))
    for _ in range(rounds):
        rank = (1 - damping) + damping * np.bincount(b, rank[a] * share, len(names))
    return [names[i] for i in live.tolist()], rank[live]


def textrank(df: DataFrame, k: int = 8, tokenizer: Tokenizer = word_tokens, least: int = 3, span: int = 5, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """The k tokens of highest rank in each text's graph of tokens that stand within ``span`` of each other. A graph is one text's, so nothing is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            words, ranks, most = [], [], []
            for tokens in batch.column(1).to_pylist():
                names, r = _ranked(tokens, span, rounds, damping)
                most.append(float(r.max(initial=1e-300)))
                best = _near_best(r / most[-1], r / most[-1], k).tolist()
                words.append([names[i] for i in best])
                ranks.append(r[best].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(ranks, pa.list_(pa.float64())), pa.array(most, pa.float64())], ["id", "words", "r", "most"])

    tokens = _kept(F.col("text"), tokenizer, least)
    ranks = df.select("id", tokens.alias("w")).mapInArrow(run, f"id {dict(df.dtypes)['id']}, words array<string>, r array<double>, most double")
    return _best(ranks.select("id", "words", F.transform("r", lambda r: F.round(r / F.col("most"), 6)).alias("w")), k)


_METHODS = {"tfidf": tfidf, "textrank": textrank, "simple": simple}


def method_name(method: str | None) -> str:
    """None and unknown names mean TF-IDF."""
    return method if method in _METHODS else "tfidf"


def extract(df: DataFrame, method: str | None = "tfidf", k: int = 8, **more) -> DataFrame:
    """Dispatch by name."""
    return _METHODS[method_name(method)](df, k=k, **more)
