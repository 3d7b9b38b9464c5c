"""Line deduplication with DataFrame functions only.

Lines are normalised and hashed, the documents of each hash are counted, and lines whose hash
is found in too many documents go from every document. Only hashes and positions are
shuffled; the texts move once, when the kept lines are put together again by position.

Defined results: a null or empty text is one empty line and is kept (a null text becomes the
empty string); very long texts are split whole; keys shorter than ``min_chars`` code points are never dropped; every row is a
document of its own, also where rows or ids are repeated or null; an empty table gives an
empty table; other columns pass through whatever their names, and an input column that is
named like an output column (``n_lines``, ``n_dropped``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CHARS, UPPER, free_names, stored

#: A hash is met in so many copies at least, and in one for so many lines that have it.
SALTS, SALTED = 32, 1 << 18


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACE_CHARS))
    # lower() is the same for pure ASCII and much cheaper than translate()
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _hashes(text: Column, min_chars: int) -> Column:
    """A 128-bit hash for each line, null for keys that are too short."""

    def one(line: Column) -> Column:
        return F.transform(
            F.array(line_key(line)),
            lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))),
        )[0]

    return F.transform(F.split(text, "\n"), one)


def line_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop all lines whose key is found in at least ``min_docs`` documents.

    Returns the input's columns, the text holding the kept lines joined by a line feed, and
    ``n_lines`` (before dropping) and ``n_dropped``.
    """
    k1, k2, hashes, drop, split, kept = free_names(df, "k1", "k2", "hashes", "drop", "split", "kept")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`")
    # rows with equal keys have equal texts, hence equal results
    key = {k1: F.xxhash64(own, text), k2: F.xxhash64(text, F.lit(3), own)}
    hashed = df.select(*(c.alias(k) for k, c in key.items()), _hashes(text, min_chars).alias(hashes))

    found = hashed.select(F.explode(F.array_distinct(hashes)).alias("h")).where("h is not null")
    often = stored(found.groupBy("h.a", "h.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "line-hashes")
    lines = hashed.select(k1, k2, F.posexplode(hashes).alias("pos", "h")).where("h is not null")
    # a line found in a third of all documents is one key: it meets as many copies of its hash as its count asks for, SALTS at least
    spread = often.agg(F.max("n").alias("n")).first()["n"] or 0
    salts = max(SALTS, -(-spread // SALTED))
    lines = lines.select(k1, k2, "pos", "h.a", "h.b", F.pmod(k1, F.lit(salts)).alias("s"))
    often = often.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("s"))
    dropped = lines.join(often, ["a", "b", "s"], "left_semi").groupBy(k1, k2).agg(F.collect_set("pos").alias(drop))

    stay = f"array_except(sequence(0, size({split}) - 1), coalesce({drop}, array()))"
    out = (
        df.drop("n_lines", "n_dropped")
        .withColumns(key)
        .join(dropped, [k1, k2], "left")
        .withColumn(split, F.split(text, "\n"))
        .withColumn(kept, F.expr(stay))
    )
    columns = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    joined = F.array_join(F.transform(kept, lambda i: F.element_at(split, i + 1)), "\n")
    return out.select(
        *((joined.alias(c) if c == text_col else F.col(f"`{c}`")) for c in columns),
        F.size(split).cast("long").alias("n_lines"),
        (F.size(split) - F.size(kept)).cast("long").alias("n_dropped"),
    )
