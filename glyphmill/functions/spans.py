"""The least span of a text that holds a keyword's characters in order, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def least_span(word: str, text: str) -> int:
    """Greedy matching from each start; -1 if there is none. All starts at once, so linear in the text for each character of the word."""
    word = word.replace(" ", "")
    if not word or not text:
        return -1
    if word in text:
        return len(word)
    if any(c not in text for c in set(word)):
        return -1
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    places = {c: np.flatnonzero(chars == ord(c)) for c in set(word)}
    starts = at = places[word[0]]
    for c in word[1:]:
        next_ = np.searchsorted(places[c], at, "right")
        found = next_ < len(places[c])  # once a start finds none, later ones don't either
        starts, at = starts[found], places[c][next_[found]]
    return int((at - starts).min()) + 1 if len(at) else -1


def near(word: str | None, text: str, ratio: float, longest: int) -> bool:
    """Whether the word's characters stand close together in the text; words beyond ``longest`` aren't looked for."""
    if word is None or (longest > 0 and len(word) > longest):
        return False
    return 0 <= least_span(word, text) <= ratio * len(word.replace(" ", ""))


def near_words(words: Column, text: Column, ratio: float, longest: int) -> Column:
    """``near`` for each word of an array; an empty text keeps all."""

    @F.arrow_udf("array<boolean>")
    def run(words: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for own, t in zip(words, texts, strict=True):
            own, t = own.as_py(), t.as_py() or ""
            known = {w: not t or near(w, t, ratio, longest) for w in set(own or ())}
            out.append(None if own is None else [known[w] for w in own])
        return pa.array(out, pa.list_(pa.bool_()))

    return run(words, F.make_valid_utf8(text))


@F.pandas_udf(IntegerType())
def min_span_udf(words: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([least_span(w or "", t or "") for w, t in zip(words, texts, strict=True)], dtype="int32")
