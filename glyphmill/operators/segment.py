"""Words in runs of ideographs, which no blanks divide: a lexicon from the corpus, and the best path through a lattice of its words.

The lexicon is learnt from counts over all texts. A string of ideographs is a word if it is
frequent, if its parts meet more often than chance would have it (cohesion), and if many different
neighbours stand on either side of it (boundary entropy). A run is then a lattice: an edge for each
lexicon word that a trie finds at each place, and one for each single ideograph. The path of the
highest probability, found by dynamic programming from the run's end, gives the words; the runs of
about half a million bytes of text are cut at once, on arrays. A
lexicon may carry a class for each word (a part of speech, a topic) to keep words of some classes alone.

Counting is all joins and partial sums; the lexicon that is sent to the tasks holds the ``most``
most frequent words, a bound that doesn't grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fallback import Tokenizer
from .tables import settled

IDEOGRAPH = r"\x{4E00}-\x{9FFF}"
LEXICON = "word string, n long, cohesion double, entropy double"


#: The first ideograph, and bits that tell all of them (and none) apart: four fit into one number.
FIRST, LAST, BITS = 0x4E00, 0x9FFF, 15
#: Characters counted at once.
HELD = 1 << 20
#: Bytes of runs whose paths are sought at once.
CUT = 1 << 19
#: The mark behind a run; no character has it.
END = (1 << 21) - 1
#: Fewer runs of a length are cut one by one.
FEW = 8


def _counted(chars: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of strings of up to ``longest`` ideographs in an array of code points: (codes, side, neighbour, count), by side 0 before and 1 behind; neighbour 0 is a run's end."""
    own = np.where((chars >= FIRST) & (chars <= LAST), chars - FIRST + 1, 0).astype(np.int64)
    own = np.concatenate([[0], own, np.zeros(longest + 1, np.int64)])
    code = np.zeros(len(own) - longest - 1, np.int64)
    whole = np.ones(len(code), bool)
    for size in range(1, longest + 1):
        next_ = own[size - 1 : size - 1 + len(code)]
        whole &= next_ > 0
        code = (code << BITS) | next_
        at = np.flatnonzero(whole)
        grams, which = np.unique(code[at], return_inverse=True)
        for side, marks in ((0, own[at - 1]), (1, own[at + size])):  # the first place is a blank
            pairs, n = np.unique((which << BITS) | marks, return_counts=True)
            yield grams[pairs >> BITS], np.full(len(pairs), side), pairs & ((1 << BITS) - 1), n


def _text_of(code: int) -> str:
    out = []
    while code:
        out.append(chr((code & ((1 << BITS) - 1)) + FIRST - 1))
        code >>= BITS
    return "".join(reversed(out))


def neighbours(texts: DataFrame, longest: int) -> DataFrame:
    """gram, side, mark, n: how often each string of up to ``longest`` (at most four) ideographs stands before (side 1) or behind (side 0) each neighbour, 0 for a run's end; summed up within each task first."""
    if longest * BITS > 62:
        raise ValueError("strings of more than four ideographs don't fit into one number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for t in batch.column(0):
                if t := t.as_py():
                    held.append(t.lower())
                    size += len(t)
                if size > HELD:
                    yield from counted(held)
                    held, size = [], 0
            if held:
                yield from counted(held)

    def counted(held: list[str]) -> Iterator[pa.RecordBatch]:
        chars = np.frombuffer("\n".join(held).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        for grams, side, mark, n in _counted(chars, longest):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(side.astype(np.int32)), pa.array(mark.astype(np.int32)), pa.array(n.astype(np.int64))], ["gram", "side", "mark", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, side int, mark int, n long").groupBy("gram", "side", "mark").agg(F.sum("n").alias("n"))


@F.pandas_udf(StringType())
def _word(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for c in codes:
        yield c.map(_text_of).astype(object)


def lexicon(texts: DataFrame, *, longest: int = 4, least: int = 5, cohesion: float = 1.0, entropy: float = 0.5) -> DataFrame:
    """LEXICON of the words in ``texts`` (a column text): single ideographs all, longer strings by the three bounds; cohesion and entropy to six digits."""
    # counted once: all that follows reads this table
    sides = settled(neighbours(texts, longest), "lexicon-counts")
    bits = [1 << (BITS * k) for k in range(longest)]
    size = sum(((F.col("gram") >= b).cast("int") for b in bits), F.lit(0))
    counts = settled(sides.where("side = 0").groupBy("gram").agg(F.sum("n").alias("n")).withColumn("size", size), "lexicon-strings")
    n_all = counts.where("size = 1").agg(F.sum("n").alias("total")).first()["total"] or 0
    if not n_all:
        return texts.sparkSession.createDataFrame([], LEXICON)
    often = counts.where((F.col("size") > 1) & (F.col("n") >= least))

    cuts = often.select("gram", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))  # k ideographs behind the cut
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") * BITS)
    cuts = cuts.select("gram", "n", F.call_function("shiftright", F.col("gram"), F.col("k") * BITS).alias("x"), F.col("gram").bitwiseAND(low - 1).alias("y"))
    for side in "xy":
        cuts = cuts.join(counts.select(F.col("gram").alias(side), F.col("n").alias(f"n{side}")), side)
    held = cuts.groupBy("gram", "n").agg(F.round(F.min(F.ln(F.col("n") * F.lit(float(n_all)) / (F.col("nx").cast("double") * F.col("ny")))), 6).alias("cohesion"))

    def spread(side: int) -> DataFrame:
        """Entropy of the neighbours on one side; ends of runs are neighbours that differ from one another."""
        met = sides.where((F.col("side") == side) & (F.col("gram") >= 1 << BITS))
        told = F.when(F.col("mark") == 0, F.lit(0.0)).otherwise(F.col("n") * F.ln("n"))
        return met.groupBy("gram").agg((F.ln(F.sum("n")) - F.sum(told) / F.sum("n")).alias(f"h{side}"))

    words = held.where(F.col("cohesion") >= cohesion).join(spread(0), "gram").join(spread(1), "gram")
    words = words.select("gram", "n", "cohesion", F.round(F.least("h0", "h1"), 6).alias("entropy")).where(F.col("entropy") >= entropy)
    found = counts.where("size = 1").select("gram", "n", F.lit(0.0).alias("cohesion"), F.lit(0.0).alias("entropy")).union(words)
    return found.select(_word(F.col("gram")).alias("word"), "n", "cohesion", "entropy")


class Lattice:
    """A trie of words with logarithms of their probabilities, as arrays: edge k, a node and a character, leads to node k + 1."""

    def __init__(self, words: Iterable[tuple[str, float]]):
        found = list(words)
        total = math.log(sum(n for _, n in found) or 1)
        own = {word: math.log(n) - total for word, n in found if word}
        chars = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        starts, node, levels, n = np.cumsum(sizes) - sizes, np.zeros(len(own), np.int64), [np.zeros(0, np.int64)], 0
        self.longest = int(sizes.max(initial=1))
        for depth in range(self.longest):
            live = np.flatnonzero(sizes > depth)
            level, place = np.unique(node[live] << 21 | chars[starts[live] + depth], return_inverse=True)
            node[live] = n + place + 1
            levels.append(level)
            n += len(level)
        self.edges = np.concatenate(levels)  # in order, as deeper nodes have higher numbers
        self.weight = np.full(n + 1, -np.inf)
        self.weight[node] = np.fromiter(own.values(), float, len(own))
        self.unknown = -total - 1  # an ideograph outside the lexicon is rarer than any word

    def weights(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words of each size that begin at the places ``at``; the single ideograph always has one."""
        out = np.full((self.longest, len(chars)), -np.inf)
        out[0] = self.unknown
        node = np.zeros(len(at), np.int64)
        for size in range(self.longest if len(self.edges) else 0):
            code = node << 21 | chars[at + size]
            place = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
            hit = self.edges[place] == code
            at, node = at[hit], place[hit] + 1
            word = self.weight[node] > -np.inf
            out[size, at[word]] = self.weight[node[word]]
        return out

    def cut(self, runs: list[str], whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """The words of all runs, and how many each run has: those of the most probable path, of equal ones the path whose first differing word is longer. Runs marked as ``whole`` stay as they are."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        whole = np.zeros(len(runs), bool) if whole is None else whole
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        chars = np.frombuffer("\n".join([*runs, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        chars[ends] = END
        weights = self.weights(chars, np.flatnonzero(np.repeat(~whole, sizes + 1)))
        best, step = np.zeros(len(chars) + self.longest), np.ones(len(chars), np.int64)

        # all runs at once from their ends, longer ones first
        own = np.flatnonzero(~whole)
        own = own[np.argsort(-sizes[own], kind="stable")]
        back = 0
        while (n := int(np.searchsorted(-sizes[own], -(back + 1), "right"))) >= FEW:
            back += 1
            at = ends[own[:n]] - back
            top, cut = weights[0, at] + best[at + 1], np.ones(n, np.int64)
            for size in range(2, min(self.longest, back) + 1):
                x = weights[size - 1, at] + best[at + size]
                cut[x >= top] = size
                top = np.maximum(x, top)
            best[at], step[at] = top, cut
        for k in own[:n].tolist():
            low, high = int(starts[k]), int(ends[k]) - back
            behind, edges = best[high : high + self.longest].tolist()[::-1], weights[:, low:high].T.tolist()
            for at in range(high - 1, low - 1, -1):
                top, step[at] = max((w + b, size) for size, (w, b) in enumerate(zip(edges[at - low], reversed(behind[-self.longest :])), 1))
                behind.append(top)

        step[starts[whole]] = sizes[whole]
        first, at = np.zeros(len(chars) + 1, np.int64), starts[sizes > 0]
        while len(at):
            first[at + 1] = 1
            at = at + step[at]
            at = at[chars[at] != END]
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        width[ends] = 0
        upto = np.cumsum(width)
        offsets = np.concatenate([(upto - width)[first[1:] > 0], upto[-1:]]) if runs else np.zeros(1)
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer("".join(runs).encode()))
        before = np.cumsum(first)
        return words, before[ends] - before[starts]

    def path(self, run: str) -> list[str]:
        return self.cut([run])[0].to_pylist()


def _bounded(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """Rows of about so many bytes of strings."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    size = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)])[np.cumsum(n)]
    at = 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield lists.slice(at, upto - at)
        at = upto


def segmenter(words: DataFrame, *, most: int = 500_000, classes: list[str] | None = None) -> Tokenizer:
    """A tokenizer for ``fallback``: runs of ideographs by their best path, runs of other letters as they are. ``words`` holds word and n, and ``class`` if ``classes`` are asked for; then only words of these classes stay."""
    named = "class" in words.columns
    rows = words.select("word", F.col("n").cast("double").alias("n"), (F.col("class") if named else F.lit(None).cast("string")).alias("class")).where("word <> '' and n > 0")
    kept = rows.orderBy(F.desc("n"), "word").limit(most).toArrow()  # bounded by ``most``
    names = kept.column("word").to_pylist()
    wanted = pa.array([w for w, c in zip(names, kept.column("class").to_pylist(), strict=True) if c in (classes or [])], pa.string())
    sent = words.sparkSession.sparkContext.broadcast((Lattice(zip(names, kept.column("n").to_pylist(), strict=True)), wanted))

    @F.arrow_udf("array<string>")
    def tokens(parts: pa.Array) -> pa.Array:
        """Runs come again and again: the different ones of a piece are cut, and no word becomes a Python object."""
        lattice, wanted = sent.value
        out = [pa.array([], pa.list_(pa.string()))]
        for part in _bounded(parts, CUT):
            flat = part.flatten().dictionary_encode()
            runs, which = flat.dictionary.to_pylist(), flat.indices.to_numpy()
            found, n = lattice.cut(runs, np.array([not "一" <= r[0] <= "鿿" for r in runs], bool))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), found)
            own = lists.take(flat.indices).flatten()
            upto = np.concatenate([[0], np.cumsum(n[which])])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))])]
            if classes:
                kept = pc.is_in(own, value_set=wanted)
                own, upto = own.filter(kept), np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[upto]
            out.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), own))
        return pa.concat_arrays(out)

    def tokenize(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return tokens(F.regexp_extract_all(low, F.lit(rf"([{IDEOGRAPH}]+|[\p{{L}}&&[^{IDEOGRAPH}]]+)"), 1))

    return tokenize
