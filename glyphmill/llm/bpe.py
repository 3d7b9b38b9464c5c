"""Byte-pair encoding by speculation and verification, and decoding.

For all new words at once, greedy longest match proposes tokens, by steps of all words through
one trie of the pieces. A proposal is the exact encoding if every token encodes to itself and no two neighbours would have merged across their border
first; that test runs on arrays of all new neighbouring pairs at once. Only words that fail
it are merged exactly. Encoded words are kept in a bounded table, so that a text costs one
split and one join.

Words come from the vocabulary file's own rules: special tokens are cut out first, then the
text is put in normal form and lower case and split. Texts of plain Latin letters are split on
arrays, all at once, which gives the same words; of these only different ones become Python
objects. All others go through the file's own normaliser and splitter.

Defined results: null and empty texts have no tokens and decode to the empty string; repeated
rows give repeated rows; other columns pass through unless they are named like an output
column, which is then replaced; very long texts and very long words are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back

NEVER = np.int64(1) << 40
#: Words of more bytes are merged one by one.
WIDEST = 64
#: Characters below U+0250 for which normal form is the identity; capitals whose small letter is beyond go the other way.
_plain = re.compile("[" + "".join(re.escape(chr(c)) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x250)) if len(low := chr(c).lower()) == 1 and low < "ɐ") + "]*")
_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Of plain characters: 0 white space, 1 letter, 2 digit, 3 any other.
_kinds = np.array([0 if chr(c).isspace() else 2 if re.match("[0-9\xb2\xb3\xb9\xbc-\xbe]", chr(c)) else 1 if re.match("[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]", chr(c)) else 3 for c in range(0x250)], np.int8)
WORDS_KEPT = 400_000


def plain_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of plain texts, in order, and how many each text has: runs of letters, single digits, runs of other characters, and endings with an apostrophe that no other such character precedes."""
    low = " ".join([*texts, ""]).lower()
    chars = np.frombuffer(low.encode("utf-16-le"), "<u2")
    kind = _kinds[chars]
    start = (kind > 0) & ((kind == 2) | (np.diff(kind, prepend=np.int8(0)) != 0))
    at = np.flatnonzero(start & (chars == ord("'")))
    a, b = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
    two = np.isin(a, [ord(c) for c in "stmd"])
    three = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
    start[at[two | three] + 1] = False
    behind = np.concatenate([at[two] + 2, at[three] + 3])
    start[behind] = kind[behind] > 0
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.cumsum(np.where(kind > 0, 1 + (chars >= 0x80), 0))
    first = np.flatnonzero(start)
    offsets = np.concatenate([np.where(first > 0, upto[first - 1], 0), upto[-1:]]) if texts else np.zeros(1)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low.encode().translate(None, b" \t\n\x0b\x0c\r")))
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Exact ids of words under a vocabulary with an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.pieces = [""] * size
        for piece, k in (self.ids | self.special).items():
            self.pieces[k] = piece
        self.reach: dict[str, int] = {}  # the longest piece by its first two characters
        for piece in self.ids:
            self.reach[piece[:2]] = max(self.reach.get(piece[:2], 1), len(piece))
        self.symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(self.symbols)}
        # the merge that makes a token: its parts and its rank; single symbols have none
        self.left, self.right, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = self.ids[a + b]
            pair = self.ids[a], self.ids[b]
            self.merges.setdefault(pair, (rank, made))
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = *pair, rank
        codes = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_rank = codes[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.zeros(len(model["merges"]), np.int64)
        for rank, made in self.merges.values():
            self.made[rank] = made
        inner, last = ([self.ids.get(c + end, 0) for c in self.symbols] for end in ("", self.end))
        self.inner, self.last = np.array(inner, np.int64), np.array(last, np.int64)
        self.grow()
        self.whole: dict[int, bool] = {}
        self.keep = WORDS_KEPT  # words in the table, about 200 bytes each
        self.known: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def grow(self) -> None:
        """The trie of all pieces over bytes and, as symbol 256, the end mark: its edges in order, and the piece at each node."""
        edges: dict[int, int] = {}
        pieces = [-1]
        for piece, k in self.ids.items():
            marked = bool(self.end) and piece.endswith(self.end) and piece != self.end
            body = piece[: -len(self.end)] if marked else piece
            if not all(c in self.bytes for c in body):
                continue
            node = 0
            for symbol in [*(self.bytes[c] for c in body), *[256] * marked]:
                code = node * 257 + symbol
                if code not in edges:
                    edges[code] = len(pieces)
                    pieces.append(-1)
                node = edges[code]
            pieces[node] = k
        codes = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(codes)
        self.edges, self.child, self.piece = codes[order], np.fromiter(edges.values(), np.int64, len(edges))[order], np.array(pieces)

    # -- one word

    def starts(self, word: str) -> list[str]:
        out = [self.symbols[b] for b in word.encode()]
        out[-1] += self.end
        return out

    def merged(self, symbols: list[str]) -> list[int]:
        """Exact merging, least rank and leftmost first, with a heap over a linked list."""
        ids = [self.ids[s] for s in symbols]
        nxt, prev = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], nxt[k] = made, -1, nxt[j]
            if nxt[k] >= 0:
                prev[nxt[k]] = k
                if m := self.merges.get((made, ids[nxt[k]])):
                    heapq.heappush(heap, (m[0], k, made, ids[nxt[k]], m[1]))
            if prev[k] >= 0 and (m := self.merges.get((ids[prev[k]], made))):
                heapq.heappush(heap, (m[0], prev[k], ids[prev[k]], made, m[1]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; the last token holds the end mark."""
        text = "".join(map(self.symbols.__getitem__, word.encode()))
        get, reach, out, at, n = self.ids.get, self.reach, [], 0, len(text)
        marked, last = text + self.end, n - bool(self.end)
        while at < n:
            if (k := get(marked[at:])) is not None:
                out.append(k)
                break
            for stop in range(min(last, at + reach.get(text[at : at + 2], 1)), at, -1):
                if (k := get(text[at:stop])) is not None:
                    out.append(k)
                    at = stop
                    break
        return out

    def stands(self, token: int) -> bool:
        """Whether the token's own text encodes to the token."""
        if token not in self.whole:
            piece = self.pieces[token]
            body = piece[: -len(self.end)] if self.end and piece.endswith(self.end) and piece != self.end else piece
            symbols = list(body)
            if body != piece:
                symbols[-1] += self.end
            self.whole[token] = self.merged(symbols) == [token]
        return self.whole[token]

    # -- many pairs

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For pairs of tokens: whether merging their joined texts leaves the border between them.

        Going back in time, the younger of the two symbols at the border is split, and its
        part at the border takes its place until that split. Two symbols at the border merge
        if their rank comes before the left one's next merge, or not after the right one's.
        """
        x, y = first.copy(), second.copy()
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            code = a.astype(np.int64) << 32 | b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[at] == code, self.code_rank[at], NEVER)
            clash = (rank < until_x[live]) & (rank <= until_y[live]) & (rank < NEVER)
            ok[live[clash]] = False
            born_a, born_b = self.rank[a], self.rank[b]
            going = ~clash & (np.maximum(born_a, born_b) >= 0)
            live, split_x = live[going], (born_a > born_b)[going]
            left, right = live[split_x], live[~split_x]
            until_x[left], x[left] = self.rank[x[left]], self.right[x[left]]
            until_y[right], y[right] = self.rank[y[right]], self.left[y[right]]
        return ok

    def pair_rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank at which two neighbours merge; NEVER if they don't, or if one is missing (-1)."""
        code = first << 32 | second
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (second >= 0), self.code_rank[at], NEVER)

    def merged_many(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words; each round merges one pair of every word that has any."""
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(r) for r in raw])
        for low, wide in ((0, 8), (8, 12), (12, 20), (20, WIDEST)):
            own = np.flatnonzero((sizes > low) & (sizes <= wide))
            if not len(own):
                continue
            size = sizes[own]
            ids = np.full((len(own), wide + 1), -1)
            ids[:, :wide][np.arange(wide) < size[:, None]] = self.inner[np.frombuffer(b"".join([raw[k] for k in own.tolist()]), np.uint8)]
            ends = np.arange(len(own)), size - 1
            ids[ends] = self.last[np.array([raw[k][-1] for k in own.tolist()])]
            rank = np.full((len(own), wide), NEVER)
            there = np.arange(wide) < size[:, None] - 1
            rank[there] = self.pair_rank(ids[:, :wide][there], ids[:, 1:][there])
            live, column = np.arange(len(own)), np.arange(wide)
            done = ids.copy()
            while len(live):
                at = rank.argmin(axis=1)  # the leftmost of least rank
                rows = np.arange(len(live))
                best = rank[rows, at]
                go = best < NEVER
                if not go.all():
                    done[live[~go]] = ids[~go]
                    live, ids, rank, at, best = live[go], ids[go], rank[go], at[go], best[go]
                    rows = np.arange(len(live))
                made = self.made[best]
                # what stands behind the pair moves up by one
                behind = column > at[:, None]
                ids[:, :wide] = np.where(behind, ids[:, 1:], ids[:, :wide])
                ids[rows, at] = made
                rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[rows, at] = self.pair_rank(made, ids[rows, at + 1])
                ahead = np.flatnonzero(at)
                rank[ahead, at[ahead] - 1] = self.pair_rank(ids[ahead, at[ahead] - 1], made[ahead])
            for k, row in zip(own.tolist(), done.tolist(), strict=True):
                out[k] = row[: row.index(-1)]
        for k in np.flatnonzero(sizes > WIDEST).tolist():
            out[k] = self.merged(self.starts(words[k]))
        return out

    def proposed(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of greedy longest match; the last token holds the end mark."""
        sizes = np.array([len(r) for r in raw])
        text = np.full(int(sizes.sum()) + len(raw), 256)
        end = np.cumsum(sizes + 1) - 1
        text[np.delete(np.arange(len(text)), end)] = np.frombuffer(b"".join(raw), np.uint8)
        word, at = np.arange(len(raw)), end - sizes
        node, best, upto = np.zeros(len(raw), np.int64), np.full(len(raw), -1), at.copy()
        words, tokens = [], []
        while len(word):
            symbol = text[at]
            code = node * 257 + symbol
            place = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
            step = self.edges[place] == code
            node = np.where(step, self.child[place], 0)
            at = at + 1
            # without an end mark a piece may reach the end, with one only a marked piece does
            fits = step & (self.piece[node] >= 0) & ((symbol == 256) | (at < end + (not self.end)))
            best, upto = np.where(fits, self.piece[node], best), np.where(fits, at, upto)
            if (over := ~step | (symbol == 256)).any():
                words.append(word[over])
                tokens.append(best[over])
                at, node = np.where(over, upto, at), np.where(over, 0, node)
                best = np.where(over, -1, best)
                if (done := over & (upto >= end + bool(self.end))).any():
                    word, at, node, best, upto, end = (x[~done] for x in (word, at, node, best, upto, end))
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return word[order], np.concatenate(tokens)[order]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that aren't known yet."""
        words = list(words)
        raw = [w.encode() for w in words]
        brief = [k for k, r in enumerate(raw) if len(r) <= WIDEST]
        word, flat = self.proposed([raw[k] for k in brief]) if brief else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        word = np.array(brief, np.int64)[word]
        inner = np.flatnonzero(word[1:] == word[:-1])  # the left sides of pairs
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        used, place = np.unique(flat, return_inverse=True)
        sound = np.array([self.stands(k) for k in used.tolist()], bool)[place]
        failed = np.ones(len(words), bool)
        failed[brief] = False
        failed[word[inner[~fits]]] = True
        failed[word[~sound]] = True
        good = ~failed[word]
        codes, ends = flat[good].astype("<u4").tobytes(), np.cumsum(np.bincount(word[good], minlength=len(words)))
        self.store([words[k] for k in np.flatnonzero(~failed).tolist()], codes, ends[~failed])
        again = [words[k] for k in np.flatnonzero(failed).tolist()]
        merged = self.merged_many(again)
        self.store(again, np.array([k for m in merged for k in m], "<u4").tobytes(), np.cumsum([len(m) for m in merged]))

    def store(self, words: list[str], codes: bytes, ends: np.ndarray) -> None:
        start = 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.known[word] = codes[start:end]
            start = end

    # -- texts

    def words(self, text: str) -> list[str]:
        if _plain.fullmatch(text):
            return _words.findall(text.lower())
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in piece).decode(errors="surrogateescape") for piece, _ in split]

    def marked(self, text: str) -> bool:
        """Whether special tokens stand in the text."""
        return bool(self.cut) and any(s in text for s in self.special)

    def parts(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as they are."""
        if not self.marked(text):
            return self.words(text)
        out = []
        for k, piece in enumerate(self.cut.split(text)):
            out += [piece] if k % 2 else self.words(piece)
        return out

    def ready(self, used: list[str], decoded: bool) -> None:
        """From now on these words are in the table."""
        if len(self.known) > self.keep:
            self.known.clear()
            self.shown.clear()
        if fresh := [w for w in used if w not in self.known]:
            if words := [w for w in fresh if w not in self.special]:
                self.learn(words)
            self.known |= {s: np.array([self.special[s]], "<u4").tobytes() for s in fresh if s in self.special}
        for w in used if decoded else []:
            if w not in self.shown:
                self.shown[w] = self.decode(np.frombuffer(self.known[w], "<u4").tolist())

    def runs(self, counts: list[int]) -> Iterator[tuple[int, int]]:
        """Texts so that the table may be emptied between them."""
        at = 0
        while at < len(counts):
            stop, n = at, 0
            while stop < len(counts) and n < self.keep:
                n += counts[stop]
                stop += 1
            yield at, stop
            at = stop

    def encode(self, texts: list[str | None], decoded: bool = True) -> tuple[list[bytes], list[str]]:
        """Little-endian 32-bit ids of each text, and what they decode to."""
        ids, shown = [b""] * len(texts), [""] * (len(texts) if decoded else 0)
        filled = [k for k, t in enumerate(texts) if t]
        plain = [k for k in filled if _plain.fullmatch(texts[k]) and not self.marked(texts[k])]
        words, counts = plain_words([texts[k] for k in plain])
        place = np.concatenate([[0], np.cumsum(counts)])
        for at, stop in self.runs(counts.tolist()):
            coded = words.slice(place[at], place[stop] - place[at]).dictionary_encode()
            used = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.ready(used, decoded)
            bounds = place[at : stop + 1] - place[at]
            own = pa.array([*map(self.known.__getitem__, used)], pa.binary()).take(coded.indices)
            ends = np.frombuffer(own.buffers()[1], np.int32)[bounds] if len(own) else np.zeros_like(bounds)
            flat = memoryview(own.buffers()[2] or b"")
            for k, a, b in zip(plain[at:stop], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids[k] = bytes(flat[a:b])
            if decoded:
                told = pa.array([*map(self.shown.__getitem__, used)], pa.string()).take(coded.indices)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), told), " ").to_pylist()
                for k, t in zip(plain[at:stop], joined, strict=True):
                    shown[k] = t
        others = sorted(set(filled).difference(plain))
        parts = [self.parts(texts[k]) for k in others]
        for at, stop in self.runs([*map(len, parts)]):
            self.ready(list(set().union(*parts[at:stop])), decoded)
            for k, p in zip(others[at:stop], parts[at:stop], strict=True):
                ids[k] = b"".join(map(self.known.__getitem__, p))
                if decoded:
                    shown[k] = " ".join(map(self.shown.__getitem__, p))
        return ids, shown

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined by spaces, as the file, which names no decoder, has it."""
        return " ".join([self.pieces[k] for k in ids])


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One for each path and worker process."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch, text: str, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in pieces of bounded text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(column.is_valid()) * 64 + np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), float))
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), chars, side="right")))
        yield batch.slice(at, n), column.slice(at, n).to_pylist()
        at += n


def with_tokens(df: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with its texts' token ids (little-endian unsigned 32-bit, binary) and, if named, the decoded text."""
    keep = [f for f in df.schema.fields if f.name not in (ids_col, decoded_col)]
    new = [T.StructField(ids_col, T.BinaryType())] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.keep = WORDS_KEPT
        for whole in batches:
            for batch, texts in slices(whole, text_col):
                ids, decoded = enc.encode(texts, bool(decoded_col))
                arrays = [pa.array(ids, pa.binary())] + ([pa.array(decoded, pa.string())] if decoded_col else [])
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f.name for f in new)])

    return df.select(*(f"`{f.name}`" for f in keep)).mapInArrow(give_back(run), T.StructType([*keep, *new]))
