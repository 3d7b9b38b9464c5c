r"""Chat formatting in budgeted windows.

The turns of a conversation are put in order and streamed once. Prefix sums of their tokens
choose spans of whole turns that fit a budget; each window after the first starts with the
system turn and a limited tail of the turns before it, which carry no loss, so that each
assistant text is a target exactly once.

A turn is written as ``### role: text </turn>`` and a line feed. In roles and texts a
backslash goes before every backslash, ``#`` and ``<`` (in roles before ``:`` too), so no
text can hold a mark, and taking these backslashes away restores it.

Defined results: null roles and texts are empty strings; turns are ordered by (turn, role,
text), nulls first, repeated rows being turns of their own; rows with a null conversation id
form one conversation; a turn over the budget gets a window of its own, never cut; a system
turn is kept in every window if it is the first turn; an empty table gives no window; columns
other than the four named take no part.

Memory is bounded by one window. A conversation is one sequence of windows (and its digest
one hash over all its bytes), so one task streams it, whatever its length, after an external
sort; it is never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

WINDOWS = "conv_id long, window long, formatted string, n_turns int, n_repeated int, tokens long, loss_starts array<int>, loss_ends array<int>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
END = " </turn>\n"

_mark = re.compile(r"[\\#<]")
_role_mark = re.compile(r"[\\#<:]")
_escaped = re.compile(r"\\(.)", re.S)
_head = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_token = re.compile(r"\w+|[^\w\s]")


def escape(text: str, marks: re.Pattern = _mark) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


def count_tokens(text: str) -> int:
    """Words and marks; four more stand for the turn's own marks."""
    return sum(1 for _ in _token.finditer(text)) + 4


class _Windows:
    """Turns of one conversation in, windows out."""

    def __init__(self, conv, budget: int, history_turns: int, history_tokens: int):
        self.conv, self.budget, self.history_tokens = conv, budget, history_tokens
        self.system: tuple[str, str, int] | None = None
        self.tail: deque = deque(maxlen=history_turns)
        self.lead: list[tuple[str, str, int]] = []
        self.own: list[tuple[str, str, int]] = []
        self.sum = self.number = self.seen = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, count_tokens(text))
        if self.own and self.sum + turn[2] > self.budget:
            yield self.close()
            self.lead = [self.system] if self.system else []
            room = min(self.history_tokens, self.budget - turn[2] - sum(t[2] for t in self.lead))
            back = []
            for old in reversed(self.tail):
                room -= old[2]
                if room < 0:
                    break
                back.append(old)
            self.lead += reversed(back)
            self.sum = sum(t[2] for t in self.lead)
        if not self.seen and role == "system":
            self.system = turn
        elif self.tail.maxlen:
            self.tail.append(turn)
        self.seen += 1
        self.own.append(turn)
        self.sum += turn[2]

    def close(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate(self.lead + self.own):
            head, body = f"### {escape(role, _role_mark)}: ", escape(text)
            if k >= len(self.lead) and role == "assistant":
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        row = (self.conv, self.number, "".join(parts), len(self.lead) + len(self.own), len(self.lead), self.sum, starts, ends)
        self.number += 1
        self.own = []
        return row


def _frames(rows: Iterator[tuple], columns: list[str], chars: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Frames of bounded size; the first column may hold nulls."""
    batch, size = [], 0
    for row in rows:
        batch.append(row)
        size += 200 + (len(row[2]) if isinstance(row[2], str) else 0)
        if size > chars:
            yield _frame(batch, columns)
            batch, size = [], 0
    if batch:
        yield _frame(batch, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    first, *rest = zip(*rows, strict=True)
    return pd.DataFrame({columns[0]: pd.array(first, "Int64")} | dict(zip(columns[1:], rest, strict=True)))


#: Ids come as a number and a flag: a column with nulls would turn into floats.
FLAGGED = ["coalesce(conv_id, 0L) as conv_id", "conv_id is null as no_id"]


def chat_windows(
    df: DataFrame, *, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Formatted windows with their loss spans (code points of ``formatted``); windows of a conversation lie in order in one partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            now = None
            for frame in frames:
                for conv, none, role, text in zip(frame["conv_id"].tolist(), frame["no_id"].tolist(), frame["role"], frame["text"], strict=True):
                    conv = None if none else conv
                    if now is None or now.conv != conv:
                        if now:
                            yield now.close()
                        now = _Windows(conv, budget, history_turns, history_tokens)
                    yield from now.add(role if isinstance(role, str) else "", text if isinstance(text, str) else "")
            if now:
                yield now.close()

        yield from _frames(rows(), [c.split()[0] for c in WINDOWS.split(", ")])

    turns = df.selectExpr(f"cast(`{conv_col}` as long) as conv_id", f"`{turn_col}` as turn", f"`{role_col}` as role", f"`{text_col}` as text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").selectExpr(*FLAGGED, "role", "text").mapInPandas(run, WINDOWS)


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        head = _head.match(formatted, at)
        end = formatted.index(END, head.end())
        out.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END)
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation: what the windows' new turns and loss spans hold, read from the formatted text alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            conv, state = None, None

            def done():
                return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

            for frame in frames:
                for own, none, text, repeated, starts, ends in zip(frame["conv_id"].tolist(), frame["no_id"].tolist(), frame["formatted"], frame["n_repeated"], frame["loss_starts"], frame["loss_ends"], strict=True):
                    own = None if none else own
                    if state is None or own != conv:
                        if state:
                            yield done()
                        conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, said in parse_window(text)[repeated:]:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    for a, b in zip(starts, ends, strict=True):
                        target = unescape(text[a:b])
                        state[2] += len(target)
                        state[3].update(target.encode())
                    state[4] += len(text)
                    state[5] += 1
            if state:
                yield done()

        yield from _frames(rows(), [c.split()[0] for c in DIGEST.split(", ")])

    return windows.selectExpr(*FLAGGED, "formatted", "n_repeated", "loss_starts", "loss_ends").mapInPandas(run, DIGEST)
