"""Many calls under way in one task, answers in order.

A task that waits for each answer leaves a service idle. Here a bounded pool of threads has
requests under way while later rows are read; answers come back in the order of the rows, batches
as they were. Rows are only read as far ahead as ``ahead`` allows (back-pressure), so memory is
bounded by that and one batch, however slow the service is.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice
from typing import TypeVar

import pandas as pd

X = TypeVar("X")
Y = TypeVar("Y")


def in_order(items: Iterator[X], call: Callable[[X], Y], width: int, ahead: int | None = None) -> Iterator[Y]:
    """call(x) of each item, in order, at most ``width`` at a time; at most ``ahead`` items (4 x width, if none is given) are read whose answer hasn't been taken."""
    if width <= 1:
        yield from map(call, items)
        return
    most = max(width, ahead or 4 * width)
    waiting: deque[Future[Y]] = deque()
    pool = ThreadPoolExecutor(width)
    try:
        for x in items:
            waiting.append(pool.submit(call, x))
            if len(waiting) >= most:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:  # also when the task is ended early: what hasn't begun is dropped
        pool.shutdown(wait=True, cancel_futures=True)


def one_each(make: Callable[[], X]) -> Callable[[], X]:
    """make() once for each thread, so that what it makes needn't be safe to share."""
    own = threading.local()

    def get() -> X:
        if not hasattr(own, "value"):
            own.value = make()
        return own.value

    return get


def answered(frames: Iterator[pd.DataFrame], columns: list[str], call: Callable[..., Y], width: int, ahead: int | None = None) -> Iterator[tuple[pd.DataFrame, list[Y]]]:
    """(frame, the answer for each of its rows), calls of later frames being under way while one is completed."""
    held: deque[pd.DataFrame] = deque()

    def rows() -> Iterator[tuple]:
        for frame in frames:
            if len(frame):
                held.append(frame)
                yield from zip(*(frame[c] for c in columns), strict=True)

    answers = in_order(rows(), lambda row: call(*row), width, ahead)
    for first in answers:
        frame = held.popleft()
        yield frame, [first, *islice(answers, len(frame) - 1)]
