"""A loser tree: merges sorted runs with one comparison a level for each item."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any


def merge(runs: list[Iterable[Any]], key: Callable[[Any], Any]) -> Iterator[tuple[int, Any]]:
    """(run, item) of all runs in the order of ``key``; equal keys come in the order of their runs."""
    its = [iter(r) for r in runs]
    size = 1
    while size < max(1, len(its)):
        size *= 2
    heads: list[tuple | None] = []  # (key, run, item); None after the last
    for i, it in enumerate(its):
        x = next(it, None)
        heads.append(None if x is None else (key(x), i, x))
    heads += [None] * (size - len(heads))

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        _, run, item = heads[top]
        yield run, item
        x = next(its[run], None)
        heads[top] = None if x is None else (key(x), run, x)
        node = (top + size) // 2
        while node:
            if beats(losers[node], top):
                top, losers[node] = losers[node], top
            node //= 2
