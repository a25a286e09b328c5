"""Winnowed anchors: every window of `length` symbols picks one of its grams, by content alone.

Equal windows pick the same gram at the same distance from their start. Windows that share a gram are
neighbours, so a document becomes a row of runs: windows `pos .. pos + windows - 1` whose anchor lies
`lead` symbols behind `pos`. Two equal windows always lie in runs with the same `anchor`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from convolens.llm.common import Prefix

_LOW = 24
_MASK = np.uint64((1 << _LOW) - 1)


@dataclass
class Runs:
    text: np.ndarray
    pos: np.ndarray
    windows: np.ndarray
    lead: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    """Runs of all texts; `symbols` holds all of them, `offsets` where each begins. At most 2^24 symbols."""
    n = len(symbols)
    empty = np.zeros(0, np.int64)
    if n < length:
        return Runs(empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64))
    if n >= 1 << _LOW:
        raise ValueError("too many symbols at once")
    hashes = Prefix(symbols, 3)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    # Equal grams within a window: the last of them.
    packed = (grams & ~_MASK) | (_MASK - at.astype(np.uint64))
    least = sliding_min(packed, length - gram + 1)
    anchor = (_MASK - (least & _MASK)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n - length + 1), side="right") - 1
    inside = np.arange(n - length + 1) + length <= offsets[text + 1]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    # Windows that reach over a text's end lie between two texts' runs.
    count = np.add.reduceat(inside.astype(np.int64), first) if len(first) else empty
    owner, mid = text[first], anchor[first]
    return Runs(owner, first - offsets[owner], count, mid - first, grams[mid], Prefix(symbols, 7).of(first, first + count + length - 1))


def chunked(offsets: np.ndarray, length: int, size: int):
    """Pieces for `runs`: (first symbol, last symbol, texts' offsets in it, first text, symbols before it in that text).

    A text longer than `size` is cut; neighbouring cuts share length - 1 symbols, so each window is in one of them.
    """
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if last == first + 1 and end - begin > size:
            for at in range(begin, max(begin + 1, end - length + 1), size):
                stop = min(end, at + size + length - 1)
                yield at, stop, np.array([0, stop - at]), first, at - begin
        else:
            yield begin, end, offsets[first : last + 1] - begin, first, 0
        first = last
