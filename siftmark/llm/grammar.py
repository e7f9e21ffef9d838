"""Recompression: a run-length grammar of a symbol string, and extensions answered from it.

Block compression replaces each maximal run of one symbol by a new symbol, pair compression
replaces neighbours (a, b) by a new symbol where a is on the left and b on the right side of a
partition of the symbols. The two alternate until one symbol is left. Each step looks at a symbol
and its neighbours only, so equal substrings are cut alike but for their edges, and the length to
which two places agree is found by climbing through the levels and descending again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from siftmark.llm.common import mixed

#: Extensions that are looked up at a time.
QUERIES = 1 << 16


@dataclass
class Level:
    """Symbols of one level. ``down[x]`` is the first child of symbol x in the level below (with
    one more entry for the end), ``up[x]`` its parent in the level above."""

    symbols: np.ndarray
    down: np.ndarray | None = None
    pairs: bool = False
    up: np.ndarray | None = None


def _blocks(symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    lengths = np.diff(np.append(starts, len(symbols)))
    out = symbols[starts].copy()
    long = np.flatnonzero(lengths > 1)
    # Symbols and lengths are below 2^31, as there are not more symbols than places on all levels.
    _, name = np.unique(out[long] << 31 | lengths[long], return_inverse=True)
    out[long] = fresh + name
    return starts, out


def _pairs(symbols: np.ndarray, fresh: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    side = (mixed(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(40)) & np.uint64(1)
    rising, falling = side[:-1] < side[1:], side[:-1] > side[1:]
    first = np.flatnonzero(rising if rising.sum() >= falling.sum() else falling)
    stays = np.ones(len(symbols), bool)
    stays[first + 1] = False
    out = symbols.copy()
    _, name = np.unique(symbols[first] << 31 | symbols[first + 1], return_inverse=True)
    out[first] = fresh + name
    starts = np.flatnonzero(stays)
    return starts, out[starts]


def compress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar of ``symbols`` (not negative), the string itself first."""
    levels = [Level(symbols.astype(np.int64))]
    fresh, salt, pairs = int(symbols.max(initial=0)) + 1, 0, False
    while len(levels[-1].symbols) > 1:
        below = levels[-1].symbols
        salt += pairs
        starts, made = _pairs(below, fresh, salt) if pairs else _blocks(below, fresh)
        if len(made) < len(below):
            fresh = max(fresh, int(made.max()) + 1)
            levels.append(Level(made, np.append(starts, len(below)), pairs))
        pairs = not pairs
    return linked(levels)


def linked(levels: list[Level]) -> list[Level]:
    for low, high in zip(levels, levels[1:], strict=False):
        low.up = np.repeat(np.arange(len(high.symbols)), np.diff(high.down))
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the reversed string with the same blocks and pairs."""
    out = [Level(levels[0].symbols[::-1])]
    for low, high in zip(levels, levels[1:], strict=False):
        out.append(Level(high.symbols[::-1], len(low.symbols) - high.down[::-1], high.pairs))
    return linked(out)


def _steps(level: Level, x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much two places move past equal symbols inside their parents x and y, and whether
    a difference follows for sure, as one block is longer."""
    if level.pairs:
        return np.ones(len(x), np.int64), np.zeros(len(x), bool)
    left, right = level.down[x + 1] - at_x, level.down[y + 1] - at_y
    return np.minimum(left, right), left != right


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from place a and from place b on are equal, for each pair of places.

    Every extension must end before the string does: callers put a symbol of its own behind
    each part. a and b must differ.
    """
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), QUERIES):
        part = slice(at, at + QUERIES)
        out[part] = _extensions(levels, a[part], b[part])
    return out


def _extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parked: list[list[tuple[np.ndarray, ...]]] = [[] for _ in levels]
    query, x, y = np.arange(len(a)), a, b
    # Climb: equal symbols are passed until both places begin a symbol of the next level.
    for k, level in enumerate(levels):
        same = level.symbols[x] == level.symbols[y]
        parked[k].append((query[~same], x[~same], y[~same]))
        query, x, y = query[same], x[same], y[same]
        if not len(query):
            break
        above = levels[k + 1]
        parent_x, parent_y = level.up[x], level.up[y]
        inside = (above.down[parent_x] != x) | (above.down[parent_y] != y)
        step, ends = _steps(above, parent_x, parent_y, x, y)
        x, y = x + step * inside, y + step * inside
        ends &= inside
        parked[k].append((query[ends], x[ends], y[ends]))
        query, x, y = query[~ends], level.up[x[~ends]], level.up[y[~ends]]
    # Descend: two different symbols have at most one step of equal children in front.
    query = x = y = np.empty(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        query, x, y = (np.concatenate(c) for c in zip((query, x, y), *parked[k], strict=True))
        if k and len(query):
            level, below = levels[k], levels[k - 1].symbols
            at_x, at_y = level.down[x], level.down[y]
            step = _steps(level, x, y, at_x, at_y)[0] * (below[at_x] == below[at_y])
            x, y = at_x + step, at_y + step
    out = np.empty(len(a), np.int64)
    out[query] = x - a[query]
    return out
