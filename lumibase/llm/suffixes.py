"""The numpy core of suffix-array deduplication: anchors of windows, suffix order, and longest previous factors.

Every window of ``least`` bytes has an anchor: of the ``GRAM``-byte strings in it the one with the least hash, the
leftmost of equals. Equal windows have equal anchors at equal places, so only windows of equal anchors need to be
compared. Neighbouring windows mostly share their anchor; such a stretch of windows is a run.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
SEGMENT = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(7))
#: Fixed random numbers for each byte, and odd multipliers.
TABLE, TABLE2 = _RANDOM.integers(0, 1 << 64, (2, 256), np.uint64)
MULTIPLIER, BASE = (_RANDOM.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)).tolist()
PLACE = np.uint64((1 << 24) - 1)
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = _powers(BASE, SEGMENT + 4096), _powers(pow(BASE, -1, 1 << 64), SEGMENT + 4096)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    x, size, factor = TABLE[data], 1, MULTIPLIER
    while size < GRAM:
        x = x[:-size] * np.uint64(factor) + x[size:]
        size, factor = 2 * size, factor * factor & MASK
    return _mixed(x)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Spans:
    """Hashes of any spans of one segment, from prefix sums."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _POWERS if len(data) <= len(_POWERS[0]) else (_powers(BASE, len(data)), _powers(pow(BASE, -1, 1 << 64), len(data)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE2[data] * powers[: len(data)])))

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[first]) * self.inverse[first] + (end - first).astype(np.uint64))


def runs(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of a segment of whole texts, whose ends are given: first window, last window, hash of the
    anchor, hash of all bytes that the run's windows cover. Windows never cross an end."""
    if len(data) < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    grams = gram_hashes(data)
    at = np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_least((grams & ~PLACE) | at, least - GRAM + 1) & PLACE).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(len(anchor) + 1, np.int64)
    long = ends - starts >= least
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - least + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(new & valid)
    stop = np.ones(len(anchor), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    return first, last, grams[anchor[first]], Spans(data).of(first, last + least)


def pieces(lengths: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Segments of texts of these lengths, as (first text, end text, first byte, end byte in the one text).

    Short texts share a segment of about SEGMENT bytes. A longer text has several, each SEGMENT windows long, which
    overlap by the bytes that a window is longer than one."""
    out, first, size = [], 0, 0
    for n, length in enumerate(lengths):
        if length > SEGMENT or size + length > SEGMENT:
            if first < n:
                out.append((first, n, 0, 0))
            first, size = n, 0
        if length > SEGMENT:
            out += [(n, n + 1, at, min(length, at + SEGMENT + least - 1)) for at in range(0, length - least + 1, SEGMENT)]
            first = n + 1
        else:
            size += length
    if first < len(lengths):
        out.append((first, len(lengths), 0, 0))
    return out


def batch_runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Runs of a batch: number of the text, first window, number of windows, anchor hash, hash of the run's bytes."""
    found = []
    for a, b, at, end in pieces([len(t) for t in texts], least):
        part = [texts[a][at:end]] if end else texts[a:b]
        ends = np.cumsum([len(t) for t in part])
        first, last, anchor, content = runs(np.frombuffer(b"".join(part), np.uint8), ends, least)
        text = np.searchsorted(ends, first, side="right")
        begin = np.concatenate(([0], ends[:-1]))[text] if len(first) else first
        found.append((text + a, first - begin + at, last - first + 1, anchor, content))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before; the first always does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys (equal ones stay in place) and each place's rank, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(changes(keys[order])) - 1
    return order, rank


def suffix_order(symbols: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes of a string of symbols below 511 in order of their first ``most`` symbols at least (in text order
    where these are equal), by prefix doubling; and for each width met the ranks of all prefixes of that width.

    The first ranks are those of seven symbols, which one number holds; each step joins the ranks of two neighbouring
    prefixes. What lies behind the end counts as 0, below all symbols."""
    n = len(symbols)
    ends = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(6, np.int64)))
    keys = np.zeros(n, np.int64)
    for k in range(7):
        keys = keys << 9 | ends[k : k + n]
    order, rank = _dense(keys)
    widths, width = [(7, rank)], 7
    while n and width < most and rank[order[-1]] < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        order, rank = _dense(rank * (n + 1) + behind)
        width *= 2
        widths.append((width, rank))
    return order, widths


def common_prefixes(symbols: np.ndarray, widths: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, up to ``most``: by descending widths, then by symbols."""
    n, shared = len(symbols), np.zeros(len(a), np.int64)

    def same(values: np.ndarray) -> np.ndarray:
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < n
        return inside & (values[np.minimum(x, n - 1)] == values[np.minimum(y, n - 1)])

    for width, rank in reversed(widths):
        shared += width * same(rank)
    for _ in range(6):
        hit = same(symbols)
        if not hit.any():
            break
        # a suffix whose widths have all matched may go on; others have stopped at their first difference
        shared += hit
    return np.minimum(shared, most)


def nearest_smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before it, and after it, that has a smaller text position
    (-1: none). All places step at once: whoever points at a larger position goes on to where that one points."""
    found = []
    for values in (order, order[::-1]):
        at = np.arange(len(values)) - 1
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            open_ = open_[values[at[open_]] > values[open_]]
            at[open_] = at[at[open_]]
            open_ = open_[at[open_] >= 0]
        found.append(at)
    after = found[1][::-1]
    return found[0], np.where(after < 0, -1, len(order) - 1 - after)


def longest_previous_factors(symbols: np.ndarray, most: int, asked: np.ndarray | None = None) -> np.ndarray:
    """For each position the length, up to ``most``, of the longest string from there on that also starts earlier (0
    where a mask of ``asked`` positions leaves it out).

    In suffix order the earlier positions that share most with a suffix are the nearest ones before and after it that
    have a smaller position; the longer of the two common prefixes is the longest previous factor."""
    lpf = np.zeros(len(symbols), np.int64)
    if not len(symbols):
        return lpf
    order, widths = suffix_order(symbols, most)
    for near in nearest_smaller(order):
        has = np.flatnonzero(near >= 0 if asked is None else (near >= 0) & asked[order])
        here = order[has]
        lpf[here] = np.maximum(lpf[here], common_prefixes(symbols, widths, here, order[near[has]], most))
    return lpf


def previous_matches(runs_of_bytes: list[bytes], least: int) -> np.ndarray:
    """Whether the longest previous factor of each window of ``least`` bytes in runs that are in text order has
    ``least`` bytes. A separator below all bytes stands behind each run; no window holds one, so no match does."""
    if not runs_of_bytes:
        return np.zeros(0, bool)
    sizes = np.fromiter(map(len, runs_of_bytes), np.int64, len(runs_of_bytes))
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.int16)
    inside = np.ones(len(symbols), bool)
    inside[begin + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(runs_of_bytes), np.uint8).astype(np.int16) + 1
    counts = sizes - (least - 1)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.repeat(begin, counts) + within
    asked = np.zeros(len(symbols), bool)
    asked[windows] = True
    return longest_previous_factors(symbols, least, asked)[windows] >= least
