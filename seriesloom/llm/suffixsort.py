"""External induced sorting of suffixes with their common prefixes.

Suffixes that begin lower than their successor (S) after one that doesn't (L) are sorted
first; the order of all others follows: read in order, each sorted suffix puts the one
before it into the queue of its first symbol, L-suffixes upwards and S-suffixes downwards.
Queue entries are (place, common prefix with the entry before); a common prefix is one more
than the least one passed over since the last entry. Queues and sorted parts beyond
`memory` bytes go to an unnamed file of the task's scratch folder, like a shuffle's spill:
nothing else reads it, and a task that is run again makes it anew.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

MEMORY = 1 << 26
BASE = 1 << 22  # so many first suffixes are sorted directly, more by recursion
STEP = 1 << 18  # entries handled at once

Part = tuple[np.ndarray, np.ndarray]  # places and common prefixes


class Queues:
    """A first-in-first-out queue for each symbol, spilled to disk as a whole."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: dict[int, list] = defaultdict(list)

    def push(self, symbol: int, part: Part) -> None:
        self.parts[symbol].append(part)
        self.held += part[0].nbytes + part[1].nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            own = [k for k, p in enumerate(parts) if p[0] is not None]
            if own:
                places, common = (np.concatenate([parts[k][i] for k in own]) for i in (0, 1))
                at = self.file.tell()
                self.file.write(places.tobytes() + common.tobytes())
                parts[own[0] :] = [(None, (at, len(places)))]  # what is in memory stands behind what isn't
        self.held = 0

    def _read(self, part) -> Part:
        if part[0] is not None:
            return part
        at, n = part[1]
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def _pieces(self, parts: list) -> Iterator[Part]:
        """The parts' entries, STEP at once as far as there are so many."""
        few: list[Part] = []
        n = 0
        for part in parts:
            few.append(self._read(part))
            n += len(few[-1][0])
            if n >= STEP or part is parts[-1]:
                places, common = (np.concatenate([f[i] for f in few]) if len(few) > 1 else few[0][i] for i in (0, 1))
                for k in range(0, n, STEP):
                    yield places[k : k + STEP], common[k : k + STEP]
                few, n = [], 0

    def drain(self, symbol: int) -> Iterator[Part]:
        """Take all entries, also those that are put in meanwhile."""
        while parts := self.parts.pop(symbol, None):
            self.held -= sum(p[0].nbytes + p[1].nbytes for p in parts if p[0] is not None)
            yield from self._pieces(parts)

    def pieces(self, symbol: int) -> Iterator[Part]:
        """All entries, which stay."""
        yield from self._pieces(self.parts.get(symbol, []))

    def backwards(self, symbol: int) -> Iterator[Part]:
        """All entries, which stay, from the last one to the first; an entry's common prefix
        is that with the entry that comes before it then, the first one's is 0."""
        parts = self.parts.get(symbol, [])
        before = np.zeros(1, np.uint8)
        while parts:
            n, k = 0, len(parts)
            while k and n < STEP:
                k -= 1
                n += parts[k][1][1] if parts[k][0] is None else len(parts[k][0])
            few = [self._read(p) for p in parts[k:]]
            places, common = (np.concatenate([f[i] for f in few])[::-1] for i in (0, 1))
            yield places, np.concatenate([before, common[:-1]])
            before, parts = common[-1:], parts[:k]


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair; an empty range gives 255."""
    size = np.maximum(last - first + 1, 1)
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = [values]
    for k in range(int(level.max(initial=0))):
        table.append(np.minimum(table[-1], np.concatenate([table[-1][1 << k :], np.full(min(1 << k, len(values)), 255, np.uint8)])))
    table = np.stack(table)
    safe = np.minimum(first, len(values) - 1)
    found = np.minimum(table[level, safe], table[level, np.maximum(last - (1 << level.astype(np.int64)) + 1, 0)])
    return np.where(last >= first, found, np.uint8(255))


class Induction:
    """One direction: sorted suffixes are read, those before them are put into queues."""

    def __init__(self, text: np.ndarray, depth: int, memory: int, common: bool):
        self.text, self.depth, self.queues = text, depth, Queues(memory)
        # by symbol, the least common prefix since its last entry; below 0: no entry yet
        self.since = np.full(256, -1, np.int16) if common else None

    def put_before(self, places: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        """Put in the suffix before each of `places` that is wanted."""
        idx = np.flatnonzero(wanted)
        if not len(idx):
            if self.since is not None:
                self.since = np.minimum(self.since, common.min(initial=255))
            return
        symbols = self.text[places[idx] - 1]
        order = np.argsort(symbols, kind="stable")
        idx, symbols = idx[order], symbols[order]
        starts = np.flatnonzero(np.diff(symbols.astype(np.int64), prepend=-1))
        ends = np.append(starts[1:], len(symbols))
        prefix = np.zeros(len(idx), np.uint8)
        if self.since is not None:
            first = np.zeros(len(idx), np.int64)
            first[1:] = idx[:-1] + 1
            first[starts] = 0
            least = least_between(common, first, idx).astype(np.int16)
            least[starts] = np.minimum(least[starts], self.since[symbols[starts]])
            prefix = np.minimum(least + 1, self.depth).astype(np.uint8)
            self.since = np.minimum(self.since, common.min())
            self.since[symbols[starts]] = least_between(common, idx[ends - 1] + 1, np.full(len(ends), len(common) - 1))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            self.queues.push(int(symbols[a]), (places[idx[a:b]] - 1, prefix[a:b]))


def _words(text: np.ndarray, bits: int, width: int):
    """Function from places to `width` symbols as one number that sorts as they do."""
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    if bits == 8:
        view = sliding_window_view(padded, 8)
        return lambda p: np.ascontiguousarray(view[np.minimum(p, len(text))]).view(">u8")[:, 0].astype(np.uint64)

    def wide(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.uint64)
        for j in range(width):
            q = np.minimum(p + j, len(text))
            out = (out << np.uint64(bits)) | np.where(q < len(text), padded[q].astype(np.uint64) + np.uint64(1), np.uint64(0))
        return out

    return wide


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Of numbers of 8 symbols that differ by x: how many symbols are equal before."""
    return sum((x < np.uint64(1 << 8 * k)).astype(np.uint8) for k in range(1, 8))


def by_prefix(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by the first `depth` symbols (a few more are looked at), with the
    symbols that each has in common with the one before, if symbols are bytes; later places
    first where these are equal, so the end of the text sorts before all symbols."""
    bits, width = (8, 8) if text.dtype == np.uint8 else (32, 2)
    words = _words(text, bits, width)
    order = places[::-1].copy()
    common = np.full(len(order), depth, np.uint8)
    common[:1] = 0
    low = np.zeros(len(order), np.int32)  # group of each, in the order
    open_ = np.arange(len(order), dtype=np.int32)
    for at in range(0, depth, width):
        key = words(order[open_] + at)
        by = np.lexsort((key, low[open_])) if at else np.argsort(key)
        order[open_], key = order[open_][by], key[by]
        group = low[open_]
        fresh = key[1:] != key[:-1]
        new = np.r_[True, fresh | (group[1:] != group[:-1])] if len(key) else np.zeros(0, bool)
        if bits == 8:
            split = np.flatnonzero(fresh & (group[1:] == group[:-1])) + 1
            common[open_[split]] = np.minimum(at + _equal_bytes(key[split] ^ key[split - 1]), depth)
        low[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else low[open_]
        open_ = open_[~(new & np.r_[new[1:], True])] if len(new) else open_
        if not len(open_):
            break
    else:
        order[open_] = order[open_][np.lexsort((-order[open_], low[open_]))]
    at_end = np.minimum(len(text) - order, depth)
    common[1:] = np.minimum(common[1:], np.minimum(at_end[1:], at_end[:-1]))
    return order, common


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the pieces from each first suffix's place to the next one's, both included;
    of two where one begins with the other, the longer sorts first. The last piece goes on
    to the end of the text, which sorts before all symbols."""
    sizes = np.append(stars[1:], len(text)) - stars + 1
    order, low = np.arange(len(stars)), np.zeros(len(stars), np.int64)
    open_ = np.arange(len(stars))
    at = 0
    while len(open_):
        own = order[open_]
        key = np.where(stars[own] + at < len(text), text[np.minimum(stars[own] + at, len(text) - 1)].astype(np.int64), -1)
        key = np.where(at < sizes[own], key, np.iinfo(np.int64).max)
        by = np.lexsort((key, low[open_]))
        order[open_], key = own[by], key[by]
        group = low[open_]
        new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        low[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        at += 1
        tied = ~(new & np.r_[new[1:], True]) & (at <= sizes[order[open_]])  # once more, as ended
        open_ = open_[tied]
    names = np.empty(len(stars), np.int64)
    names[order] = np.cumsum(np.r_[True, low[1:] != low[:-1]]) - 1
    return names


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols in common of the suffixes at a and b, `depth` at most."""
    out = np.zeros(len(a), np.int64)
    view = sliding_window_view(np.concatenate([text, np.zeros(8, text.dtype)]), 8)
    open_ = np.arange(len(a))
    for at in range(0, depth, 8):
        differ = view[np.minimum(a[open_] + at, len(text))] != view[np.minimum(b[open_] + at, len(text))]
        some = differ.any(axis=1)
        out[open_] = at + np.where(some, differ.argmax(axis=1), 8)
        open_ = open_[~some]
    return np.minimum(np.minimum(out, depth), len(text) - np.maximum(a, b)).astype(np.uint8)


def _run(text: np.ndarray, place: int, depth: int) -> int:
    part = text[place : place + depth] != text[place]
    return int(part.argmax()) if part.any() else len(part)


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether a suffix sorts before the one that begins a place later."""
    out = np.zeros(len(text), bool)
    for k in reversed(range(0, len(text), STEP)):
        part = text[k : k + STEP + 1].astype(np.int64)
        step = np.diff(part) if len(part) > STEP else np.diff(part, append=-1)
        # the next place with another symbol behind it decides, else what follows the part
        nearest = np.minimum.accumulate(np.where(step != 0, np.arange(len(step)), len(step))[::-1])[::-1]
        after = len(part) > STEP and out[k + STEP]
        out[k : k + STEP] = np.where(nearest < len(step), step[np.minimum(nearest, len(step) - 1)] > 0, after)
    return out


def sorted_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY, base: int = BASE, common: bool = True) -> Iterator[Part]:
    """Places of all suffixes in order, with the symbols that each has in common with the
    one before (`depth` at most, under 255). The order is right for the first `depth`
    symbols, ties beyond are in any order."""
    n = len(text)
    if not n:
        return
    rising = _rising(text)
    stars = np.flatnonzero(rising & ~np.r_[True, rising[:-1]])
    shared = None
    if len(stars) <= base:
        stars, shared = by_prefix(text, stars, depth)
    else:
        names = _names(text, stars)
        if names.max() + 1 < len(names):
            parts = sorted_suffixes(names, depth, memory, base, False)
            stars = stars[np.concatenate([p for p, _ in parts])]
        else:
            stars = stars[np.argsort(names)]
    if shared is None:
        shared = np.zeros(len(stars), np.uint8)
        for k in range(1, len(stars) if common else 0, STEP):
            shared[k : k + STEP] = common_prefix(text, stars[k - 1 : k - 1 + STEP][: len(stars) - k], stars[k : k + STEP], depth)
    firsts = text[stars]

    def boundary(falling: int, climbing: int) -> int:
        """Of an L- and an S-suffix of one symbol: the shorter run of it."""
        return min(_run(text, falling, depth), _run(text, climbing, depth))

    up, lower = Induction(text, depth, memory, common), Queues(memory)
    up.queues.push(int(text[n - 1]), (np.array([n - 1]), np.zeros(1, np.uint8)))
    if common:
        up.since[text[n - 1]] = 0
    used = np.flatnonzero(np.bincount(text)) if text.dtype == np.uint8 else np.unique(text)
    for c in used.tolist():
        last = None
        for places, prefix in up.queues.drain(c):
            lower.push(c, (places, prefix))
            last = int(places[-1])
            before = np.maximum(places - 1, 0)
            up.put_before(places, prefix, (places > 0) & ~rising[before])
        a, b = np.searchsorted(firsts, (c, c + 1))
        for k in range(a, b, STEP):
            places, prefix = stars[k : min(k + STEP, b)], shared[k : min(k + STEP, b)].copy()
            if k == a:
                prefix[0] = boundary(last, int(places[0])) if last is not None and common else 0
            up.put_before(places, prefix, np.ones(len(places), bool))
    del up
    down, upper = Induction(text, depth, memory, common), Queues(memory)
    for c in reversed(used.tolist()):
        last = None
        for places, prefix in down.queues.drain(c):
            upper.push(c, (places, prefix))
            last = int(places[-1])
            before = np.maximum(places - 1, 0)
            down.put_before(places, prefix, (places > 0) & rising[before])
        for k, (places, prefix) in enumerate(lower.backwards(c)):
            if k == 0 and last is not None and common:
                prefix = prefix.copy()
                prefix[0] = boundary(int(places[0]), last)
            before = np.maximum(places - 1, 0)
            down.put_before(places, prefix, (places > 0) & rising[before])
    del down
    for c in used.tolist():
        last = None
        for places, prefix in lower.pieces(c):
            last = int(places[-1])
            yield places, prefix
        for k, (places, prefix) in enumerate(upper.backwards(c)):
            if k == 0 and last is not None and common:
                prefix = prefix.copy()
                prefix[0] = boundary(last, int(places[0]))
            yield places, prefix
