"""Suffix sorting of one shard in external memory, with common-prefix values.

Suffixes are sorted by induction. The leftmost smaller suffixes (those that begin an ascent after a
descent) are sorted first: their short substrings get ordered names, and the string of names is
sorted by the same method one level down, or in memory once it is short enough. From them all
descending suffixes are induced in ascending order, and from those all ascending ones in descending
order. Between pushing and popping, suffixes wait in a priority queue keyed by their first symbol:
tuples (position, common prefix with the tuple pushed before for the same symbol) of a few numpy
arrays, spilled to disk as runs sorted by symbol, popped as a batch per symbol. The common prefix
of two induced suffixes is one more than the least common prefix between the suffixes that induced
them; values are capped, since a caller needs to know only whether a bound is reached.

Waiting tuples and the suffixes of the first pass are on disk. In memory are the text, its flags
and run lengths, and the starred suffixes: some 20 bytes per symbol.
"""
from __future__ import annotations

import bisect
import heapq
import os
import shutil
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

BATCH = 1 << 18
BUFFER = 1 << 20
IN_MEMORY = 1 << 22


class Queue:
    """Priority queue of (symbol, position, prefix) tuples; equal symbols keep their push order:
    runs in the order they were spilled, then what is held.

    A heap of run heads names the runs that may hold a symbol. Pops that go through the symbols in
    the queue's direction read each run forward through a memory map; a pop that skips symbols
    splits a run into two views. A run is deleted once it is used up.
    """

    def __init__(self, folder: str, buffer: int = BUFFER, descending: bool = False):
        self.folder, self.buffer, self.sign = folder, buffer, -1 if descending else 1
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0
        self.heads: list[tuple[int, int, int]] = []  # signed symbol, run, view
        self.views: dict[int, tuple] = {}  # signed symbols, positions and prefixes of a run
        self.open: dict[int, int] = {}  # views of each run
        self.number = 0
        self.made = 0

    def push(self, symbol: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> None:
        n = len(symbol)
        if not n:
            return
        if n == 1:
            self.held.setdefault(int(symbol[0]), []).append((position, prefix))
        else:
            order = np.argsort(symbol, kind="stable")
            s, p, c = symbol[order], position[order], prefix[order]
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), n]
            for a, b in zip(edges[:-1], edges[1:]):
                self.held.setdefault(int(s[a]), []).append((p[a:b], c[a:b]))
        self.size += n
        if self.size >= self.buffer:
            self._spill()

    def _path(self, run: int, label: str) -> str:
        return os.path.join(self.folder, f"queue-{id(self)}-{run}-{label}.npy")

    def _view(self, run: int, s: np.ndarray, p: np.ndarray, c: np.ndarray) -> None:
        if len(s):
            self.views[self.made] = (s, p, c)
            self.open[run] = self.open.get(run, 0) + 1
            heapq.heappush(self.heads, (int(s[0]), run, self.made))
            self.made += 1

    def _spill(self) -> None:
        keys = sorted(self.held, reverse=self.sign < 0)
        parts = [part for k in keys for part in self.held[k]]
        sizes = [sum(len(p) for p, _ in self.held[k]) for k in keys]
        arrays = []
        for label, a in (("s", np.repeat(np.array(keys, np.int64) * self.sign, sizes)),
                         ("p", np.concatenate([p for p, _ in parts])),
                         ("c", np.concatenate([c for _, c in parts]))):
            np.save(self._path(self.number, label), a)
            arrays.append(np.asarray(np.load(self._path(self.number, label), mmap_mode="r")))
        self._view(self.number, *arrays)
        self.number += 1
        self.held, self.size = {}, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of one symbol in push order; later pushes of it come with the next call."""
        key = symbol * self.sign
        found = []
        while self.heads and self.heads[0][0] <= key:
            found.append(heapq.heappop(self.heads)[1:])
        parts = []
        for run, view in sorted(found):
            s, p, c = self.views.pop(view)
            lo = 0 if s[0] == key else int(np.searchsorted(s, key))
            hi = lo + int(np.searchsorted(s[lo:], key, side="right"))
            if hi > lo:
                parts.append((np.array(p[lo:hi]), np.array(c[lo:hi])))
            self._view(run, s[:lo], p[:lo], c[:lo])
            self._view(run, s[hi:], p[hi:], c[hi:])
            self.open[run] -= 1
            if not self.open[run]:
                del self.open[run]
                for label in "spc":
                    os.remove(self._path(run, label))
        held = self.held.pop(symbol, [])
        self.size -= sum(len(p) for p, _ in held)
        parts += held
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


class _RangeMin:
    """Least common prefix since the last push of each symbol.

    A push leaves a time stamp. A stack holds, for rising values, the last time at which each was
    the least since; the first entry not before a time is the least value from there on. Values are
    capped, so the stack is no longer than the cap, and a step does no work per symbol.
    """

    NEVER = -2
    FEW = 16

    def __init__(self, symbols: int):
        self.last = np.full(symbols, self.NEVER, np.int64)
        self.times, self.values = [0], [0]
        self.now = 1

    def end_of_text(self, symbol: int) -> None:
        """The end, which shares no prefix, pushes the first suffix of ``symbol``."""
        self.last[symbol] = -1

    def step(self, prefix: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """``prefix`` of a batch of processed suffixes with their predecessors; those at ``at``
        push ``symbol``. Returns the least prefix between each and the push before it, -1 for the
        first push of a symbol."""
        if len(prefix) <= self.FEW:
            return self._one_by_one(prefix, at, symbol)
        out = np.empty(len(at), np.int32)
        if len(at):
            order = np.argsort(symbol, kind="stable")
            s, p = symbol[order], at[order]
            first = np.append(True, s[1:] != s[:-1])
            got = _least_of(prefix, np.where(first, 0, np.append(0, p[:-1] + 1)), p + 1)
            before = self.last[s[first]]
            place = np.searchsorted(np.array(self.times), before + 1)
            least = np.append(np.array(self.values), np.iinfo(np.int32).max)[place]
            got[first] = np.where(before == self.NEVER, -1, np.minimum(got[first], least))
            final = np.append(s[1:] != s[:-1], True)
            self.last[s[final]] = self.now + p[final]
            out[order] = got
        low = np.minimum.accumulate(prefix[::-1])[::-1]
        entry = np.flatnonzero(np.append(low[1:] != low[:-1], True))
        keep = bisect.bisect_left(self.values, int(low[0]))
        self.times[keep:] = (self.now + entry).tolist()
        self.values[keep:] = low[entry].tolist()
        self.now += len(prefix)
        return out

    def _one_by_one(self, prefix: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int32)
        pushes, k = at.tolist(), 0
        for i, x in enumerate(prefix.tolist()):
            keep = bisect.bisect_left(self.values, x)
            self.times[keep:] = [self.now]
            self.values[keep:] = [x]
            if k < len(pushes) and pushes[k] == i:
                before = int(self.last[symbol[k]])
                out[k] = (-1 if before == self.NEVER
                          else self.values[bisect.bisect_left(self.times, before + 1)])
                self.last[symbol[k]] = self.now
                k += 1
            self.now += 1
        return out


def _least_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair of bounds, hi > lo, from minima over powers of two."""
    table = [values]
    while (1 << len(table)) <= len(values):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int32)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << int(k))])
    return out


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of ascending suffixes (smaller than their successor) and length of the run of equal
    symbols at each position. The end counts as smaller than any symbol."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    starts = np.append(0, change + 1)
    up = np.append(text[change] < text[change + 1], False)
    size = ends - starts + 1
    ascending = np.repeat(up, size)
    run = np.repeat(ends, size) - np.arange(n) + 1
    return ascending, run


def _prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``cap``."""
    n = len(text)
    out = np.zeros(len(order), np.int32)
    if len(order) < 2:
        return out
    step = 16
    padded = np.concatenate([text, np.zeros(cap + step, text.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, step)
    for at in range(1, len(order), BATCH):
        a, b = order[at - 1: at - 1 + BATCH], order[at: at + BATCH]
        a = a[: len(b)]
        got = np.zeros(len(b), np.int32)
        live = np.arange(len(b))
        depth = 0
        while len(live) and depth < cap:
            differ = view[a[live] + depth] != view[b[live] + depth]
            some = differ.any(axis=1)
            got[live[some]] = depth + differ[some].argmax(axis=1)
            live = live[~some]
            depth += step
        got[live] = cap
        got = np.minimum(got, cap)
        out[at: at + len(b)] = np.minimum(got, n - np.maximum(a, b))
    return out


def _sort_in_memory(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by doubling, at least by the first ``depth`` symbols."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] if width < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if new.all() or width >= depth or width >= n:
            return order


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ordered names of the substrings from each star to the next one, both included. Where one
    is a prefix of another, the longer one goes on downwards and is smaller."""
    n, top = len(text), int(text.max()) + 2
    size = np.append(np.diff(stars) + 1, n - stars[-1])
    name = np.zeros(len(stars), np.int64)
    per = max(1, 62 // max(1, int(top).bit_length()))
    live = np.arange(len(stars))
    depth = 0
    padded = np.append(text.astype(np.int64), np.zeros(per, np.int64))
    while len(live):
        word = np.zeros(len(live), np.int64)
        for i in range(per):
            inside = depth + i < size[live]
            # What ends with the text is followed by its end, which is smaller than any symbol.
            symbol = np.where(inside, padded[np.minimum(stars[live] + depth + i, n)] + 1,
                              np.where(live == len(stars) - 1, 0, top))
            word = word * (top + 1) + symbol if per > 1 else symbol
        order = np.lexsort((word, name[live]))
        g, w = name[live][order], word[order]
        new_group = np.append(True, g[1:] != g[:-1])
        new = new_group | np.append(True, w[1:] != w[:-1])
        # A group keeps its first name; its parts are offset by how many precede them in it.
        place = np.arange(len(live))
        start = np.maximum.accumulate(np.where(new, place, 0))
        base = np.maximum.accumulate(np.where(new_group, place, 0))
        name[live[order]] = g + start - base
        count = np.diff(np.append(np.flatnonzero(new), len(live)))
        tied = np.repeat(count > 1, count)
        depth += per
        live = np.sort(live[order][tied])
        live = live[size[live] > depth]
    _, dense = np.unique(name, return_inverse=True)
    return dense.astype(np.int64)


def suffix_order(text: np.ndarray, cap: int, folder: str, in_memory: int = IN_MEMORY,
                 batch: int = BATCH, buffer: int = BUFFER, need_prefixes: bool = True
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (positions, common prefix with the suffix before, up to ``cap``), in descending
    order of suffixes; the prefix in a batch is with the next smaller suffix.

    Suffixes that agree on their first ``cap`` symbols may come in any order among themselves.
    """
    n = len(text)
    if n == 0:
        return
    ascending, run = _types(text)
    stars = np.flatnonzero(ascending[1:] & ~ascending[:-1]) + 1
    if len(stars) > 1:
        names = _names(text, stars)
        if int(names.max()) + 1 == len(names):
            ranked = np.empty(len(stars), np.int64)
            ranked[names] = np.arange(len(stars))
        elif len(names) <= in_memory:
            ranked = _sort_in_memory(names, cap)
        else:
            parts = [p for p, _ in suffix_order(names, cap, folder, in_memory, batch, buffer,
                                                False)]
            ranked = np.concatenate(parts)[::-1]
        stars = stars[ranked]
    symbols = int(text.max()) + 1
    star_prefix = (_prefixes(text, stars, cap) if need_prefixes
                   else np.zeros(len(stars), np.int32))
    star_symbol = text[stars].astype(np.int64)
    present = np.unique(text).astype(np.int64)

    # Descending suffixes, by ascending symbols.
    queue = Queue(folder, buffer)
    least = _RangeMin(symbols)
    spool = _Spool(folder, "down")

    def induce(position: np.ndarray, prefix: np.ndarray, c: int, upward: bool) -> None:
        for at in range(0, len(position), batch):
            p, x = position[at: at + batch], prefix[at: at + batch]
            before = np.where(p > 0, text[np.maximum(p - 1, 0)].astype(np.int64), -1)
            if upward:  # the predecessor is a descending suffix
                push = np.flatnonzero((p > 0) & ~ascending[np.maximum(p - 1, 0)])
            else:
                push = np.flatnonzero((p > 0) & ascending[np.maximum(p - 1, 0)])
            got = least.step(x, push, before[push])
            queue.push(before[push], p[push] - 1, np.minimum(got + 1, cap).astype(np.int32))

    # The last suffix is descending and first of its symbol: the end induces it.
    queue.push(np.array([int(text[n - 1])]), np.array([n - 1]), np.zeros(1, np.int32))
    least.end_of_text(int(text[n - 1]))
    for c in present.tolist():
        first = True
        last_down = -1
        while True:
            p, x = queue.pop(c)
            if not len(p):
                break
            if first:
                x[0] = 0
                first = False
            spool.add(c, p, x)
            last_down = int(p[-1])
            induce(p, x, c, True)
        lo, hi = np.searchsorted(star_symbol, [c, c + 1])
        if hi > lo:
            x = star_prefix[lo:hi].copy()
            x[0] = 0 if first else min(run[last_down], run[stars[lo]], cap)
            induce(stars[lo:hi], x, c, True)

    # Ascending suffixes, by descending symbols. Walking down, the prefix that belongs to a
    # suffix is the one with the suffix met before, that is the next larger one.
    queue = Queue(folder, buffer, descending=True)
    least = _RangeMin(symbols)
    for c in present[::-1].tolist():
        first = True
        last_up = -1
        emitted: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            p, x = queue.pop(c)
            if not len(p):
                break
            if first:
                x[0] = 0
                first = False
            last_up = int(p[-1])
            induce(p, x, c, False)
            emitted.append((p, x))
        p, x = spool.take(c)
        if len(p):
            # Ascending order with prefixes to the smaller one becomes descending with prefixes
            # to the larger one.
            p, x = p[::-1], np.append(0, x[::-1][:-1]).astype(np.int32)
            x[0] = 0 if first else min(run[last_up], run[p[0]], cap)
            induce(p, x, c, False)
            emitted.append((p, x))
        for p, x in emitted:
            yield p, x
    spool.close()


class _Spool:
    """Descending suffixes of each symbol, on disk between the two passes: added by rising symbols
    and taken by falling ones, so that only a stack of places is in memory."""

    def __init__(self, folder: str, label: str):
        self.path = os.path.join(folder, f"{label}-{id(self)}.bin")
        self.file = open(self.path, "w+b")
        self.end = 0
        self.symbols, self.places, self.sizes = array("q"), array("q"), array("q")

    def add(self, c: int, p: np.ndarray, x: np.ndarray) -> None:
        self.file.write(p.astype(np.int64).tobytes())
        self.file.write(x.astype(np.int32).tobytes())
        self.symbols.append(c)
        self.places.append(self.end)
        self.sizes.append(len(p))
        self.end += 12 * len(p)

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        ps, xs = [], []
        while self.symbols and self.symbols[-1] == c:
            self.symbols.pop()
            n = self.sizes.pop()
            self.file.seek(self.places.pop())
            ps.append(np.frombuffer(self.file.read(8 * n), np.int64))
            xs.append(np.frombuffer(self.file.read(4 * n), np.int32))
        if not ps:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(ps[::-1]), np.concatenate(xs[::-1])

    def close(self) -> None:
        self.file.close()
        os.remove(self.path)


class ScratchFolder:
    """A folder of the task's own that goes away with the task; nothing in it is shared."""

    def __enter__(self) -> str:
        self.path = tempfile.mkdtemp(prefix="suffixes-")
        return self.path

    def __exit__(self, *error) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


def repeated(text: np.ndarray, wanted: np.ndarray, length: int, **options) -> np.ndarray:
    """Flags of the positions in ``wanted`` (a mask) whose ``length`` symbols also start at another
    wanted position."""
    hit = np.zeros(len(text), bool)
    with ScratchFolder() as folder:
        last = -1  # the wanted suffix met before
        near = 0  # least prefix since then
        for p, x in suffix_order(text, length, folder, **options):
            want = np.flatnonzero(wanted[p])
            if not len(want):
                near = min(near, int(x.min()))
                continue
            # Prefix between neighbouring wanted suffixes: least value on the way.
            low = np.minimum.reduceat(x[: want[-1] + 1], np.append(0, want[:-1] + 1))
            low[0] = min(near, int(low[0])) if last >= 0 else 0
            same = low >= length
            hit[p[want[same]]] = True
            if same[0]:
                hit[last] = True
            if len(want) > 1:
                hit[p[want[:-1]][same[1:]]] = True
            last = int(p[want[-1]])
            rest = x[want[-1] + 1:]
            near = int(rest.min()) if len(rest) else np.iinfo(np.int32).max
    return hit
