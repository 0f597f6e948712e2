"""Vectorised segmentation of text batches.

A slice of texts becomes one array of code points; segments (words, runs, pre-tokens) are index
ranges of it, and every segment gets a 64-bit hash from prefix sums. Work per character is a few
numpy passes; only segments that a task has not met before reach per-string Python.
"""
from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SLICE_CHARS = 1 << 19
_ROOT = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: white space, letter, number or anything else."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            table[ord(m[0][0]): ord(m[0][-1]) + 1] = kind
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def point_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_ROOT))


def give_back() -> None:
    """Hand freed memory back to the system; the C library would keep it for the process, which in
    a driver lives on through all later stages. Does nothing where that library cannot."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frees_memory(job: Callable) -> Callable:
    """Run a job and give back what it freed, also after an error."""
    @wraps(job)
    def run(*args, **kwargs):
        try:
            return job(*args, **kwargs)
        finally:
            give_back()

    return run


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, step: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``step`` modulo 2**64 and their inverses, at least ``n`` of each."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (step, pow(step, -1, 1 << 64)):
            a = np.ones(size, np.uint64)
            done = 1
            while done < size:
                factor = np.uint64(pow(base, done, 1 << 64))
                a[done: 2 * done] = a[:done] * factor
                done *= 2
            out.append(a)
        have = _powers[step] = (out[0], out[1])
    return have


@dataclass
class Slice:
    """Texts number ``first`` on of a batch: their code points, end to end."""

    first: int
    text: str
    points: np.ndarray
    starts: np.ndarray  # of texts, plus the total length

    @property
    def size(self) -> int:
        return len(self.points)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[Slice]:
    """Cut a list of texts into slices of about ``limit`` characters, whole texts each."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= limit):
            total += len(texts[j])
            j += 1
        part = texts[i:j]
        joined = "".join(part)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) for t in part], out=starts[1:])
        yield Slice(i, joined, points, starts)
        i = j


def run_starts(piece: Slice, kinds: np.ndarray) -> np.ndarray:
    """Flags of positions where a run of one class begins; runs end with their text."""
    flags = np.empty(piece.size, bool)
    if piece.size:
        flags[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=flags[1:])
        inner = piece.starts[:-1]
        flags[inner[inner < piece.size]] = True
    return flags


def words(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number (within the slice) of runs without white space."""
    solid = (class_table()[piece.points] != SPACE).astype(np.uint8)
    begin = np.flatnonzero(run_starts(piece, solid))
    end = np.append(begin[1:], piece.size)
    keep = solid[begin] == 1
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(piece.starts, begin, side="right") - 1


#: The contractions that the public split pattern takes first.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


def pretokens(piece: Slice) -> np.ndarray:
    """Starts of the matches of the public byte-level split pattern, text by text.

    A run of letters, numbers or other signs takes one plain space before it; a longer run of
    white space leaves its last character to what follows; a lone apostrophe takes a contraction.
    """
    n = piece.size
    if not n:
        return np.zeros(0, np.int64)
    points = piece.points
    kinds = class_table()[points]
    runs = run_starts(piece, kinds)
    begin = np.flatnonzero(runs)
    length = np.diff(begin, append=n)
    kind = kinds[begin]
    opens = np.zeros(n + 1, bool)
    opens[piece.starts] = True
    start = np.append(runs, True)

    white = kind == SPACE
    follow = begin + length
    inner = white & ~opens[follow]
    last = follow[inner] - 1
    start[last[length[inner] >= 2]] = True
    start[last[points[last] == 0x20] + 1] = False

    lone = begin[(kind == OTHER) & (length == 1) & (points[begin] == 0x27)]
    lone = lone[start[lone] & ~opens[lone + 1]]
    if len(lone):
        at = np.searchsorted(begin, lone + 1)
        run = length[at]
        letters = kind[at] == LETTER
        c1 = points[lone + 1]
        c2 = np.where(run >= 2, points[np.minimum(lone + 2, n - 1)], 0)
        one = letters & np.isin(c1, [ord(c) for c in ONE_LETTER])
        two = np.zeros(len(lone), bool)
        for a, b in TWO_LETTERS:
            two |= (c1 == ord(a)) & (c2 == ord(b))
        two &= letters & (run >= 2) & ~one
        start[lone[one | two] + 1] = False
        start[lone[one & (run >= 2)] + 2] = True
        start[lone[two & (run >= 3)] + 3] = True
    return np.flatnonzero(start[:n])


def prefix_hash(piece: Slice) -> np.ndarray:
    """Prefix sums from which ``segment_hash`` reads the hash of any range."""
    up, _ = powers(piece.size + 1)
    sums = np.zeros(piece.size + 1, np.uint64)
    np.cumsum(point_codes()[piece.points] * up[: piece.size], out=sums[1:])
    return sums


def segment_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


_filled: Callable[[], object] = lambda: None  # reference to the table that this worker holds


def hold_only(table: object) -> None:
    """Empty the word table that an earlier task of this worker has filled for something else.

    Spark keeps workers for the next stages, which would hold its words beside their own."""
    global _filled
    before = _filled()
    if before is not table:
        if before is not None:
            before.clear()
        _filled = weakref.ref(table)


class SegmentCodes:
    """Code lists of distinct segments, kept from batch to batch within a Python worker.

    ``encode`` gets strings not met before and returns one list of integers for each. The memory
    is bounded: beyond ``most`` segments the table starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 2_000_000,
                 dtype=np.uint32):
        self.encode, self.most, self.dtype = encode, most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int32)
        self.codes = np.zeros(1 << 14, self.dtype)
        self.n = self.used = 0

    def _grow(self, name: str, size: int) -> None:
        a = getattr(self, name)
        if len(a) < size:
            b = np.zeros(max(size, 2 * len(a)), a.dtype)
            b[: len(a)] = a
            setattr(self, name, b)

    def _add(self, keys: np.ndarray, strings: list[str]) -> None:
        lists = self.encode(strings)
        size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        flat = np.fromiter((c for x in lists for c in x), self.dtype, int(size.sum()))
        self._grow("begin", self.n + len(lists))
        self._grow("count", self.n + len(lists))
        self._grow("codes", self.used + len(flat))
        self.begin[self.n: self.n + len(lists)] = self.used + np.cumsum(size) - size
        self.count[self.n: self.n + len(lists)] = size
        self.codes[self.used: self.used + len(flat)] = flat
        self.keys = np.concatenate([self.keys, keys])
        self.slots = np.concatenate([self.slots, np.arange(self.n, self.n + len(lists))])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.slots = self.keys[order], self.slots[order]
        self.n += len(lists)
        self.used += len(flat)

    def lookup(self, text: str, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """Number of codes of each segment, and all codes end to end."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, self.dtype)
        hold_only(self)
        if self.n > self.most:
            self.clear()
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            where = first[new]
            self._add(distinct[new], [text[b:e] for b, e in zip(begin[where].tolist(),
                                                                 end[where].tolist())])
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][back]
        size = self.count[slot].astype(np.int64)
        total = int(size.sum())
        index = np.arange(total) + np.repeat(self.begin[slot] - (np.cumsum(size) - size), size)
        return size, self.codes[index]


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut a very long text before plain single spaces, where any split pattern starts anew."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    cut = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
    while len(text) - at > limit:
        m = cut.search(text, at + limit)
        if m is None:
            break
        out.append(text[at: m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def text_codes(texts: list[str], codes: SegmentCodes, byte_level: bool,
               limit: int = SLICE_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Number of codes of each text, and the codes of all texts end to end."""
    parts: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        for p in safe_pieces(t, limit):
            parts.append(p)
            owner.append(i)
    counts = np.zeros(len(parts), np.int64)
    out = []
    for piece in slices(parts, limit):
        if byte_level:
            begin = pretokens(piece)
            end = np.append(begin[1:], piece.size)
        else:
            begin, end, _ = words(piece)
        if not len(begin):
            continue
        sums = prefix_hash(piece)
        size, flat = codes.lookup(piece.text, begin, end, segment_hash(sums, begin, end))
        total = np.concatenate([[0], np.cumsum(size)])
        edge = total[np.searchsorted(begin, piece.starts)]
        counts[piece.first: piece.first + len(piece.starts) - 1] = np.diff(edge)
        out.append(flat)
    whole = np.zeros(len(texts), np.int64)
    np.add.at(whole, np.asarray(owner, np.int64), counts)
    return whole, np.concatenate(out) if out else np.zeros(0, codes.dtype)


def first_indices(counts: np.ndarray) -> np.ndarray:
    """Offsets of groups laid end to end, one more than there are groups."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def fill(counts: np.ndarray, value, dtype) -> np.ndarray:
    return np.repeat(np.asarray(value, dtype), counts)
