"""Encoders for distinct segments, from public tokenizer files; built once per Python worker."""
from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

from monthloom.llm.textcodes import SegmentCodes, class_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The public byte-to-sign table: printable bytes stay, the others move above 255."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def as_signs(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_alphabet())


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def byte_level_codes(path: str) -> SegmentCodes:
    """Ids of pre-tokens by a byte-level tokenizer file."""
    model = _load(path).model

    def encode(strings: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(as_signs(s))] for s in strings]

    return SegmentCodes(encode, dtype=np.uint16)


@lru_cache(maxsize=4)
def word_codes(path: str) -> SegmentCodes:
    """Ids of words (runs without white space) by a lower-casing word tokenizer file.

    A word of letters below U+0300, where neither normal form nor lower case depends on
    neighbours, goes straight to the merges; any other word takes the whole tokenizer.
    """
    whole = _load(path)
    model = whole.model
    kinds = class_table()

    def encode(strings: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        later: list[int] = []
        for i, s in enumerate(strings):
            if s.isalpha() and max(s) < "̀" and "İ" not in s and kinds[ord(s[0])] == 1:
                out.append([t.id for t in model.tokenize(as_signs(s.lower()))])
            else:
                out.append([])
                later.append(i)
        for i, e in zip(later, whole.encode_batch_fast([strings[i] for i in later],
                                                       add_special_tokens=False)):
            out[i] = e.ids
        return out

    return SegmentCodes(encode)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token: the neighbours of lowest rank join first, leftmost first.

    Long pre-tokens keep their pairs in a heap, so the cost stays near linear.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i: i + 1] for i in range(len(word))]
    none = 1 << 60
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        best = min(pair)
        if best == none:
            break
        i = pair.index(best)
        parts[i: i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    from heapq import heapify, heappop, heappush

    n = len(word)
    stop = list(range(1, n + 1))  # end of the part that begins here, 0 once it is merged away
    back = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i: i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        r, i, end = heappop(heap)
        mid = stop[i]
        if not mid or mid >= n or not stop[mid] or stop[mid] != end:
            continue
        stop[i], stop[mid] = end, 0
        if end < n:
            back[end] = i
            q = ranks.get(word[i: stop[end]])
            if q is not None:
                heappush(heap, (q, i, stop[end]))
        if i:
            b = back[i]
            q = ranks.get(word[b:end])
            if q is not None:
                heappush(heap, (q, b, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i: stop[i]]])
        i = stop[i]
    return out


@lru_cache(maxsize=4)
def rank_codes(path: str) -> SegmentCodes:
    """Ids of pre-tokens by a file of byte ranks."""
    ranks = read_ranks(path)

    def encode(strings: list[str]) -> list[list[int]]:
        return [merge_bytes(s.encode("utf-8", "surrogatepass"), ranks) for s in strings]

    return SegmentCodes(encode)


@lru_cache(maxsize=4)
def rank_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id of a rank file, end to end, and where each begins."""
    ranks = read_ranks(path)
    items: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        items[i] = b
    begin = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(b) for b in items], out=begin[1:])
    return np.frombuffer(b"".join(items), np.uint8), begin


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Concatenate the raw bytes of ids."""
    if not len(ids):
        return b""
    flat, begin = rank_bytes(path)
    size = begin[ids + 1] - begin[ids]
    at = np.arange(int(size.sum())) + np.repeat(begin[ids] - (np.cumsum(size) - size), size)
    return flat[at].tobytes()
