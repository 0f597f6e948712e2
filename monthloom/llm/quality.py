"""Operator 1: quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of character and word kinds, repetition, lines, and the worst
stretch of ``STRETCH`` words) come from a few numpy passes per batch. Trees are grown on binned
statistics by gradient and hessian histograms, and flattened into arrays: scoring moves all rows
of a batch down all levels of a tree at once.

The trees are fitted on the statistics of at most ``sample`` labelled documents, so what reaches
the driver is bounded; all texts are scored in place, without a shuffle. Null and empty texts have
zero statistics and are scored like any other. Null, contradicting and repeated labels are left
out or counted once; keys may be null or repeated, rows are scored one by one. An empty table gives
no rows; without labels of both kinds every score is the share of label 1 (0 without any label).
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from monthloom.llm.textcodes import (
    LETTER, NUMBER, OTHER, SPACE, class_table, frees_memory, mix, prefix_hash, segment_hash, slices,
    words,
)
from monthloom.llm.toxicity import labelled_sample, mapped
from monthloom.shipping import ship_package

SAMPLE = 20_000
STRETCH = 32
BINS = 64

NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "other", "space", "newline",
    "pipe", "bang", "top_sign", "word_upper", "word_no_letter", "word_sign_end", "word_inner_sign",
    "distinct_words", "same_as_before", "words_per_line", "line_repeats", "short_lines",
    "line_no_stop", "long_words", "max_other", "max_upper", "max_same", "min_distinct", "max_digit",
    "max_sign_end", "max_no_stop", "share_bad", "stops", "max_length", "min_length",
)


@lru_cache(maxsize=1)
def _upper_table() -> np.ndarray:
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{Lu}+", points):
        table[[ord(c) for c in m[0]]] = True
    return table


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    out = np.zeros((len(texts), len(NAMES)))
    for piece in slices(texts):
        n = len(piece.starts) - 1
        if piece.size:
            out[piece.first: piece.first + n] = _slice_statistics(piece, n)
    return out


def _slice_statistics(piece, n: int) -> np.ndarray:
    points, lo, hi = piece.points, piece.starts[:-1], piece.starts[1:]
    kind = class_table()[points]
    size = hi - lo
    sums = {
        "upper": _sums(_upper_table()[points]), "digit": _sums(kind == NUMBER),
        "other": _sums(kind == OTHER), "space": _sums(kind == SPACE),
        "newline": _sums(points == 0x0A), "pipe": _sums(points == 0x7C),
        "bang": _sums(points == 0x21), "letter": _sums(kind == LETTER),
        "stop": _sums(np.isin(points, [0x2E, 0x2C, 0x3B, 0x3A])),
    }
    f = {k: _share(s[hi] - s[lo], size) for k, s in sums.items()}
    f["stops"] = f.pop("stop")
    f["log_chars"] = np.log1p(size)
    signs = np.flatnonzero((kind == OTHER) & (points < 128) & ~np.isin(points, [0x2E, 0x2C]))
    if len(signs):
        doc = np.searchsorted(piece.starts, signs, side="right") - 1
        per = np.bincount(doc * 128 + points[signs], minlength=n * 128).reshape(n, 128)
        f["top_sign"] = per.max(axis=1) / np.maximum(size, 1)

    b, e, doc = words(piece)
    if not len(b):
        return np.column_stack([f.get(name, np.zeros(n)) for name in NAMES])
    count = np.bincount(doc, minlength=n)
    first = np.searchsorted(doc, np.arange(n))
    length = e - b
    has = {k: s[e] - s[b] for k, s in sums.items()}
    last = points[e - 1]
    sign_end = (kind[e - 1] == OTHER) & ~np.isin(last, [0x2E, 0x2C])
    no_letter = has["letter"] == 0
    all_upper = (has["upper"] == has["letter"]) & (has["letter"] >= 2)
    inner = has["other"] - (kind[e - 1] == OTHER) - (kind[b] == OTHER) > 0
    hashes = segment_hash(prefix_hash(piece), b, e)
    inside = np.arange(len(b)) - first[doc]
    same = np.zeros(len(b), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (inside[1:] > 0)
    _, at = np.unique(mix(hashes + doc.astype(np.uint64)), return_index=True)
    new = np.zeros(len(b), bool)
    new[at] = True

    def mean(values):
        return np.bincount(doc, values, n) / np.maximum(count, 1)

    f["log_words"] = np.log1p(count)
    f["word_length"] = mean(length)
    f["word_upper"], f["word_no_letter"] = mean(all_upper), mean(no_letter)
    f["word_sign_end"], f["word_inner_sign"] = mean(sign_end), mean(inner)
    f["distinct_words"], f["same_as_before"] = mean(new), mean(same)
    f["long_words"] = mean(length > 20)
    f["max_length"] = np.zeros(n)
    np.maximum.at(f["max_length"], doc, length)

    # Lines.
    breaks = np.flatnonzero(points == 0x0A)
    line_b = np.union1d(lo[size > 0], breaks + 1)
    line_b = line_b[line_b < piece.size]
    line_e = np.append(line_b[1:], piece.size)
    line_e = line_e - (points[line_e - 1] == 0x0A)
    full = line_e > line_b
    line_b, line_e = line_b[full], line_e[full]
    if len(line_b):
        line_doc = np.searchsorted(piece.starts, line_b, side="right") - 1
        lines = np.bincount(line_doc, minlength=n)
        in_line = np.searchsorted(b, line_e) - np.searchsorted(b, line_b)
        line_hash = segment_hash(prefix_hash(piece), line_b, line_e)
        _, at = np.unique(mix(line_hash + line_doc.astype(np.uint64)), return_index=True)
        fresh = np.bincount(line_doc[at], minlength=n)
        f["words_per_line"] = _share(np.bincount(line_doc, in_line, n), lines)
        f["line_repeats"] = 1 - _share(fresh, lines)
        f["line_repeats"][lines == 0] = 0
        f["short_lines"] = _share(np.bincount(line_doc, in_line < 5, n), lines)
        f["line_no_stop"] = _share(np.bincount(line_doc, points[line_e - 1] != 0x2E, n), lines)

    # The worst stretch of words.
    opens = np.flatnonzero(inside % STRETCH == 0)
    part = np.cumsum(inside % STRETCH == 0) - 1
    part_doc = doc[opens]
    part_n = np.bincount(part)
    weight = part_n / np.minimum(STRETCH, count[part_doc])  # short tails count for less
    _, at = np.unique(mix(hashes + part.astype(np.uint64)), return_index=True)
    fresh = np.bincount(part[at], minlength=len(opens))
    chars = np.bincount(part, length)

    def stretch(values, per=None):
        return np.bincount(part, values, len(opens)) / np.maximum(part_n if per is None else per, 1)

    def worst(values):
        got = np.zeros(n)
        np.maximum.at(got, part_doc, values * weight)
        return got

    other, upper = stretch(has["other"], chars), stretch(all_upper)
    repeat = stretch(same)
    f["max_other"], f["max_upper"], f["max_same"] = worst(other), worst(upper), worst(repeat)
    f["max_digit"] = worst(stretch(has["digit"], chars))
    f["max_sign_end"] = worst(stretch(sign_end | no_letter))
    f["max_no_stop"] = worst(1.0 - np.minimum(1, stretch(has["stop"]) * 8))
    f["min_distinct"] = 1 - worst(1 - fresh / part_n)
    f["min_length"] = -worst(-np.minimum(0, 3 - chars / part_n))
    bad = (other > 0.15) | (upper > 0.5) | (repeat > 0.4)
    f["share_bad"] = _share(np.bincount(part_doc, bad * part_n, n), count)
    return np.column_stack([f.get(name, np.zeros(n)) for name in NAMES])


# --- trees -------------------------------------------------------------------------------------

@dataclass
class Forest:
    """All trees as complete binary trees of one depth, level by level in flat arrays."""

    edges: np.ndarray  # features x (BINS - 1)
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right where the bin exceeds it
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(self.edges[j], x[:, j], side="left")
                                for j in range(x.shape[1])]).astype(np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        binned = self.bins(x)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1,
         ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Boost complete trees on the logistic loss from histograms of binned columns."""
    y = np.asarray(y, np.float64)
    share = float(y.mean()) if len(y) else 0.0
    base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    columns = x.shape[1]
    edges = np.full((columns, BINS - 1), np.inf)
    for j in range(columns):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else []
        edges[j, : len(cuts)] = cuts
    inner = (1 << depth) - 1
    forest = Forest(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64),
                    np.zeros((0, inner + 1)), base)
    if share in (0.0, 1.0):
        return forest
    binned = forest.bins(x)
    offset = np.arange(columns) * BINS
    z = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature = np.zeros(inner, np.int64)
        cut = np.full(inner, BINS, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, wide = (1 << level) - 1, 1 << level
            slot = ((node - low) * (columns * BINS))[:, None] + offset + binned
            size = wide * columns * BINS
            flat = slot.ravel()
            hist_g = np.bincount(flat, np.repeat(g, columns), size).reshape(wide, columns, BINS)
            hist_h = np.bincount(flat, np.repeat(h, columns), size).reshape(wide, columns, BINS)
            left_g, left_h = hist_g.cumsum(axis=2), hist_h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = (left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge)
                    - all_g ** 2 / (all_h + ridge))
            gain[(left_h < least) | (right_h < least)] = -1
            best = gain.reshape(wide, -1).argmax(axis=1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            feature[low: low + wide] = np.where(good, best // BINS, 0)
            cut[low: low + wide] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        value = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        z += value[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Forest(edges, np.array(features), np.array(cuts), np.array(leaves), base)


# --- Spark -------------------------------------------------------------------------------------

@frees_memory
def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
        sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Forest:
    ship_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, usable, sample, key, text)

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array(list(statistics(texts)), pa.list_(pa.float64()))]

    got: pd.DataFrame = mapped(rows.select(key, "label", "text"), [key, "label"],
                               {"x": ArrayType(DoubleType())}, make).toPandas()
    got = got.sort_values(key, kind="stable")
    x = np.vstack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    return grow(x, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's key, the columns in ``keep`` and its ``score``."""
    ship_package(docs.sparkSession)
    names = list(dict.fromkeys([key, *keep]))

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array(forest.scores(statistics(texts)))]

    return mapped(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__text")), names,
                  {"score": DoubleType()}, make)
