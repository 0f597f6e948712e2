"""Boosted regression trees of many training windows, grown side by side.

Features are binned once, by cut points that the earliest window already knows, and rows are put
in the order of their codes and packed into blocks. Rows with equal codes form a cell: every tree
sends them to the same leaf, so scores, nodes and histograms are taken per cell, whatever number
of rows it holds. A tree level is one pass over the blocks: every task draws its rows once for all
fits, adds up their targets per cell and window, and then gradient histograms per (fit, node,
feature, bin); only these sums leave it. All windows and parameter sets grow in the same passes, so
``rounds x depth`` jobs serve any number of fits. Each block carries the scores that its cells have
reached in every fit; they are renewed in memory every ``RENEW`` trees and written anew every
``REFRESH``, which bounds what a pass has to compute again and what a lost executor costs.

Gradients are added as whole numbers of a fixed unit, so a histogram does not depend on how rows
are spread over tasks, and a run can be repeated to the last bit. The error of a validation month
is taken before every tree: one fit gives the error of each smaller number of trees.

Objective: half the squared error with an L2 penalty on leaf values; a split's gain and a leaf's
value are those of Newton boosting. Rows are drawn per tree by a hash of security and month, and
features by a hash of the tree, so both are the same wherever a row lies.
"""
from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import finite_double
from monthloom.operators.ordering import value_ranks
from monthloom.schema import FORMATION, REALIZED, TARGET
from monthloom.shipping import ship_package
from monthloom.staging import discard, stage

# Default tree settings.
DEFAULTS = {"n_estimators": 100, "max_depth": 2, "learning_rate": 0.05, "subsample": 0.8,
            "colsample_bytree": 0.8, "reg_lambda": 1.0, "min_child_weight": 1.0}
BINS = 64
REFRESH = 25
RENEW = 2
_BLOCK = 1 << 19  # rows; fewer if many fits keep scores of their cells
_LEAST = 1 << 14  # rows for which a task of their own pays
_SCORES = 1 << 23
_FAN_IN = 64
_EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class FitSpec:
    """One model: all rows observable at ``month`` train it; ``held`` months are scored with it."""

    month: dt.date
    held: tuple[dt.date, ...]
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass
class Tree:
    """Complete binary tree, level by level; a node that does not split sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray  # codes above it go right
    leaf: np.ndarray
    gain: np.ndarray

    def nodes(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Number of each row's node within a level."""
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        for level in range(levels):
            node = at + (1 << level) - 1
            at = 2 * at + (codes[rows, self.feature[node]] > self.cut[node])
        return at

    def values(self, codes: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(codes, (len(self.feature) + 1).bit_length() - 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of whole numbers over 64."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _hash(*parts: int) -> int:
    out = 0
    for p in parts:
        out = int(_mix(np.array([(out * 0x9E3779B97F4A7C15 + p + 1) & (2**64 - 1)], np.uint64))[0])
    return out


def chosen_features(n: int, share: float, seed: int, tree: int) -> list[int]:
    """The features that a tree may use."""
    most = max(1, int(share * n))
    return sorted(sorted(range(n), key=lambda f: _hash(seed, tree, f, 7))[:most])


def drawn_rows(security: np.ndarray, day: np.ndarray, share: float, seed: int, tree: int
               ) -> np.ndarray:
    """Flags of the rows that a tree is grown on."""
    key = _mix(security.astype(np.int64).view(np.uint64) ^ np.uint64(_hash(seed, tree, 3)))
    key = _mix(key + day.astype(np.uint64))
    return (key >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` rising cut points per feature: the values at which the share of rows up to
    them passes another ``bins``-th. Exact, from counts per value."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v"))
                      for i, f in enumerate(features)])
    long = rows.select(F.explode(cells).alias("c")).select("c.i", "c.v")
    ranks = value_ranks(long, ["i"], "v", "rank", "size", "held")
    upto = F.col("rank") + (F.col("held") - 1) / 2
    passed = F.floor(upto * bins / F.col("size"))
    before = F.floor((upto - F.col("held")) * bins / F.col("size"))
    found = ranks.where(passed > before).select("i", "v").toPandas()  # bins x features at most
    return [np.sort(found.loc[found["i"] == i, "v"].to_numpy()) for i in range(len(features))]


# --- blocks --------------------------------------------------------------------------------------

#: Rows that train, in the order of their cell and first window; where each (cell, window) starts
#: among them; rows that are held out, in the order of their day; codes and scores of the cells.
_PARTS = {"security": np.int64, "day": np.int32, "amount": np.int64,
          "start": np.int64, "cell": np.int32, "window": np.int32,
          "held_security": np.int64, "held_day": np.int32, "held_target": np.float64,
          "held_cell": np.int32, "codes": np.uint8, "score": np.float64}
_BLOCK_SCHEMA = ", ".join(f"{name} binary" for name in _PARTS)


def _pack(arrays: Mapping[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([np.ascontiguousarray(arrays[n], k).tobytes()], pa.binary())
         for n, k in _PARTS.items()], names=list(_PARTS))


def _block(parts: Sequence, width: int, fits: int) -> dict[str, np.ndarray]:
    out = {n: np.frombuffer(p, k) for (n, k), p in zip(_PARTS.items(), parts)}
    out["codes"] = out["codes"].reshape(-1, width)
    out["score"] = out["score"].reshape(fits, -1)
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch], width: int, fits: int
               ) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield _block([c[at].as_buffer() for c in batch.columns], width, fits)


def _coded(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray], windows: np.ndarray,
           held: np.ndarray) -> DataFrame:
    """Codes and first window of every row that trains a fit or is held out by one.

    A row trains the fits of all windows from its first on; ``len(windows)`` stands for none."""
    def days(c: str):
        return F.datediff(F.col(c).cast("date"), F.lit(_EPOCH))

    narrow = rows.select(
        F.col("permno").cast("long").alias("security"), days(FORMATION).alias("day"),
        days(REALIZED).alias("known"), F.col(TARGET).cast("double").alias("target"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            security, day, known, target, *x = [
                c.to_numpy(zero_copy_only=False) for c in batch.columns]
            window = np.searchsorted(windows, np.maximum(day + 1, known))
            window[~np.isfinite(target)] = len(windows)
            codes = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x)])
            keep = np.flatnonzero((window < len(windows)) | np.isin(day, held))
            flat = np.ascontiguousarray(codes[keep], np.uint8)
            ends = np.arange(len(keep) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(security[keep].astype(np.int64)), pa.array(day[keep].astype(np.int32)),
                 pa.array(window[keep].astype(np.int32)), pa.array(target[keep]),
                 pa.BinaryArray.from_buffers(
                     pa.binary(), len(keep), [None, pa.py_buffer(ends), pa.py_buffer(flat)])],
                names=["security", "day", "window", "target", "codes"])

    return narrow.mapInArrow(
        run, "security BIGINT, day INT, window INT, target DOUBLE, codes BINARY")


def _cells(rows: pa.Table, width: int, fits: int, windows: int, held: np.ndarray, unit: float
           ) -> dict[str, np.ndarray]:
    """A block of rows that lie in the order of codes and window."""
    security, day, window, target = [rows.column(n).to_numpy() for n in
                                     ("security", "day", "window", "target")]
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, width)
    opens = np.ones(len(codes), bool)
    opens[1:] = (codes[1:] != codes[:-1]).any(axis=1)
    cell = np.cumsum(opens) - 1
    train = np.flatnonzero(window < windows)
    first = np.ones(len(train), bool)
    first[1:] = (np.diff(cell[train]) != 0) | (np.diff(window[train]) != 0)
    start = np.flatnonzero(first)
    out = np.flatnonzero(np.isin(day, held))
    out = out[np.argsort(day[out], kind="stable")]
    return {"security": security[train], "day": day[train],
            "amount": np.rint(target[train] / unit), "start": start,
            "cell": cell[train[start]], "window": window[train[start]],
            "held_security": security[out], "held_day": day[out], "held_target": target[out],
            "held_cell": cell[out], "codes": codes[opens],
            "score": np.zeros((fits, int(opens.sum())))}


def _packed(coded: DataFrame, width: int, fits: int, windows: int, held: np.ndarray, unit: float,
            n: int) -> DataFrame:
    """Blocks of neighbouring cells. A cell of many rows is split by security and month."""
    most = min(_BLOCK, max(_SCORES // fits, 1))
    cores = coded.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // _BLOCK), min(cores, n // _LEAST))
    placed = coded.repartitionByRange(tasks, "codes", "security", "day").sortWithinPartitions(
        "codes", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                kept.append(batch.slice(at, most))
                size += kept[-1].num_rows
                if size >= most:
                    yield _pack(_cells(pa.Table.from_batches(kept), width, fits, windows, held,
                                       unit))
                    kept, size = [], 0
        if size:
            yield _pack(_cells(pa.Table.from_batches(kept), width, fits, windows, held, unit))

    return placed.mapInArrow(run, _BLOCK_SCHEMA)


def _held_rows(b: Mapping[str, np.ndarray], days: np.ndarray) -> np.ndarray:
    """Places of the rows of some days among the rows held out."""
    lo, hi = [np.searchsorted(b["held_day"], days, side=s) for s in ("left", "right")]
    return np.concatenate([np.zeros(0, np.int64), *map(np.arange, lo, hi)])


def _sums_at(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers per place: doubles hold those of either half of their bits."""
    high, low = np.bincount(at, values >> 26, size), np.bincount(at, values & (1 << 26) - 1, size)
    return (high.astype(np.int64) << 26) + low.astype(np.int64)


def _window_sums(b: Mapping[str, np.ndarray], drawn: np.ndarray | None, windows: Sequence[int]
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and targets of each cell in every one of the rising ``windows``, of the rows drawn."""
    cells = len(b["codes"])
    count, total = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    n = s = np.zeros(0, np.int64)
    if len(b["start"]):
        rows = np.ones(len(b["day"]), np.int64) if drawn is None else drawn.astype(np.int64)
        n = np.add.reduceat(rows, b["start"])
        s = np.add.reduceat(b["amount"] * rows, b["start"])
    upto = 0
    for window in windows:
        for w in range(upto, window + 1):
            here = np.flatnonzero(b["window"] == w)
            count[b["cell"][here]] += n[here]
            total[b["cell"][here]] += s[here]
        upto = max(upto, window + 1)
        yield count, total


# --- growing -------------------------------------------------------------------------------------

@dataclass
class _Fit:
    window: int
    held: np.ndarray
    params: dict[str, Any]
    base: float = 0.0
    rows: int = 0
    trees: list[Tree] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return int(self.params["n_estimators"]) if self.rows else 0

    @property
    def depth(self) -> int:
        return int(self.params["max_depth"])

    def splits(self, hist: np.ndarray, features: list[int], level: int, tree: Tree, unit: float
               ) -> None:
        """Set the level's splits, and on the last level the leaves, from (node, feature, bin)
        sums of gradients and counts."""
        ridge, least = float(self.params["reg_lambda"]), float(self.params["min_child_weight"])
        g, h = hist[..., 0] * unit, hist[..., 1].astype(np.float64)
        left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h

        def weight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.divide(a * a, b + ridge, out=np.zeros_like(a), where=b + ridge > 0)

        gain = weight(left_g, left_h) + weight(right_g, right_h) - weight(all_g, all_h)
        gain[(left_h < max(least, 1)) | (right_h < max(least, 1))] = 0
        nodes, first = len(hist), (1 << level) - 1
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(axis=1)
        at = np.arange(nodes)
        good = flat[at, best] > 1e-12
        where, bins = best // hist.shape[2], hist.shape[2]
        tree.feature[first: first + nodes] = np.where(good, np.array(features)[where], 0)
        tree.cut[first: first + nodes] = np.where(good, best % bins, 1 << 30)
        tree.gain[first: first + nodes] = np.where(good, flat[at, best], 0)
        if level == self.depth - 1:
            cut = best % bins
            for side, (sg, sh) in enumerate(((left_g, left_h), (right_g, right_h))):
                a = np.where(good, sg[at, where, cut], all_g[:, 0, 0] if side == 0 else 0)
                b = np.where(good, sh[at, where, cut], all_h[:, 0, 0] if side == 0 else 0)
                tree.leaf[side::2] = -float(self.params["learning_rate"]) * np.divide(
                    a, b + ridge, out=np.zeros_like(a), where=b + ridge > 0)


class Forests:
    """Models of all specifications, grown together on one table."""

    def __init__(self, rows: DataFrame, specs: Sequence[FitSpec], features: Sequence[str],
                 seed: int = 42, bins: int = BINS) -> None:
        if not specs:
            raise ValueError("At least one fit is needed.")
        if not 2 <= bins <= 255:
            raise ValueError("Codes are single bytes: 2 to 255 bins.")
        self.spark, self.features, self.seed = rows.sparkSession, list(features), seed
        ship_package(self.spark)
        for s in specs:
            if not 0 < float({**DEFAULTS, **s.params}["learning_rate"]) <= 1:
                raise ValueError("Learning rates lie above 0 and at most at 1.")
        first = min(s.month for s in specs)
        windows = np.unique([(s.month - _EPOCH).days for s in specs])
        self.fits = [_Fit(int(np.searchsorted(windows, (s.month - _EPOCH).days)),
                          np.array([(d - _EPOCH).days for d in s.held], np.int64),
                          {**DEFAULTS, **s.params}) for s in specs]
        self.days = np.unique(np.concatenate([f.held for f in self.fits]))
        seen = rows.where((F.col(FORMATION) < F.lit(first)) & (F.col(REALIZED) <= F.lit(first)))
        self.cuts = cut_points(seen, features, bins)
        self.bins = max((len(c) for c in self.cuts), default=0) + 1
        self._set_units(rows)
        self.resident = self.stale = None
        self.written = self.stored = 0  # trees whose values the resident, the staged scores hold
        coded = _coded(rows, features, self.cuts, windows, self.days)
        self._keep(stage(_packed(coded, len(self.features), len(specs), len(windows), self.days,
                                 self.unit, self.n), "tree-blocks"))
        self.parts = self.resident.getNumPartitions()
        self._measure()
        #: per fit, the mean squared error over its held months with 0, 1, ... trees
        self.errors: list[list[float]] = [[] for _ in specs]
        self._grow()

    def _sums(self, work: Callable[[dict], np.ndarray], length: int) -> np.ndarray:
        """Sums of whole numbers over all blocks. Hundreds of such passes follow each other, so
        the blocks stay resident and a pass is a plain job, without a query to plan."""
        width, fits = len(self.features), len(self.fits)

        def run(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = np.zeros(length, np.int64)
            for parts in rows:
                total += work(_block(parts, width, fits))
            yield total

        partial = self.resident.mapPartitions(run)
        if self.parts > _FAN_IN:
            out = partial.treeReduce(np.add, 2)
        else:
            out = np.sum([np.zeros(length, np.int64), *partial.collect()], axis=0)
        if self.stale is not None:
            self.stale.unpersist()
            self.stale = None
        return out

    def _keep(self, blocks: DataFrame) -> None:
        self.blocks, old = blocks, self.resident
        self.resident = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        if old is not None:
            old.unpersist()

    def _set_units(self, rows: DataFrame) -> None:
        """Units in which sums stay whole and exact."""
        top = rows.agg(F.count(F.lit(1)).alias("n"),
                       F.max(F.abs(finite_double(TARGET))).alias("t")).first()
        self.n = top["n"]
        largest = 2.0 ** min(math.frexp(top["t"] or 1.0)[1], 1000)
        room = min(37, 62 - max(self.n, 1).bit_length())
        self.unit = 4 * largest * 2.0 ** -room
        self.square_unit = 16 * largest * largest * 2.0 ** -room

    def _measure(self) -> None:
        """Rows and mean target of each window."""
        fits = self.fits
        order = sorted(range(len(fits)), key=lambda i: fits[i].window)
        windows = [fits[i].window for i in order]

        def totals(b: dict) -> np.ndarray:
            out = np.zeros((len(windows), 2), np.int64)
            for i, (count, total) in zip(order, _window_sums(b, None, windows)):
                out[i] = count.sum(), total.sum()
            return out.ravel()

        for f, (n, s) in zip(fits, self._sums(totals, 2 * len(fits)).reshape(-1, 2)):
            f.rows, f.base = int(n), float(s) * self.unit / max(int(n), 1)

    def _scorer(self, since: int, upto: int | None = None) -> Callable:
        """Scores of a block's cells in one fit, after ``upto`` trees: what the block holds after
        ``since`` trees, and the trees from there on."""
        added = [(f.base if not since else 0.0, f.trees[since: upto]) for f in self.fits]

        def score(b: dict, i: int) -> np.ndarray:
            base, trees = added[i]
            out = b["score"][i] + base
            for t in trees:
                out = out + t.values(b["codes"])
            return out

        return score

    def _refresh(self) -> None:
        """Write the blocks with the scores reached."""
        score, width, fits = self._scorer(self.stored), len(self.features), len(self.fits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _blocks_of(batches, width, fits):
                yield _pack({**b, "score": np.stack([score(b, i) for i in range(fits)])})

        old = self.blocks
        self._keep(stage(old.mapInArrow(run, _BLOCK_SCHEMA), "tree-blocks"))
        discard(old)
        self.written = self.stored = max(len(f.trees) for f in self.fits)

    def _renew(self) -> None:
        """Replace the resident blocks by those with the scores reached, in the next pass."""
        score, width, fits = self._scorer(self.written), len(self.features), len(self.fits)

        def run(parts: tuple) -> tuple:
            b = _block(parts, width, fits)
            new = np.stack([score(b, i) for i in range(fits)])
            return *parts[:-1], new.tobytes()

        self.stale = self.resident
        self.resident = self.stale.map(run).persist(StorageLevel.MEMORY_AND_DISK)
        self.written = max(len(f.trees) for f in self.fits)

    def _grow(self) -> None:
        rounds = max((f.rounds for f in self.fits), default=0)
        for turn in range(rounds):
            if turn - self.stored >= REFRESH:
                self._refresh()
            elif turn - self.written >= RENEW:
                self._renew()
            open_ = [i for i, f in enumerate(self.fits) if turn < f.rounds]
            for i in open_:
                inner = (1 << self.fits[i].depth) - 1
                self.fits[i].trees.append(Tree(
                    np.zeros(inner, np.int64), np.full(inner, 1 << 30), np.zeros(inner + 1),
                    np.zeros(inner)))
            for level in range(max((self.fits[i].depth for i in open_), default=0)):
                self._level([i for i in open_ if level < self.fits[i].depth], turn, level)
        if any(len(f.held) for f in self.fits):
            self._note_errors(self._held_errors())
        self.resident.unpersist()

    def _level(self, open_: list[int], turn: int, level: int) -> None:
        """One pass: histograms of every open node of every open fit."""
        fits, seed, bins, unit = self.fits, self.seed, self.bins, self.unit
        features = {i: chosen_features(len(self.features), fits[i].params["colsample_bytree"],
                                       seed, turn) for i in open_}
        shape = {i: (1 << level, len(features[i]), bins, 2) for i in open_}
        growing = {i: fits[i].trees[turn] for i in open_}
        score = self._scorer(self.written, turn)  # without the tree that grows
        errors = self._error_work(score) if level == 0 else None
        window = {i: fits[i].window for i in open_}
        by_share: dict[float, list[int]] = {}
        for i in sorted(open_, key=window.get):
            by_share.setdefault(float(fits[i].params["subsample"]), []).append(i)

        def histogram(b: dict, i: int, count: np.ndarray, total: np.ndarray) -> np.ndarray:
            held = np.flatnonzero(count)
            codes, n = b["codes"][held], count[held]
            g = np.rint(score(b, i)[held] / unit).astype(np.int64) * n - total[held]
            node, size = growing[i].nodes(codes, level) * bins, (1 << level) * bins
            hist = np.zeros(shape[i], np.int64)
            for j, f in enumerate(features[i]):
                at = node + codes[:, f]
                hist[:, j, :, 0] = _sums_at(at, g, size).reshape(-1, bins)
                hist[:, j, :, 1] = np.bincount(at, n, size).reshape(-1, bins)
            return hist.ravel()

        def work(b: dict) -> np.ndarray:
            out = {}
            for share, some in by_share.items():
                drawn = (drawn_rows(b["security"], b["day"], share, seed, turn) if share < 1
                         else None)
                for i, sums in zip(some, _window_sums(b, drawn, [window[i] for i in some])):
                    out[i] = histogram(b, i, *sums)
            return np.concatenate([*[out[i] for i in open_], *([errors(b)] if errors else [])])

        length = sum(math.prod(s) for s in shape.values())
        got = self._sums(work, length + (2 * len(fits) if errors else 0))
        at = 0
        for i in open_:
            size = math.prod(shape[i])
            fits[i].splits(got[at: at + size].reshape(shape[i]), features[i], level,
                           growing[i], unit)
            at += size
        if errors:
            self._note_errors(got[length:])

    def _error_work(self, score) -> Callable[[dict], np.ndarray]:
        held, unit = [f.held for f in self.fits], self.square_unit

        def work(b: dict) -> np.ndarray:
            out = np.zeros((len(held), 2), np.int64)
            for i, days in enumerate(held):
                rows = _held_rows(b, days)
                rows = rows[np.isfinite(b["held_target"][rows])]
                if len(rows):
                    e = b["held_target"][rows] - score(b, i)[b["held_cell"][rows]]
                    out[i] = len(rows), np.rint(e * e / unit).astype(np.int64).sum()
            return out.ravel()

        return work

    def _held_errors(self) -> np.ndarray:
        return self._sums(self._error_work(self._scorer(self.written)), 2 * len(self.fits))

    def _note_errors(self, sums: np.ndarray) -> None:
        for known, f, (n, s) in zip(self.errors, self.fits, sums.reshape(-1, 2)):
            if len(known) <= f.rounds:
                known.append(float(s) * self.square_unit / n if n else math.nan)

    # --- results ---------------------------------------------------------------------------------
    def predictions(self, column: str) -> DataFrame:
        """``fit, permno, formation_date`` and the score of every row of a fit's held months; fits
        without training rows score nothing."""
        score, width, fits = self._scorer(self.stored), len(self.features), len(self.fits)
        held = [f.held if f.rows else f.held[:0] for f in self.fits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _blocks_of(batches, width, fits):
                for i, days in enumerate(held):
                    rows = _held_rows(b, days)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), i, np.int32)),
                             pa.array(b["held_security"][rows]),
                             pa.array(b["held_day"][rows]).cast(pa.date32()),
                             pa.array(score(b, i)[b["held_cell"][rows]])],
                            names=["fit", "permno", FORMATION, column])

        return self.blocks.mapInArrow(
            run, f"fit INT, permno BIGINT, {FORMATION} DATE, {column} DOUBLE")

    def importances(self) -> list[list[float]]:
        """Mean gain of a feature's splits, as shares; zeros for a fit without splits."""
        out = []
        for f in self.fits:
            total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
            for t in f.trees:
                used = t.gain > 0
                np.add.at(total, t.feature[used], t.gain[used])
                np.add.at(count, t.feature[used], 1)
            mean = total / np.maximum(count, 1)
            out.append((mean / mean.sum() if mean.sum() > 0 else mean).tolist())
        return out
