"""Operator 11: language by sparse multinomial logistic regression on character n-grams.

A document's features are the TF-IDF weights of hashed n-grams of its words (runs of letters, small
letters, one mark at either end): an n-gram's share of the document's n-grams times its inverse
document frequency. Weights are trained by follow-the-regularised-leader with an elastic net (the
L1 part keeps most of them at zero), then one temperature is fitted on documents set aside, so that
scores are calibrated probabilities.

Document frequencies count all documents that may be learned from. The weights are fitted on at
most ``sample`` of them, drawn by hash with equal shares per language, and at most ``entries``
feature values, so what reaches the driver is bounded. As a share of n-grams adds up over words,
scoring computes the logits of a word once per task and needs no shuffle.

Null texts and texts without a letter get ``und`` and a score of 0, as does every text when nothing
could be learned; a single learned language gets every other text with a score of 1. Null labels
are not learned from; contradicting ones count each. Null and repeated keys are scored row by row
(null keys are not held out, but not learned from either). An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.textcodes import (
    LETTER, Slice, class_table, frees_memory, prefix_hash, run_starts, segment_hash, slices,
)
from monthloom.shipping import ship_package
from monthloom.staging import stage

BUCKETS = 1 << 16
N_GRAMS = (1, 2, 3, 4)
SAMPLE = 6_000
ENTRIES = 6_000_000
UNKNOWN = "und"
_ROWS = 500
_EDGE = 0x02  # marks both ends of a word; no letter
_WORDS = 20_000


# --- n-grams -------------------------------------------------------------------------------------

def letter_runs(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number (within the slice) of runs of letters."""
    letters = (class_table()[piece.points] == LETTER).astype(np.uint8)
    begin = np.flatnonzero(run_starts(piece, letters))
    end = np.append(begin[1:], piece.size)
    keep = letters[begin] == 1
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(piece.starts, begin, side="right") - 1


def word_grams(points: np.ndarray, begin: np.ndarray, end: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each word, and their buckets, word by word."""
    size = end - begin + 2
    starts = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    framed = np.full(starts[-1], _EDGE, np.uint32)
    inner = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    letter = (inner > 0) & (inner < np.repeat(size - 1, size))
    framed[letter] = points[(np.repeat(begin, size) + inner - 1)[letter]]
    sums = prefix_hash(Slice(0, "", framed, starts))
    stop = np.repeat(starts[1:], size)
    owner = np.repeat(np.arange(len(size)), size)
    owners, hashes = [], []
    for n in N_GRAMS:
        at = np.flatnonzero((np.arange(starts[-1]) + n <= stop) & (letter if n == 1 else True))
        owners.append(owner[at])
        hashes.append(segment_hash(sums, at, at + n) + np.uint64(n * 0x9E37))
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    buckets = (np.concatenate(hashes) >> np.uint64(7)) & np.uint64(BUCKETS - 1)
    return np.bincount(who, minlength=len(size)), buckets.astype(np.int32)[order]


def _repeat_ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def gram_counts(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first text, number of texts, and (text, bucket, occurrences), sorted."""
    for piece in slices([t.lower() for t in texts]):
        n = len(piece.starts) - 1
        begin, end, doc = letter_runs(piece)
        if not len(begin):
            none = np.zeros(0, np.int64)
            yield piece.first, n, none, none, none
            continue
        _, at, back = np.unique(segment_hash(prefix_hash(piece), begin, end), return_index=True,
                                return_inverse=True)
        pair, times = np.unique(doc * len(at) + back, return_counts=True)
        size, buckets = word_grams(piece.points, begin[at], end[at])
        word, first = pair % len(at), np.cumsum(size) - size
        cell = np.repeat(pair // len(at), size[word]) * BUCKETS + buckets[
            _repeat_ranges(first[word], size[word])]
        cells, inverse = np.unique(cell, return_inverse=True)
        count = np.bincount(inverse, np.repeat(times, size[word])).astype(np.int64)
        yield piece.first, n, cells // BUCKETS, cells % BUCKETS, count


# --- the model -----------------------------------------------------------------------------------

@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # buckets x languages, inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _leader(z: np.ndarray, squares: np.ndarray, rate: float, l1: float, l2: float) -> np.ndarray:
    """Weights of least regularised loss so far, coordinate by coordinate."""
    step = (1.0 + np.sqrt(squares)) / rate + l2
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / step)


def train(starts: np.ndarray, buckets: np.ndarray, values: np.ndarray, labels: np.ndarray,
          kinds: int, chosen: np.ndarray | None = None, rounds: int = 4, batch: int = 16,
          rate: float = 5.0, l1: float = 1e-3, l2: float = 1e-5, seed: int = 11
          ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of sparse rows (``starts`` into ``buckets``, ``values``), or of those
    ``chosen`` by number."""
    z, squares = np.zeros((BUCKETS, kinds)), np.zeros((BUCKETS, kinds))
    bias_z, bias_squares = np.zeros(kinds), np.zeros(kinds)
    size = np.diff(starts)
    chosen = np.arange(len(labels)) if chosen is None else chosen
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = chosen[rng.permutation(len(chosen))]
        for at in range(0, len(order), batch):
            rows = order[at: at + batch]
            held = _repeat_ranges(starts[rows], size[rows])
            active, place = np.unique(buckets[held], return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), size[rows])
            x = np.zeros((len(rows), len(active)))
            x[owner, place] = values[held]
            w = _leader(z[active], squares[active], rate, l1, l2)
            b = _leader(bias_z, bias_squares, rate, 0.0, l2)
            error = _softmax(x @ w + b)
            error[np.arange(len(rows)), labels[rows]] -= 1
            for gradient, weight, total, past in (
                    (x.T @ error, w, z, squares), (error.sum(axis=0), b, bias_z, bias_squares)):
                where = active if total is z else slice(None)
                before = past[where]
                after = before + gradient * gradient
                total[where] += gradient - (np.sqrt(after) - np.sqrt(before)) / rate * weight
                past[where] = after
    return _leader(z, squares, rate, l1, l2), _leader(bias_z, bias_squares, rate, 0.0, l2)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale of logits under which the labels are likeliest, by golden sections of its log."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(60):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))


class Scorer:
    """Logits of words by hash, kept from batch to batch; starts anew beyond ``most`` words."""

    def __init__(self, model: Model, most: int = 1_000_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.logits = np.zeros((0, len(self.model.languages)))
        self.sizes = np.zeros(0, np.int64)

    def _learn(self, points, begin, end, hashes) -> None:
        if len(self.keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        parts, sizes = [], []
        for lo in range(0, len(new), _WORDS):
            some = new[lo: lo + _WORDS]
            size, buckets = word_grams(points, begin[some], end[some])
            parts.append(np.add.reduceat(self.model.weight[buckets], np.cumsum(size) - size))
            sizes.append(size)
        if len(new):
            where = at[new]
            self.keys = np.insert(self.keys, where, hashes[new])
            self.logits = np.insert(self.logits, where, np.concatenate(parts), axis=0)
            self.sizes = np.insert(self.sizes, where, np.concatenate(sizes))

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        model = self.model
        names = np.full(len(texts), UNKNOWN, object)
        score = np.zeros(len(texts))
        if not model.languages:
            return names.tolist(), score
        for piece in slices([t.lower() for t in texts]):
            n = len(piece.starts) - 1
            begin, end, doc = letter_runs(piece)
            if not len(begin):
                continue
            distinct, at, back = np.unique(segment_hash(prefix_hash(piece), begin, end),
                                           return_index=True, return_inverse=True)
            self._learn(piece.points, begin[at], end[at], distinct)
            word = np.searchsorted(self.keys, distinct)[back]
            total = np.bincount(doc, self.sizes[word], n)
            sums = np.stack([np.bincount(doc, self.logits[word, c], n)
                             for c in range(len(model.languages))], axis=1)
            p = model.probabilities(sums / np.maximum(total, 1)[:, None] + model.bias)
            best = p.argmax(axis=1)
            found = np.flatnonzero(total > 0)
            names[piece.first + found] = np.array(model.languages, object)[best[found]]
            score[piece.first + found] = np.minimum(1.0, p[found, best[found]])
        return names.tolist(), score


# --- Spark ---------------------------------------------------------------------------------------

def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents of a table ``text`` with letters, and of those holding each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, there = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for _, _, doc, bucket, _ in gram_counts(
                        batch.column(0).slice(at, _ROWS).to_pylist()):
                    held += np.bincount(bucket, minlength=BUCKETS)
                    there += len(np.unique(doc))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(held[some], there))],
            names=["bucket", "n"])

    out, total = np.zeros(BUCKETS, np.int64), 0
    counted = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()  # at most one row per bucket
    for bucket, n in zip(counted["bucket"], counted["n"]):
        if bucket < 0:
            total = int(n)
        else:
            out[bucket] = n
    return total, out


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """``turn, lang, buckets, counts`` of at most ``sample`` distinct (key, text, lang) of a table
    ``key, text, lang``, equally many per language where there are enough."""
    marked = rows.withColumn("h", F.xxhash64("key", "text", F.lit("language")))
    kinds = marked.agg(F.countDistinct("lang")).first()[0]
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))
    drawn = marked.select("key", "h", "lang").distinct().withColumn("turn", turn).filter(
        F.col("turn") <= max(1, sample // max(1, kinds)))
    once = marked.join(F.broadcast(drawn), ["key", "h", "lang"]).dropDuplicates(
        ["key", "h", "lang"])  # the drawn rows are at most ``sample``, without texts
    schema = pa.schema([("turn", pa.int32()), ("lang", pa.string()),
                        ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for first, n, doc, bucket, count in gram_counts(part.column(2).to_pylist()):
                    edge = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(first, n), part.column(1).slice(first, n),
                         pa.ListArray.from_arrays(edge, pa.array(bucket, pa.int32())),
                         pa.ListArray.from_arrays(edge, pa.array(count, pa.int32()))],
                        schema=schema)

    return once.select("turn", "lang", "text").mapInArrow(
        run, "turn int, lang string, buckets array<int>, counts array<int>").filter(
        F.size("buckets") > 0)


@frees_memory
def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, entries: int = ENTRIES,
        key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of the rows for which ``usable`` holds and whose ``lang`` is not null."""
    ship_package(docs.sparkSession)
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    drawn = stage(_sampled(rows, sample), "language-sample")
    # Turns go up together in all languages, until the feature values are enough.
    sizes = drawn.groupBy("turn").agg(F.sum(F.size("buckets")).alias("n")).orderBy("turn").collect()
    held = np.cumsum([r["n"] for r in sizes])
    last = max((r["turn"] for r, h in zip(sizes, held) if h <= entries),
               default=min((r["turn"] for r in sizes), default=0))
    got = drawn.filter(F.col("turn") <= last).toArrow().combine_chunks()
    if not got.num_rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    total, frequency = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    turns, names = np.asarray(got["turn"]), np.array(got["lang"].to_pylist(), str)
    languages = sorted(set(names.tolist()))
    labels = np.searchsorted(languages, names)
    order = np.lexsort((labels, turns))  # whatever the order of the stored rows
    buckets, values, size = _feature_arrays(got, idf)
    del got
    starts = np.concatenate([[0], np.cumsum(size)])
    aside = turns[order] % 5 == 0 if len(languages) > 1 else np.zeros(len(order), bool)
    if aside.all():
        aside[:] = False
    weight, bias = train(starts, buckets, values, labels, len(languages), order[~aside])
    check = order[aside]  # calibration documents
    logits = np.array([values[lo:hi] @ weight[buckets[lo:hi]] + bias
                       for lo, hi in zip(starts[check], starts[check + 1])])
    return Model(languages, weight * idf[:, None], bias, fit_temperature(logits, labels[check]))


def _feature_arrays(rows: pa.Table, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, TF-IDF values and number of entries of each row; few copies, as this is what the
    driver holds of the sample."""
    size = pa.compute.list_value_length(rows["buckets"]).to_numpy().astype(np.int64)
    buckets = np.concatenate([np.asarray(c.flatten()) for c in rows["buckets"].chunks])
    values = np.concatenate([np.asarray(c.flatten()) for c in rows["counts"].chunks]).astype(
        np.float32)
    first = np.cumsum(size) - size
    values /= np.repeat(np.add.reduceat(values, first, dtype=np.float64).astype(np.float32), size)
    values *= idf.astype(np.float32)[buckets]
    return buckets, values, size


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of buckets
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                names, score = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score)],
                    names=[key, "lang_pred", "score"])

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(
        run, f"`{key}` {kind}, lang_pred string, score double")
