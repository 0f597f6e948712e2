"""Operator 8: toxicity by subword-bag embeddings under a linear softmax.

Every word is a bag of hashed character n-grams plus itself; its vector is the mean of their
embeddings, the vector of a window of ``WINDOW`` words is the average of its word vectors (a word
that repeats within the window counts as zero after its first time, so a stuck record of one
harmless word does not add up), and a linear softmax scores the window. A document is as toxic as its worst window, so one insult in a
very long text counts as in a short one. Embeddings and softmax are trained jointly in numpy.
Words that training never saw still share n-gram vectors with those it saw.

The model is trained on at most ``sample`` labelled documents (the smallest hashes of their keys, up
to half of them of each label, more where the other label has fewer), so what reaches the driver is
bounded and rare toxic documents are not thinned out; the loss weighs both labels alike. All texts are scored in place, without a shuffle, and each
word's logit is computed once per worker. Texts without words get the score of the bias alone.
Labels that are null or contradict each other are left out. Null and repeated keys are scored row
by row; an empty table gives no rows, and without labels of both kinds the score is the share of
label 1 (0 without any label).
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from monthloom.llm.textcodes import (
    SLICE_CHARS, Slice, frees_memory, give_back, hold_only, mix, prefix_hash, segment_hash, slices,
    words,
)
from monthloom.shipping import ship_package

BUCKETS = 1 << 19
DIM = 8
WINDOW = 4
N_GRAMS = (3, 4, 5)
SAMPLE = 8_000
_ROWS = 500
_WORDS = 50_000  # whose gradients are added up apart in training
_FEW = 5_000  # words handled at once in training; divides _WORDS
_SOME = 1 << 16  # windows or buckets handled at once; divides BUCKETS


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int,
                    key: str = "doc_id", text: str = "text", by_label: bool = False) -> DataFrame:
    """At most ``sample`` rows ``key, text, label`` with one clear label, by hash of the key.

    With ``by_label`` each label gets half of them, and what the other label leaves over."""
    clear = (
        labels.select(F.col(key), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col(key).isNotNull() & usable)
        .groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .filter("label = high").select(key, "label")
    )
    # A constant in the order keeps the choice independent of other hashes of the key.
    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(n)

    if by_label:
        n = {r["label"]: r["count"] for r in clear.groupBy("label").count().collect()}
        toxic = min(n.get(1, 0), max(sample // 2, sample - n.get(0, 0)))
        chosen = first(clear.filter("label = 1"), toxic).unionByName(
            first(clear.filter("label = 0"), sample - toxic))
    else:
        chosen = first(clear, sample)
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), key)  # at most ``sample`` rows of two numbers


@dataclass
class Model:
    gram: np.ndarray  # logit difference of every bucket
    bias: float

    def word_logits(self, strings: list[str]) -> np.ndarray:
        count, ids = subwords(strings)
        if not len(ids):
            return np.zeros(len(strings))
        begin = np.cumsum(count) - count
        return np.add.reduceat(self.gram[ids], begin) / count


def subwords(strings: list[str], block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Number of buckets of each word, and the buckets: n-grams of ``<word>`` and the word itself.

    Words go block by block, so that intermediate arrays stay small."""
    counts, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(strings), block):
        count, ids = _subwords(strings[at: at + block])
        counts.append(count)
        buckets.append(ids)
    return np.concatenate(counts), np.concatenate(buckets)


def _subwords(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    piece = next(slices([f"<{s}>" for s in strings], limit=1 << 62))
    sums = prefix_hash(piece)
    length = np.diff(piece.starts)
    stop = np.repeat(piece.starts[1:], length)
    owner = np.repeat(np.arange(len(strings)), length)
    at = np.arange(piece.size)
    owners, hashes = [np.arange(len(strings))], [
        segment_hash(sums, piece.starts[:-1], piece.starts[1:])]
    for n in N_GRAMS:
        b = at[at + n <= stop]
        owners.append(owner[b])
        hashes.append(segment_hash(sums, b, b + n) + np.uint64(n))
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    ids = (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return np.bincount(who, minlength=len(strings)), ids[order]


def _lowered(texts: Iterable[str]) -> Iterator[tuple[int, Slice]]:
    """Slices of the texts in small letters and the number of their first text; no more than one
    slice's texts are held."""
    at, held, total = 0, [], 0
    for t in texts:
        t = t.lower()
        if held and total + len(t) > SLICE_CHARS:
            yield at, next(slices(held))
            at, held, total = at + len(held), [], 0
        held.append(t)
        total += len(t)
    if held:
        yield at, next(slices(held))


def _windows(texts: Iterable[str]) -> Iterator[tuple]:
    """Per slice: first text, number of texts, joined text, bounds and hashes of the words that
    are new to their window, window number of each, and text number and word count of each
    window."""
    for at, piece in _lowered(texts):
        begin, end, doc = words(piece)
        n = len(piece.starts) - 1
        if not len(begin):
            yield (at, n, piece.text, begin, end, np.zeros(0, np.uint64), begin, begin,
                   begin)
            continue
        first = np.searchsorted(doc, np.arange(n))
        inside = np.arange(len(doc)) - first[doc]
        opens = inside % WINDOW == 0
        window = np.cumsum(opens) - 1
        hashes = segment_hash(prefix_hash(piece), begin, end)
        _, new = np.unique(mix(hashes + window.astype(np.uint64)), return_index=True)
        new.sort()
        yield (at, n, piece.text, begin[new], end[new], hashes[new], window[new],
               doc[opens], np.bincount(window))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts end to end; the list is emptied on the way, so that nothing is held twice."""
    out = np.empty(sum(map(len, parts)), parts[0].dtype if parts else np.int32)
    at = len(out)
    while parts:
        part = parts.pop()
        out[at - len(part): at] = part
        at -= len(part)
    part = None
    give_back()
    return out


def _opens(of: np.ndarray) -> np.ndarray:
    """Where a new number begins."""
    new = np.ones(len(of), bool)
    np.not_equal(of[1:], of[:-1], out=new[1:])
    return np.flatnonzero(new).astype(np.int32)


def train(texts: Iterable[str], labels: np.ndarray, rounds: int = 100, warm: int = 4,
          rate: float = 4000.0, least_texts: int | None = None, seed: int = 7) -> Model:
    """Fit embeddings and softmax together; the gradient of a document goes to its worst window
    after a few rounds in which it spreads over all of them. Subwords of fewer than ``least_texts``
    texts stay untrained; without it the number follows that of the rarer label's texts. Texts are
    taken one by one and not kept."""
    labels = np.asarray(labels, np.float64)
    if least_texts is None:
        rarer = min(labels.sum(), len(labels) - labels.sum())
        least_texts = int(np.clip(np.ceil(rarer / 36), 2, 8))
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        bias = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(BUCKETS), bias)
    # Words get numbers as they are met; their strings are not kept, only their subwords.
    keys, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    occurrence, window, owner, width, held = [], [], [], [], [np.zeros(0, np.int32)]
    base = n_words = 0
    for first, _, text, begin, end, hashes, win, doc, size in _windows(texts):
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(keys, distinct)
        new = np.append(keys, 0)[place] != distinct if len(keys) else np.ones(len(distinct), bool)
        new |= place == len(keys)
        if new.any():
            some, ids = subwords([text[b:e] for b, e in zip(begin[at[new]].tolist(),
                                                            end[at[new]].tolist())])
            counts.append(some)
            buckets.append(ids)
            numbers = np.insert(numbers, place[new], n_words + np.arange(len(some)))
            keys = np.insert(keys, place[new], distinct[new])
            n_words += len(some)
        ids = numbers[np.searchsorted(keys, distinct)]
        if len(win):
            pairs = np.unique(doc[win] * len(distinct) + back)
            held.append(ids[pairs % len(distinct)].astype(np.int32))
        occurrence.append(ids[back].astype(np.int32))
        window.append((win + base).astype(np.int32))
        owner.append((doc + first).astype(np.int32))
        width.append(size.astype(np.int32))
        base += len(doc)
    word_texts = np.zeros(n_words, np.int64)
    while held:
        np.add.at(word_texts, held.pop(), 1)
    words_, window_, owner_ = _joined(occurrence), _joined(window), _joined(owner)
    if not len(words_):
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    del keys, numbers
    count, grams = _joined(counts), _joined(buckets)
    gram_at = np.cumsum(count) - count
    # Subwords of few texts would let a text be learned by heart; they stay at zero.
    spread_of = np.zeros(BUCKETS)
    for lo in range(0, n_words, _FEW):
        hi = min(lo + _FEW, n_words)
        stop = gram_at[hi] if hi < n_words else len(grams)
        spread_of += np.bincount(grams[gram_at[lo]: stop],
                                 np.repeat(word_texts[lo:hi], count[lo:hi]), BUCKETS)
    common = spread_of >= least_texts
    win_at = _opens(window_)
    win_held = np.diff(win_at, append=np.int32(len(words_)))
    win_size = _joined(width)
    doc_at = _opens(owner_)
    docs = owner_[doc_at]
    doc_size = np.diff(doc_at, append=len(owner_))
    y = labels[docs]
    del window_, owner_, word_texts, spread_of
    give_back()  # what reading the texts has left between the arrays that stay

    rng = np.random.default_rng(seed)
    table = np.empty((BUCKETS, DIM), np.float32)
    for lo in range(0, BUCKETS, _SOME):
        table[lo: lo + _SOME] = rng.normal(0, 0.1, (_SOME, DIM))
    table[~common] = 0
    out = rng.normal(0, 0.3, DIM).astype(np.float32)  # difference of the two classes' softmax weights
    bias = float(np.log(share / (1 - share)))
    speed = np.zeros_like(table)
    of_win = np.repeat(np.arange(len(docs), dtype=np.int32), doc_size)
    word_logit, win_logit = np.empty(n_words), np.empty(len(win_at))
    for step in range(rounds):
        gram_logit = table @ out
        for lo in range(0, n_words, _FEW):
            hi = min(lo + _FEW, n_words)
            held = grams[gram_at[lo]: gram_at[hi] if hi < n_words else len(grams)]
            word_logit[lo:hi] = np.add.reduceat(
                gram_logit[held], gram_at[lo:hi] - gram_at[lo]) / count[lo:hi]
        for lo in range(0, len(win_at), _SOME):
            hi = min(lo + _SOME, len(win_at))
            stop = win_at[hi] if hi < len(win_at) else len(words_)
            win_logit[lo:hi] = np.add.reduceat(word_logit[words_[win_at[lo]: stop]],
                                               win_at[lo:hi] - win_at[lo])
        win_logit /= win_size
        if step < warm:
            doc_logit = np.add.reduceat(win_logit, doc_at) / doc_size
        else:
            doc_logit = np.maximum.reduceat(win_logit, doc_at)
        p = 1 / (1 + np.exp(-np.clip(doc_logit + bias, -30, 30)))
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        error = (p - y) * weight / len(docs)
        if step < warm:
            g_word = np.zeros(n_words)
            for lo in range(0, len(win_at), _SOME):
                hi = min(lo + _SOME, len(win_at))
                of = of_win[lo:hi]
                g_win = error[of] / doc_size[of] / win_size[lo:hi]
                stop = win_at[hi] if hi < len(win_at) else len(words_)
                g_word += np.bincount(words_[win_at[lo]: stop],
                                      np.repeat(g_win, win_held[lo:hi]), n_words)
        else:
            hit = np.concatenate([
                lo + np.flatnonzero(win_logit[lo: lo + _SOME] == doc_logit[of_win[lo: lo + _SOME]])
                for lo in range(0, len(win_at), _SOME)])
            _, one = np.unique(of_win[hit], return_index=True)
            chosen = hit[one]
            g_win = error / win_size[chosen]
            size = win_held[chosen]
            at = np.repeat(win_at[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            g_word = np.bincount(words_[at], np.repeat(g_win, size), n_words)
        hot = np.flatnonzero(g_word)
        g_gram = np.zeros(BUCKETS)
        for lo in range(0, len(hot), _WORDS):
            part = np.zeros(BUCKETS)
            for begin in range(lo, min(lo + _WORDS, len(hot)), _FEW):
                some = hot[begin: min(begin + _FEW, lo + _WORDS)]
                size = count[some]
                at = np.repeat(gram_at[some] - (np.cumsum(size) - size), size)
                at += np.arange(len(at))
                np.add.at(part, grams[at], np.repeat(g_word[some] / size, size))
            g_gram += part
        touched = np.flatnonzero((g_gram != 0) & common)
        g_out = g_gram[touched] @ table[touched]
        speed *= 0.9
        for lo in range(0, len(touched), _SOME):
            some = touched[lo: lo + _SOME]
            speed[some] += np.outer(g_gram[some], out)
        for lo in range(0, BUCKETS, _SOME):
            table[lo: lo + _SOME] -= np.float32(rate) * speed[lo: lo + _SOME]
        out -= np.float32(0.1) * np.clip(g_out, -1, 1).astype(np.float32)
        bias -= float(error.sum())
        give_back()
    return Model(table @ out, bias)


class _Scorer:
    """Word logits by hash, kept from batch to batch; starts anew beyond ``most`` words."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def _logits(self, text, begin, end, hashes):
        hold_only(self)
        if len(self.keys) > self.most:
            self.clear()
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.keys, assume_unique=True)
        if new.any():
            where = first[new]
            got = self.model.word_logits([text[b:e] for b, e in zip(begin[where].tolist(),
                                                                     end[where].tolist())])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.values = np.concatenate([self.values, got])[order]
        return self.values[np.searchsorted(self.keys, distinct)][back]

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.zeros(len(texts))
        for first, n, text, begin, end, hashes, win, doc, size in _windows(texts):
            if not len(begin):
                continue
            logit = self._logits(text, begin, end, hashes)
            mean = np.bincount(win, logit, len(size)) / size
            worst = np.full(n, -np.inf)
            np.maximum.at(worst, doc, mean)
            z[first: first + n] = np.where(np.isfinite(worst), worst, 0.0)
        return 1 / (1 + np.exp(-np.clip(z + self.model.bias, -30, 30)))


def mapped(source: DataFrame, names: list[str], added: dict[str, DataType], make) -> DataFrame:
    """Keep the columns ``names`` of ``source`` and replace the one after them, texts, by the
    Arrow arrays that ``make`` computes from a list of texts."""
    kept = [source.schema[n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                new = make(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*names, *added])

    return source.mapInArrow(run, StructType(
        [StructField(f.name, f.dataType, True) for f in kept]
        + [StructField(n, t, True) for n, t in added.items()]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's key, the columns in ``keep`` and its ``score``."""
    ship_package(docs.sparkSession)
    names = list(dict.fromkeys([key, *keep]))
    scorer = _Scorer(model)  # each worker unpickles its own and keeps it for its task

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array(scorer.scores(texts))]

    return mapped(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__text")), names,
                  {"score": DoubleType()}, make)


@frees_memory
def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic",
        sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    ship_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, usable, sample, key, text, by_label=True).select(
        key, "text", "label").toArrow()
    order = rows.column(key).to_pandas().argsort(kind="stable").to_numpy()
    marks = rows.column("label").to_numpy()[order].astype(np.float64)
    texts = rows.column("text")
    del rows
    return train((texts[i].as_py() for i in order.tolist()), marks)
