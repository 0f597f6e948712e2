"""Operator 12: ranked lexical search by dense blocked matrix products.

Documents are reduced to the terms that the items hold; their impacts (whole numbers) fill dense
tiles of terms x documents, items give compact tiles of items x terms, and BLAS multiplies them in
float64. Tiles of terms are cut so that no item's partial sum can reach 2**53, so every product is
exact; tiles add up in 64-bit integers. Each task keeps its best ``top`` documents per item, ties
by the smaller key, and those few rows meet in two steps.

Items are taken in blocks of bounded text, one after the other; each block reads the documents
once to reduce them, and then only what it reduced. A usual query set is one block. Nothing of the
corpus reaches the driver but the number of documents and terms and the items' document counts.

Null and empty texts hold no term: such documents count nowhere and items without terms find
nothing. Rows that repeat an item's key and text are one item; rows with one key and different
texts are searched each by itself. Documents with null or repeated keys are documents like any
others; a null key comes after all others among equal scores. Empty tables give no rows; extra
columns are ignored. Very long texts are split into terms piece by piece.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.shipping import ship_package
from monthloom.staging import stage

TOP = 20
EXACT = 1 << 53
TILE_TERMS, TILE_DOCS = 1024, 256
BLOCK_ITEMS, BLOCK_CHARS = 1024, 1 << 21
_PIECE = 1 << 20
_SPREAD = 64

# Fixed values of the ranking formula.
_UNIT, _TF, _NORM = 1_000_000_000, 1000, 12
_LEAST_LENGTH, _LENGTH_SHARE = 75, 25
MOST_IMPACT = _UNIT // _TF

#: Separators become spaces, A-Z small letters; every other byte of UTF-8 belongs to a term.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8, piece by piece."""
    folded = text.translate(_FOLD)
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        stop = len(folded)
        if at + _PIECE < stop:
            stop = folded.rfind(b" ", at, at + _PIECE) + 1
            if not stop:  # one term fills the piece
                stop = folded.find(b" ", at + _PIECE) + 1 or len(folded)
        counts.update(folded[at:stop].split())
        at = stop
    return counts


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class ItemTiles:
    """Items x terms as triples, cut into tiles whose sums stay exact."""

    items: int
    terms: int
    tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # terms; item, place, weight

    @classmethod
    def cut(cls, items: int, item: np.ndarray, term: np.ndarray, weight: Sequence[int],
            exact: int = EXACT, width: int = TILE_TERMS) -> ItemTiles:
        """Terms in order, a new tile where the next one would exceed ``width`` terms or bring an
        item's weights to ``exact / MOST_IMPACT``; a heavier weight is spread over several tiles."""
        terms = int(term.max()) + 1 if len(term) else 0
        most = (exact - 1) // MOST_IMPACT
        by_term: dict[int, list[tuple[int, int]]] = {}
        for i, t, w in zip(item.tolist(), term.tolist(), weight):
            if w:
                by_term.setdefault(t, []).append((i, int(w)))
        tiles: list = []
        used = np.zeros(items, np.int64)
        held: list[int] = []
        rows: list[tuple[int, int, int]] = []

        def close() -> None:
            if held:
                a = np.array(rows, np.int64).reshape(-1, 3)
                tiles.append((np.array(held, np.int64), a[:, 0], a[:, 1],
                              a[:, 2].astype(np.float64)))
            used[:] = 0
            held.clear()
            rows.clear()

        for t in sorted(by_term):
            left = by_term[t]
            while left:
                part = [(i, min(w, most)) for i, w in left]
                if len(held) == width or any(used[i] + w > most for i, w in part):
                    close()
                for i, w in part:
                    used[i] += w
                    rows.append((i, len(held), w))
                held.append(t)
                left = [(i, w - most) for i, w in left if w > most]
        close()
        return cls(items, terms, tiles)

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int
               ) -> np.ndarray:
        """items x docs, from the documents' (doc, term, impact) triples."""
        out = np.zeros((self.items, docs), np.int64)
        order = np.argsort(term, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        first = np.searchsorted(term, np.arange(self.terms + 1))
        for terms, item, place, weight in self.tiles:
            size = first[terms + 1] - first[terms]
            if not size.any():
                continue
            at = np.repeat(first[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            right = np.zeros((len(terms), docs))
            right[np.repeat(np.arange(len(terms)), size), doc[at]] = impact[at]
            left = np.zeros((self.items, len(terms)))
            left[item, place] = weight
            out += (left @ right).astype(np.int64)
        return out


class Best:
    """The best ``top`` (score, key) per item so far; of equal scores the smaller key, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * items
        self.key = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def add(self, scores: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        least = np.array([s[-1] if len(s) == self.top else 1 for s in self.score], np.int64)
        hit = scores >= np.maximum(least, 1)[:, None]
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            at = np.flatnonzero(hit[i])
            if len(at) > self.top:  # all that tie with the last place stay in
                edge = np.partition(scores[i, at], len(at) - self.top)[len(at) - self.top]
                at = at[scores[i, at] >= edge]
            s = np.concatenate([self.score[i], scores[i, at]])
            k = np.concatenate([self.key[i], key[at]])
            n = np.concatenate([self.null[i], null[at]])
            order = np.lexsort((k, n, -s))[: self.top]
            self.score[i], self.key[i], self.null[i] = s[order], k[order], n[order]

    def table(self) -> pa.RecordBatch:
        size = [len(s) for s in self.score]
        part = TaskContext.get().partitionId() % _SPREAD
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(size)), size), pa.int32()),
             pa.array(np.full(sum(size), part), pa.int32()),
             pa.array(np.concatenate([*self.key, np.zeros(0, np.int64)]),
                      mask=np.concatenate([*self.null, np.zeros(0, bool)])),
             pa.array(np.concatenate([*self.score, np.zeros(0, np.int64)]))],
            names=["item", "part", "doc_id", "score"])


def _reduced(source: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with at least one term, for the terms of the
    vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()),
                        ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                totals, sizes, terms, counts, there = [], [0], [], [], []
                for text in part.column(1):
                    found = term_counts(text.as_buffer().to_pybytes())
                    there.append(bool(found))
                    totals.append(found.total())
                    held = [t for t in found if t in vocabulary]
                    terms += [vocabulary[t] for t in held]
                    counts += [found[t] for t in held]
                    sizes.append(len(terms))
                edge = pa.array(sizes, pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(totals, pa.int64()),
                     pa.ListArray.from_arrays(edge, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(edge, pa.array(counts, pa.int64()))], schema=schema)
                yield out.filter(pa.array(there, pa.bool_()))

    return source.mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<long>")


def _best_of_tasks(reduced: DataFrame, tiles: ItemTiles, documents: int, terms: int, top: int
                   ) -> DataFrame:
    """Each task's best rows ``item, part, doc_id, score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(tiles.items, top)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                n = np.asarray(part.column(1))
                length = _LEAST_LENGTH + (_LENGTH_SHARE * n * documents) // terms
                size = np.diff(np.asarray(part.column(2).offsets))
                doc = np.repeat(np.arange(part.num_rows), size)
                tf = np.asarray(part.column(3).flatten(), np.int64)
                impact = (_UNIT * tf) // (_TF * tf + _NORM * length[doc])
                scores = tiles.scores(doc, np.asarray(part.column(2).flatten(), np.int64), impact,
                                      part.num_rows)
                best.add(scores, np.asarray(part.column(0).fill_null(0), np.int64),
                         np.asarray(part.column(0).is_null()))
        yield best.table()

    return reduced.select("doc_id", "n", "terms", "counts").mapInArrow(
        run, "item int, part int, doc_id long, score long")


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list]:
    """Rows ``key, text`` in blocks of bounded number and text; only one is held at a time."""
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull()).distinct()
    block, chars = [], 0
    for row in rows.toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or chars + len(row["text"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append(row)
        chars += len(row["text"])
    if block:
        yield block


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Two steps, so that no item's rows of all tasks meet in one.
    some = rows.withColumn(
        "at", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(
        F.col("at") <= top)
    return some.withColumn(
        "rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(
        F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id",
           text: str = "text", item_key: str = "item_id", item_text: str = "text",
           exact: int = EXACT) -> DataFrame:
    """``item_key, rank, doc_id, score``: each item's best documents with a score above zero."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    item_type = items.schema[item_key].dataType.simpleString()
    out = None
    for block in _item_blocks(items, item_key, item_text):
        bags = [term_counts(row["text"].encode("utf-8", "surrogatepass")) for row in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
        reduced = stage(_reduced(source, vocabulary), "lexical-docs")
        documents, terms = reduced.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        holding = dict(reduced.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = {t: term_weight(documents, holding.get(i, 0)) for t, i in vocabulary.items()}
        triples = [(i, vocabulary[t], n * weight[t]) for i, bag in enumerate(bags)
                   for t, n in bag.items()]
        tiles = ItemTiles.cut(len(block), np.array([x[0] for x in triples], np.int64),
                              np.array([x[1] for x in triples], np.int64),
                              [x[2] for x in triples], exact)
        best = stage(_best_of_tasks(reduced, tiles, documents, terms, top), "lexical-best")
        names = spark.createDataFrame([(i, row["key"]) for i, row in enumerate(block)],
                                      f"item int, `{item_key}` {item_type}")
        found = _ranked(best, top).join(names, "item").select(
            f"`{item_key}`", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(stage(found, "lexical-found"))
    if out is None:
        return spark.createDataFrame(
            [], f"`{item_key}` {item_type}, rank int, doc_id long, score long")
    return out
