"""Operator 4: remove repeated substrings by suffix sorting of shards.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts anywhere else,
in the same text or another. Three steps keep the work exact and bounded.

1. Anchors. The least hash among the 32-byte grams of a window is the same wherever the window
   recurs. Windows with one anchor that follow each other form a stretch; stretches whose anchor
   occurs once in the corpus cannot repeat and drop out. What is counted is combined before the
   shuffle, so an anchor in a third of all texts is one row per task.
2. Whole stretches. A stretch whose whole text (by 128 bits of hash) occurs again repeats entirely;
   copies of documents and inner parts of shared passages end here, without any sorting.
3. Suffixes. Of the other candidates, one piece per distinct text goes to a shard that its anchor
   decides, and ``induced_sort`` orders the shard's suffixes in external memory; neighbours with a
   common prefix of ``LENGTH`` repeat. An anchor with more than ``HOT`` distinct pieces would
   overfill a shard: its windows are compared by 128-bit fingerprints in a combining aggregate.

Null texts count as empty; texts shorter than ``LENGTH`` bytes repeat nothing. Rows are told apart
by key and text hash, so null and repeated keys are fine; identical rows repeat each other. Long
texts are hashed segment by segment. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from monthloom.llm.induced_sort import repeated
from monthloom.llm.textcodes import mix, point_codes, powers
from monthloom.shipping import ship_package
from monthloom.staging import stage

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1 << 21
HOT = 2_000
SEGMENT = 1 << 19


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(point_codes()[data] * up[: len(data)], out=sums[1:])
    return sums


def _range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, how) -> np.ndarray:
    """``how`` (minimum or maximum) over every window of ``width`` values."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    fill = values[-1]
    grid = np.full(rows * width, fill, values.dtype)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = how.accumulate(grid, axis=1).reshape(-1)
    behind = how.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return how(behind[: n - width + 1], ahead[width - 1: n])


def stretches(data: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray,
              length: int, gram: int) -> tuple:
    """Anchor, text hash, owner, start, windows and tie flag of all stretches of the byte segments
    ``data[begin:end]``; starts count from the segment's begin."""
    sums = _sums(data)
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool)
    _, down = powers(n + 1)
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    width = length - gram + 1
    least = _sliding(grams, width, np.minimum)  # anchor of the window at each start
    size = np.maximum(0, end - begin - length + 1)
    segment = np.repeat(np.arange(len(begin)), size)
    start = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = begin[segment] + start
    anchor = least[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1]))[: len(at)]
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(at))
    # A stretch longer than one anchor can cover holds ties; it is cut to bounded pieces.
    more = -(-count // width)
    piece = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    base = np.repeat(first, more) + piece * width
    count = np.minimum(np.repeat(first + count, more) - base, width)
    s, seg, v = at[base], segment[base], anchor[base]
    # An anchor that occurs at two places of a segment may repeat inside one stretch.
    highest = np.zeros(n, np.uint64)
    highest[at] = anchor
    padded = np.concatenate([np.zeros(width - 1, np.uint64), highest[: n - gram + 1]])
    spots = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
    where = np.searchsorted(begin, spots, side="right") - 1
    code = mix(grams[spots] + where.astype(np.uint64))
    found, times = np.unique(code, return_counts=True)
    tie = np.isin(mix(v + seg.astype(np.uint64)), found[times > 1])
    text = _range_hash(sums, s, s + count + length - 1)
    return v, text, owner[seg], s - begin[seg], count, tie


def _segments(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Groups of segments of bounded size: bytes end to end, owner, begin, end, offset in text."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t[at: at + SEGMENT + length - 1]
            if len(part) < length:
                continue
            held.append((i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    size = np.array([len(p) for _, _, p in held], np.int64)
    end = np.cumsum(size)
    return (np.frombuffer(b"".join(p for _, _, p in held), np.uint8),
            np.array([i for i, _, _ in held], np.int64), end - size, end,
            np.array([a for _, a, _ in held], np.int64))


def _sources(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k1"),
                       F.xxhash64(F.col(key).isNull(), body).alias("k2"), body.alias("body"))


def _all_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("text", pa.int64()), ("k1", pa.int64()),
                        ("k2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
                        ("tie", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                k1, k2 = (np.asarray(part.column(i)) for i in (0, 1))
                texts = [t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
                for data, owner, begin, end, offset in _segments(texts, length):
                    index = np.arange(len(owner))
                    v, th, seg, s, n, tie = stretches(data, index, begin, end, length, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v.view(np.int64)), pa.array(th.view(np.int64)),
                         pa.array(k1[owner[seg]]), pa.array(k2[owner[seg]]),
                         pa.array(s + offset[seg]), pa.array(n, pa.int32()), pa.array(tie)],
                        schema=schema)

    return docs.mapInArrow(run, "anchor long, text long, k1 long, k2 long, start long, "
                                "windows int, tie boolean")


def _pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted stretches: their rows plus ``piece``."""
    lists = wanted.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "start", "windows", "times", "hot")).alias("parts"))
    schema = pa.schema([("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("start", pa.int64()), ("windows", pa.int32()), ("times", pa.int64()),
                        ("hot", pa.bool_()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for k1, k2, body, parts in zip(
                        *(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    data = body.encode("utf-8", "surrogatepass")
                    rows += [(p["anchor"], k1, k2, p["start"], p["windows"], p["times"], p["hot"],
                              data[p["start"]: p["start"] + p["windows"] + length - 1])
                             for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                    schema=schema)

    # Identical rows share their keys; one of them is enough to read a piece from.
    return (docs.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
            .select("k1", "k2", "body", "parts").mapInArrow(
                run, "anchor long, k1 long, k2 long, start long, windows int, times long, "
                     "hot boolean, piece binary"))


def _sorted_spans(pieces: DataFrame, shards: int, length: int) -> DataFrame:
    """Spans of single pieces that repeat in their shard, by suffix sorting."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        size = part["piece"].str.len().to_numpy(np.int64)
        end = np.cumsum(size + 1)
        begin = end - size - 1
        text = np.frombuffer(b"\0".join(part["piece"]) + b"\0", np.uint8).astype(np.uint16) + 1
        text[end - 1] = 0
        windows = part["windows"].to_numpy(np.int64)
        wanted = np.zeros(len(text), bool)
        mark = np.zeros(len(text) + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + windows, -1)
        wanted[:] = np.cumsum(mark)[:-1] > 0
        hit = repeated(text, wanted, length)
        flag = np.concatenate([[0], hit.astype(np.int8), [0]])
        lo = np.flatnonzero(np.diff(flag) == 1)
        hi = np.flatnonzero(np.diff(flag) == -1)
        row = np.searchsorted(begin, lo, side="right") - 1
        single = part["times"].to_numpy()[row] == 1
        lo, hi, row = lo[single], hi[single], row[single]
        shift = part["start"].to_numpy(np.int64)[row] - begin[row]
        return pd.DataFrame({"k1": part["k1"].to_numpy()[row], "k2": part["k2"].to_numpy()[row],
                             "s": lo + shift, "e": hi - 1 + shift + length})

    return (pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
            .groupBy("shard").applyInPandas(run, "k1 long, k2 long, s long, e long"))


def _window_spans(pieces: DataFrame, length: int) -> DataFrame:
    """The same for the pieces of hot anchors, window by window."""
    schema = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("k1", pa.int64()),
                        ("k2", pa.int64()), ("s", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["piece"], np.uint8)
                n = r["windows"]
                at = np.arange(n)
                one = _range_hash(_sums(data), at, at + length)
                two = mix(_range_hash(_sums(data[::-1]), len(data) - at - length, len(data) - at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array(np.full(n, r["k1"])), pa.array(np.full(n, r["k2"])),
                     pa.array(r["start"] + at), pa.array(np.full(n, r["times"]))], schema=schema)

    rows = stage(pieces.mapInArrow(
        run, "f1 long, f2 long, k1 long, k2 long, s long, times long"), "substring-windows")
    again = rows.groupBy("f1", "f2").agg(F.sum("times").alias("n")).filter("n > 1")
    return rows.join(again, ["f1", "f2"]).select("k1", "k2", "s", (F.col("s") + length).alias("e"))


def repeated_spans(docs: DataFrame, length: int, gram: int, shard_bytes: int, hot: int
                   ) -> DataFrame:
    """Staged ``k1, k2, spans`` of every row with repeated bytes; spans may overlap."""
    runs = stage(_all_stretches(docs, length, gram), "substring-stretches")
    again = (runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("tie").alias("tied"))
             .filter("n > 1 or tied").select("anchor", "tied"))
    known = stage(runs.drop("tie").join(again, "anchor"), "substring-candidates")
    texts = stage(known.groupBy("anchor", "text").agg(
        F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("at"),
        F.max("windows").alias("windows"), F.max("tied").alias("tied")), "substring-texts")
    open_ = (texts.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.min("times").alias("least"), F.max("tied").alias("tied"))
        .filter("least = 1 and (kinds > 1 or tied)")
        .select("anchor", (F.col("kinds") > hot).alias("hot")))
    wanted = stage(texts.drop("tied").join(open_, "anchor").select(
        "anchor", "at.k1", "at.k2", "at.start", "windows", "times", "hot"), "substring-wanted")
    volume = wanted.filter("not hot").agg(
        F.sum(F.col("windows") + length)).first()[0] or 0
    pieces = stage(_pieces(docs, wanted, length), "substring-pieces")
    whole = known.join(texts.filter("times > 1").select("anchor", "text"), ["anchor", "text"]
                       ).select("k1", "k2", F.col("start").alias("s"),
                                (F.col("start") + F.col("windows") + length - 1).alias("e"))
    spans = whole.unionByName(
        _sorted_spans(pieces.filter("not hot"), max(1, -(-volume // shard_bytes)), length)
    ).unionByName(_window_spans(pieces.filter("hot"), length))
    return stage(spans.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("s", "e")).alias("spans")), "substring-spans")


def merged(spans: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the union of spans; spans that touch are one."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.array([[x["s"], x["e"]] for x in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.append(True, a[1:, 0] > reach[:-1])
    return a[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   keep: tuple[str, ...] = (), length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES, hot: int = HOT, as_text: bool = False
                   ) -> DataFrame:
    """Every row's key and ``keep`` columns with ``n_bytes, n_removed, n_spans`` and ``kept``, the
    bytes that stay; ``as_text`` makes them a string without the characters that were cut in two."""
    if gram > length:
        raise ValueError("a gram must not be longer than the strings it anchors")
    ship_package(docs.sparkSession)
    names = list(dict.fromkeys([key, *keep]))
    spans = repeated_spans(_sources(docs, key, text), length, gram, shard_bytes, hot)
    joined = _sources(docs, key, text, tuple(names)).join(spans, ["k1", "k2"], "left").select(
        *names, "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for body, spans in zip(part.column(len(names)).to_pylist(),
                                       part.column(len(names) + 1).to_pylist()):
                    data = body.encode("utf-8", "surrogatepass")
                    lo, hi = merged(spans or [], len(data))
                    edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(data)]
                    stay = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    gone = len(data) - len(stay)
                    rows.append((len(data), gone, len(lo),
                                 stay.decode("utf-8", "ignore") if as_text else stay))
                kinds = (pa.int64(), pa.int64(), pa.int64(),
                         pa.string() if as_text else pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)],
                     *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                    names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, StructType(
        [StructField(n, docs.schema[n].dataType, True) for n in names]
        + [StructField(n, LongType(), True) for n in ("n_bytes", "n_removed", "n_spans")]
        + [StructField("kept", StringType() if as_text else BinaryType(), True)]))
