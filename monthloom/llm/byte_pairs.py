"""Operator 7: byte-level BPE by overlapping chunks, and its inverse.

A text longer than one chunk is cut into chunks that overlap by a margin. Each chunk is split into
pre-tokens from a cold start, in parallel with the others. Where a chunk's own splitting and the
cold start of the next one first open a pre-token at the same place, both go on alike (the split
pattern never looks back), so the chunks join there: the left one keeps what lies before the place,
the right one drops it. A text with a margin in which no such place exists, for example one
unbroken run of letters, is split as a whole instead. Pre-tokens are merged by rank once per worker
and kept in a bounded table. Decoding concatenates the bytes of the ids.

Null texts count as empty and give no ids. Keys are carried along, so null, repeated and tied keys
are kept row by row; an empty table gives no rows. Long texts spread over tasks by chunk; per row,
memory is a small multiple of its ids.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.files import scan_partitions
from monthloom.llm.textcodes import (
    Slice, first_indices, prefix_hash, pretokens, segment_hash, slices, text_codes,
)
from monthloom.llm.tokens import decode_ids, rank_codes
from monthloom.shipping import ship_package
from monthloom.staging import stage

CHUNK_CHARS = 32_768
OVERLAP = 512
_GUARD = 4  # starts this close to a cut may depend on what lies behind it
_ROWS = 500


def _ids_batch(keys: pa.Array, count: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    data = flat.astype("<u4")
    offsets = (4 * first_indices(count)).astype(np.int64)
    ids = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(count, pa.int64()), ids.cast(pa.binary())],
        names=["key", "n_tokens", "ids"])


def _whole(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rank_codes(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                count, flat = text_codes(part.column(1).to_pylist(), codes, byte_level=True)
                yield _ids_batch(part.column(0), count, flat)

    return run


def join_place(piece: Slice, begin: np.ndarray, cut: int) -> int:
    """First place at or after ``cut`` where the splitting of ``piece`` and a cold start at
    ``cut`` both open a pre-token; -1 where the piece ends without one."""
    tail = piece.text[cut:]
    cold = pretokens(next(slices([tail]))) + cut
    both = np.intersect1d(begin[begin >= cut], cold)
    both = both[both <= piece.size - _GUARD]
    return int(both[0]) if len(both) else -1


def _chunks(ranks: str, chunk: int):
    """Per chunk: ids up to the place where the next chunk takes over, and how many ids lie before
    each of its first pre-tokens, so that the head can be dropped."""
    schema = pa.schema([("row_id", pa.int64()), ("key", pa.int64()), ("k", pa.int32()),
                        ("ids", pa.binary()), ("heads", pa.list_(pa.int32())),
                        ("before", pa.list_(pa.int32())), ("join_at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rank_codes(ranks)
        for batch in batches:
            rows = []
            for row_id, key, k, last, text in zip(*(c.to_pylist() for c in batch.columns)):
                piece = next(slices([text]))
                begin = pretokens(piece)
                end = np.append(begin[1:], piece.size)
                join_at = piece.size if last else join_place(piece, begin, chunk)
                if join_at < 0:
                    rows.append((row_id, key, k, b"", [], [], -1))
                    continue
                begin, end = begin[begin < join_at], end[begin < join_at]
                sums = prefix_hash(piece)
                size, flat = codes.lookup(piece.text, begin, end,
                                          segment_hash(sums, begin, end))
                head = begin <= OVERLAP
                rows.append((row_id, key, k, flat.astype("<u4").tobytes(), begin[head].tolist(),
                             first_indices(size)[:-1][head].tolist(), join_at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                schema=schema)

    return run


def _stitch(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                keys, counts, flats = [], [], []
                for key, pieces in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids, skip_to = [], 0
                    for p in pieces:
                        own = np.frombuffer(p["ids"], "<u4")
                        heads = p["heads"]
                        i = heads.index(skip_to) if skip_to in heads else len(heads)
                        drop = p["before"][i] if i < len(heads) else len(own)
                        ids.append(own[drop:])
                        skip_to = p["join_at"] - chunk
                    flat = np.concatenate(ids)
                    keys.append(key)
                    counts.append(len(flat))
                    flats.append(flat)
                yield _ids_batch(pa.array(keys, pa.int64()), np.array(counts, np.int64),
                                 np.concatenate(flats))

    return run


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text",
           chunk: int = CHUNK_CHARS) -> DataFrame:
    """Ids of every text: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit)."""
    if chunk < 2 * OVERLAP:
        raise ValueError("a chunk must be longer than two margins")
    ship_package(docs.sparkSession)
    ddl = "key long, n_tokens long, ids binary"
    source = docs.select(F.col(key).cast("long").alias("key"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.char_length("text") > chunk
    short_rows = source.filter(~long).mapInArrow(_whole(ranks), ddl)

    # The scan gives a row the same number in every run, so the number survives a repeated task.
    numbered = source.withColumn("row_id", F.monotonically_increasing_id()).filter(long)
    size = F.char_length("text")
    pieces = (
        numbered.select("row_id", "key", "text", F.explode(
            F.sequence(F.lit(0), F.ceil(size / chunk).cast("int") - 1)).alias("k"))
        .select("row_id", "key", "k", ((F.col("k") + 1) * chunk >= size).alias("last"),
                F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + OVERLAP)).alias("text"))
        .repartition(scan_partitions(source), "row_id", "k")
    )
    coded = stage(pieces.mapInArrow(
        _chunks(ranks, chunk), "row_id long, key long, k int, ids binary, heads array<int>, "
        "before array<int>, join_at int"), "bpe-chunks")
    failed = coded.filter("join_at < 0").select("row_id").distinct()
    whole_again = (numbered.join(failed, "row_id", "left_semi").select("key", "text")
                   .mapInArrow(_whole(ranks), ddl))
    gathered = (
        coded.join(failed, "row_id", "left_anti").groupBy("row_id")
        .agg(F.first("key").alias("key"),
             F.array_sort(F.collect_list(F.struct("k", "ids", "heads", "before", "join_at")))
             .alias("pieces"))
        .select("key", "pieces").mapInArrow(_stitch(chunk), ddl)
    )
    return (short_rows.unionByName(gathered).unionByName(whole_again)
            .select(F.col("key").alias("doc_id"), "n_tokens", "ids"))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                data = [decode_ids(np.frombuffer(x, "<u4"), ranks)
                        for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(data, pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return (encoded.select("doc_id", "n_tokens", "ids")
            .mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary"))
