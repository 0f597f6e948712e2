"""Operator 10: token ids in binary shards, reached by key through minimal perfect hashing.

Layout. Texts are range-partitioned by key, encoded in key order, and each partition writes one
payload file of raw little-endian ids plus one ``.idx`` file with the length of every row. The key
index is split by hash into parts of bounded size; a part is a minimal perfect hash function, a
32-bit fingerprint per key, and the (shard, first row, rows) of the key. A look-up costs one hash
evaluation per level, one fingerprint comparison and one range read, whatever the corpus size.

The hash function is built by levels: keys that fall alone on a bit of a level keep it, the others
go to the next level; the rank of a key's bit is its slot. Everything is numpy over one part.

Rows with equal keys (also null keys) lie next to each other and share one index entry that names
how many there are. Null texts count as empty. An empty table gives no shards and no rows. Every
file name is unique to a task attempt and only rows of finished tasks name files, so lost
executors cost a repeat and nothing else.
"""
from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthloom.llm.files import TaskFile, open_file, scan_partitions, shared_folder, write_file
from monthloom.llm.textcodes import first_indices, mix, text_codes
from monthloom.llm.tokens import byte_level_codes
from monthloom.shipping import ship_package
from monthloom.staging import stage

KEYS_PER_PART = 1_000_000
_GAMMA = 2.0
_ROWS = 500
_READ = 8 << 20
_IDX_MAGIC = b"TOKIDX01"


# --- minimal perfect hashing -------------------------------------------------------------------

def _level_slot(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
    return (mix(hashes + salt) % np.uint64(bits)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Bits and level sizes of a minimal perfect hash of distinct 64-bit values."""
    sizes, levels = [], []
    rest = hashes
    while len(rest):
        bits = max(64, int(_GAMMA * len(rest)) // 64 * 64 + 64)
        slot = _level_slot(rest, len(sizes), bits)
        alone = np.bincount(slot, minlength=bits) == 1
        sizes.append(bits)
        levels.append(alone)
        rest = rest[~alone[slot]]
        if len(sizes) > 200:
            raise ValueError("the keys are not distinct")
    flags = np.concatenate(levels) if levels else np.zeros(0, bool)
    words = np.packbits(flags).reshape(-1, 8)
    ranks = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(axis=1))])
    return {"sizes": np.array(sizes, np.int64), "bits": words.reshape(-1), "ranks": ranks}


def hash_slots(table: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Slot of each value, -1 where no level has its bit."""
    out = np.full(len(hashes), -1, np.int64)
    open_ = np.arange(len(hashes))
    first = 0
    for level, bits in enumerate(table["sizes"].tolist()):
        at = first + _level_slot(hashes[open_], level, bits)
        there = (table["bits"][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        hit = at[there]
        word = table["bits"].reshape(-1, 8)[hit >> 6]
        inside = np.unpackbits(word, axis=1)
        before = np.arange(64) < (hit & 63)[:, None]
        out[open_[there]] = table["ranks"][hit >> 6] + (inside & before).sum(axis=1)
        open_ = open_[~there]
        first += bits
    return out


def _pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, **arrays)
    return sink.getvalue()


def _load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    with open_file(folder, name) as f:
        data = np.load(io.BytesIO(f.read()))
        return {k: data[k] for k in data.files}


# --- writing -----------------------------------------------------------------------------------

def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64(F.col(key)),
                           "h2": F.xxhash64(F.col(key), F.lit("fingerprint"))})


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write payload shards in ascending key order and return the staged row directory:
    ``doc_id, shard, row, n_tokens, bin, idx``, shards numbered in key order."""
    ship_package(docs.sparkSession)
    parts = scan_partitions(docs)
    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    )
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("row", pa.int64()),
                        ("n_tokens", pa.int64()), ("bin", pa.string()), ("idx", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_level_codes(tokenizer)
        shard = TaskContext.get().partitionId()
        payload = None
        keys, lengths = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                count, flat = text_codes(part.column(1).to_pylist(), codes, byte_level=True)
                ids = np.full(len(flat) + len(count), end_id, "<u2")
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(count)), count)] = flat
                if payload is None:
                    payload = TaskFile(folder, f"shard-{shard:06d}", ".bin")
                payload.write(ids.tobytes())
                keys.append(part.column(0))
                lengths.append(count + 1)
        if payload is None:
            return
        payload.close()
        n = np.concatenate(lengths)
        head = _IDX_MAGIC + np.array([2, len(n)], "<i8").tobytes()
        idx = write_file(folder, f"shard-{shard:06d}", ".idx", head + n.astype("<u4").tobytes())
        yield from pa.Table.from_arrays(
            [pa.chunked_array(keys, pa.int64()), pa.array(np.full(len(n), shard, np.int32)),
             pa.array(np.arange(len(n))), pa.array(n),
             pa.array([payload.name] * len(n)), pa.array([idx] * len(n))],
            schema=schema).to_batches(10_000)

    rows = ordered.mapInArrow(
        run, "doc_id long, shard int, row long, n_tokens long, bin string, idx string")
    return stage(rows, "token-rows")


def shard_bases(rows: DataFrame) -> DataFrame:
    """Ids in all shards before each shard; one row per shard."""
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


def build_index(rows: DataFrame, folder: str, keys_per_part: int = KEYS_PER_PART
                ) -> tuple[DataFrame, int]:
    """Write the key index; returns its staged directory ``part, name, n_keys`` and part count."""
    spark = rows.sparkSession
    entries = rows.groupBy("doc_id").agg(
        F.min("shard").alias("shard"), F.min("row").alias("row"), F.count("*").alias("n_rows"),
        F.first("bin").alias("bin"), F.first("idx").alias("idx"))
    parts = max(1, -(-rows.count() // keys_per_part))
    entries = _keyed(entries, "doc_id").withColumn(
        "part", F.pmod(F.col("h1"), F.lit(parts)).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        h1 = part["h1"].to_numpy().astype(np.int64).view(np.uint64)
        table = build_hash(h1)
        slot = hash_slots(table, h1)
        names, shard_at = np.unique(part["bin"].to_numpy().astype(str), return_inverse=True)
        idx_of = dict(zip(part["bin"], part["idx"]))
        values = {"fingerprint": part["h2"].to_numpy().astype(np.int64).astype(np.uint32),
                  "shard": part["shard"].to_numpy().astype(np.int32),
                  "bin_at": shard_at.astype(np.int32), "row": part["row"].to_numpy(),
                  "n_rows": part["n_rows"].to_numpy()}
        placed = {}
        for name, v in values.items():
            placed[name] = np.empty(len(part), v.dtype)
            placed[name][slot] = v
        number = int(part["part"].iloc[0])
        arrays = {**table, **placed, "bins": names.astype(str),
                  "idxs": np.array([idx_of[b] for b in names.tolist()], str)}
        name = write_file(folder, f"index-{number:06d}", ".mph", _pack_arrays(arrays))
        return pd.DataFrame({"part": [number], "name": [name], "n_keys": [len(part)]})

    built = entries.groupBy("part").applyInPandas(run, "part int, name string, n_keys long")
    return stage(built, "token-index"), parts


# --- reading -----------------------------------------------------------------------------------

def look_up(keys: DataFrame, index: DataFrame, parts: int, folder: str,
            key: str = "doc_id") -> DataFrame:
    """Where each distinct key's rows lie: ``doc_id, shard, row, n_rows, bin, idx``; keys that
    the index does not hold are left out (by fingerprint, wrong once in 2**32 absent keys)."""
    asked = _keyed(keys.select(F.col(key).cast("long").alias("doc_id")), "doc_id").withColumn(
        "part", F.pmod(F.col("h1"), F.lit(parts)).cast("int"))
    joined = asked.join(F.broadcast(index.select("part", "name")) if parts <= 10_000
                        else index.select("part", "name"), "part")
    schema = "doc_id long, shard int, row long, n_rows long, bin string, idx string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, dict] | None = None
        for batch in batches:
            for name, g in batch.groupby("name", sort=False):
                if held is None or held[0] != name:
                    held = (name, _load_arrays(folder, name))
                t = held[1]
                slot = hash_slots(t, g["h1"].to_numpy().astype(np.int64).view(np.uint64))
                mark = g["h2"].to_numpy().astype(np.int64).astype(np.uint32)
                ok = slot >= 0
                ok[ok] = t["fingerprint"][slot[ok]] == mark[ok]
                s = slot[ok]
                yield pd.DataFrame({
                    "doc_id": g["doc_id"].to_numpy()[ok] if not g["doc_id"].isna().any()
                    else g["doc_id"].astype("Int64").array[ok],
                    "shard": t["shard"][s], "row": t["row"][s], "n_rows": t["n_rows"][s],
                    "bin": t["bins"][t["bin_at"][s]], "idx": t["idxs"][t["bin_at"][s]]})

    return (joined.repartition(scan_partitions(keys), "part", F.pmod("h2", F.lit(64)))
            .sortWithinPartitions("part").mapInPandas(run, schema))


def _lengths(folder: str, name: str) -> np.ndarray:
    with open_file(folder, name) as f:
        data = f.read()
    if data[:8] != _IDX_MAGIC:
        raise ValueError(f"{name} is not an index of token lengths")
    return np.frombuffer(data, "<u4", offset=24)


def read_rows(places: DataFrame, folder: str, tasks: int, with_ids: bool = True) -> DataFrame:
    """Read the ids of looked-up keys back by ranges: ``doc_id, shard, offset, n_tokens,
    ids_crc32`` (``offset`` in ids from the shard's start) and, on request, ``ids``."""
    fields = [("doc_id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        size = begin = source = None
        window, window_at = b"", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if held != r["bin"]:
                    size = _lengths(folder, r["idx"]).astype(np.int64)
                    begin = first_indices(size)
                    if source is not None:
                        source.close()
                    source = open_file(folder, r["bin"])
                    window, window_at, held = b"", 0, r["bin"]
                for row in range(r["row"], r["row"] + r["n_rows"]):
                    at, n = 2 * int(begin[row]), 2 * int(size[row])
                    if at < window_at or at + n > window_at + len(window):
                        window_at, window = at, source.read_at(max(n, _READ), at)
                    ids = np.frombuffer(window, "<u2", count=n // 2, offset=at - window_at)
                    data = ids.astype("<u4").tobytes()
                    out = (r["doc_id"], r["shard"], at // 2, n // 2, zlib.crc32(data))
                    rows.append((*out, data) if with_ids else out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)],
                schema=schema)
        if source is not None:
            source.close()

    ddl = "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long"
    return (places.repartitionByRange(tasks, "shard", "row")
            .sortWithinPartitions("shard", "row")
            .mapInArrow(run, ddl + (", ids binary" if with_ids else "")))


class TokenStore:
    """A written store: ``rows`` (directory of rows), the key index and the shared folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0,
                 key: str = "doc_id", text: str = "text", keys_per_part: int = KEYS_PER_PART):
        self.folder = shared_folder(spark, "token-store")
        self.tasks = scan_partitions(docs)
        self.rows = write_shards(docs, self.folder, tokenizer, end_id, key, text)
        self.bases = stage(shard_bases(self.rows), "token-bases")
        self.index, self.parts = build_index(self.rows, self.folder, keys_per_part)

    def get(self, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
        """Rows of the given keys with ``start``, the number of ids before them in the store."""
        places = stage(look_up(keys.select(key).distinct(), self.index, self.parts, self.folder,
                               key), "token-places")
        read = read_rows(places, self.folder, self.tasks, with_ids)
        return read.join(self.bases, "shard").withColumn("start", F.col("base") + F.col("offset"))
