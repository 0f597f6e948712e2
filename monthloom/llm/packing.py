"""Operator 5: pack examples into sequences by vector bin packing.

Each partition of the input packs what it holds, in one pass and without a shuffle. An example
longer than a sequence first fills whole sequences; what is left of it competes for a place under
three limits at once: tokens, segments and loss-bearing tokens. The open sequence takes, among the
examples that fit, the one whose demand has the largest dot product with the room left, each
resource weighted by how scarce it is; the last room is filled by cutting an example. A
partition's remainder is cut at powers of two, which need no padding.

Memory per task: one record batch and a pool of at most ``POOL`` remainders. Partitions follow the
input's size, so nothing grows with the corpus. Null texts count as empty; an empty text is its
end id alone. Null, repeated or tied keys are carried along and never compared. An empty table
gives no rows. A lost task is simply run again.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.textcodes import first_indices, text_codes
from monthloom.llm.tokens import word_codes
from monthloom.shipping import ship_package

MAX_TOKENS = 4096
MAX_SEGMENTS = 64
POOL = 1024
_ROWS = 500


@dataclass
class Example:
    key: int | None
    ids: np.ndarray
    loss: int  # how many of its tokens bear loss; they come last, as answers do


def _loss_between(e: Example, start: int, stop: int) -> int:
    first = len(e.ids) - e.loss
    return max(0, stop - max(start, first))


class Packer:
    """Place examples into sequences; ``emit(example, start, length, sequence, offset)``."""

    def __init__(self, emit: Callable, max_tokens: int = MAX_TOKENS,
                 max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, pool: int = POOL):
        if min(max_tokens, max_segments, pool) < 1:
            raise ValueError("limits must be positive")
        self.emit, self.pool = emit, pool
        self.limits = np.array([max_tokens, max_segments, max_loss or max_tokens], np.int64)
        self.waiting: list[tuple[Example, int]] = []
        self.sequence = 0

    def _room(self, e: Example, start: int, room: np.ndarray) -> int:
        """Longest piece of ``e`` from ``start`` that the room takes."""
        if room[1] < 1:
            return 0
        most = min(len(e.ids) - start, int(room[0]))
        free = max(0, len(e.ids) - e.loss - start)  # tokens before the first that bears loss
        return most if most - free <= room[2] else min(most, free + int(room[2]))

    def add(self, e: Example) -> None:
        start = 0
        while (most := self._room(e, start, self.limits)) == self.limits[0]:
            self.emit(e, start, most, self.sequence, 0)
            self.sequence += 1
            start += most
        if start < len(e.ids):
            self.waiting.append((e, start))
        if len(self.waiting) >= self.pool:
            self._fill(keep=True)

    def _fill(self, keep: bool) -> None:
        """Fill sequences from the pool; with ``keep``, until half of the pool is used up."""
        items = self.waiting
        need = np.array([[len(e.ids) - s, 1, _loss_between(e, s, len(e.ids))] for e, s in items],
                        np.int64).reshape(-1, 3)
        free = np.ones(len(items), bool)
        starts = [s for _, s in items]
        left = int(need[:, 0].sum())
        goal = self.pool // 2 if keep else 0
        alive = len(items)
        while alive > goal and left >= self.limits[0]:
            room = self.limits.copy()
            offset = 0
            scarce = need[free].sum(axis=0) / self.limits
            weight = scarce / self.limits  # demand as a share of the limit, weighted by scarcity
            while room[0] > 0 and room[1] > 0 and alive:
                fits = free & (need <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, (need * (weight * room)).sum(axis=1), -1.0)
                    i = int(np.argmax(score))
                    size = int(need[i, 0])
                else:
                    sizes = np.where(free, need[:, 0], -1)
                    i = int(np.argmax(sizes))
                    size = self._room(items[i][0], starts[i], room)
                    if size < 1:
                        break
                e = items[i][0]
                self.emit(e, starts[i], size, self.sequence, offset)
                room -= (size, 1, _loss_between(e, starts[i], starts[i] + size))
                offset += size
                left -= size
                starts[i] += size
                need[i] = (len(e.ids) - starts[i], 1,
                           _loss_between(e, starts[i], len(e.ids)))
                if need[i, 0] == 0:
                    free[i] = False
                    alive -= 1
            self.sequence += 1
        self.waiting = [(items[i][0], starts[i]) for i in np.flatnonzero(free)]

    def finish(self) -> None:
        """Pack what waits; the last room sizes are powers of two, largest first."""
        self._fill(keep=False)
        while self.waiting:
            left = sum(len(e.ids) - s for e, s in self.waiting)
            size = min(1 << (left.bit_length() - 1), int(self.limits[0]))
            room = np.array([size, self.limits[1], self.limits[2]], np.int64)
            offset = 0
            while room[0] > 0 and room[1] > 0 and self.waiting:
                e, s = self.waiting[0]
                n = self._room(e, s, room)
                if n < 1:
                    break
                self.emit(e, s, n, self.sequence, offset)
                room -= (n, 1, _loss_between(e, s, s + n))
                offset += n
                if s + n == len(e.ids):
                    self.waiting.pop(0)
                else:
                    self.waiting[0] = (e, s + n)
            self.sequence += 1


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
    loss: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None, with_ids: bool = True,
) -> DataFrame:
    """Pieces of the tokenised texts and their places.

    ``loss`` names a column with the share (0 to 1) of an example's tokens, counted from its end,
    that bear loss; without it all do, and null counts as all. Columns: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset`` and, on request, ``ids`` (little-endian unsigned
    32-bit).
    """
    share = F.coalesce(F.col(loss).cast("double"), F.lit(1.0)) if loss else F.lit(1.0)
    source = docs.select(F.col(key).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"), share.alias("share"))
    ship_package(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(tokenizer)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(e: Example, start: int, length: int, sequence: int, offset: int) -> None:
            data = e.ids[start: start + length].tobytes()
            row = (e.key, start, length, zlib.crc32(data), len(e.ids), base + sequence, offset)
            rows.append((*row, data) if with_ids else row)

        def drain() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        packer = Packer(emit, max_tokens, max_segments, max_loss)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                keys = part.column(0).to_pylist()
                shares = part.column(2).to_pylist()
                count, flat = text_codes(part.column(1).to_pylist(), codes, byte_level=False)
                begin = first_indices(count)
                for i, k in enumerate(keys):
                    ids = np.append(flat[begin[i]: begin[i + 1]], end_id).astype("<u4")
                    bearing = round(min(1.0, max(0.0, shares[i])) * len(ids))
                    packer.add(Example(k, ids, bearing))
                if rows:
                    yield drain()
        packer.finish()
        if rows:
            yield drain()

    ddl = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long") + (", ids binary" if with_ids else "")
    return source.mapInArrow(run, ddl)
