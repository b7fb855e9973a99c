"""Harmonic packing of token ids into sequences, independently on each worker.

A document's ids and its end id are cut into pieces: whole sequences, then the halves, quarters,
... of the capacity that its rest contains down to ``least``, then a tail. A piece of length n is of
class j = capacity // n and goes into a bin of its class, which is a sequence once it has j pieces.
Bins of the classes 1, 2, 4, ... fill exactly; a tail bin wastes less than one tail's difference to
capacity / j. When a worker's rows end, the pieces of its unfinished bins are laid in a row and cut
at the capacity, the last cut at powers of two, which need no padding. So nothing is shuffled, a
worker holds at most capacity tokens a class, and padding doesn't grow with the number of workers.

Defined cases: null and empty texts have the end id alone; repeated rows are packed each; a null id
stays null. The result has the columns listed at ``SCHEMA`` and no others, so nothing can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .tokens import Tokens

CAPACITY = 1024
LEAST = 64
END = 0
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in "doc_id start length ids doc_tokens sequence_id offset sequence_length".split()])


class Packer:
    """One worker's bins. Pieces are (key, start, total, ids)."""

    def __init__(self, capacity: int, least: int, base: int):
        self.capacity, self.least, self.next = capacity, least, base
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        for n in self.lengths(total):
            piece = (key, at, total, ids[at : at + n])
            at += n
            j = self.capacity // n
            if j == 1:
                self._close([piece])
                continue
            group = self.open.setdefault(j, [])
            group.append((*piece[:3], piece[3].copy()))
            if len(group) == j:
                self._close(self.open.pop(j))

    def lengths(self, total: int) -> list[int]:
        out = [self.capacity] * (total // self.capacity)
        rest, n = total % self.capacity, self.capacity // 2
        while n >= self.least:
            if rest >= n:
                out.append(n)
                rest -= n
            n //= 2
        return out + [rest] * (rest > 0)

    def _close(self, pieces: list[tuple]) -> None:
        at, whole = 0, sum(len(p[3]) for p in pieces)
        for key, start, total, ids in pieces:
            self.rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at, whole))
            at += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Unfinished bins, in a row."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open.clear()
        total = sum(len(p[3]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        i, used = 0, 0
        for size in sizes:
            group, need = [], size
            while need:
                key, start, whole, ids = left[i]
                cut = ids[used : used + need]
                group.append((key, start + used, whole, cut))
                need -= len(cut)
                used += len(cut)
                if used == len(ids):
                    i, used = i + 1, 0
            self._close(group)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """A row for each piece; ids: little-endian 32-bit unsigned ids. Capacity must be a power of two."""
    if capacity < 1 or capacity & (capacity - 1) or least < 1:
        raise ValueError("capacity must be a power of two and least positive")

    def run(batches):
        tokens = Tokens.of(vocabulary)
        packer = Packer(capacity, least, TaskContext.get().partitionId() << 40)
        for b in bw.chunks(batches, "text"):
            ids, at = tokens.encode(*bw.flat(b.column(1)))
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
            for i, k in enumerate(b.column(0).to_pylist()):
                packer.add(k, ids[at[i] : at[i + 1]])
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
