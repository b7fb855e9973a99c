"""Token ids in files of fixed-width packed bits, in ascending order of document.

A file: 8 bytes ``TOKBITS1``; then blocks, each BLOCK ids (the last fewer) of ``bits`` bits, most
significant bit first, padded to whole bytes; then the documents' ids and id counts (64-bit each),
a byte per document that is 1 for a null id, the blocks' byte offsets (64-bit); at the end six
64-bit numbers: documents, tokens, blocks, bits, block length, byte where the index begins. All are
little-endian. ``bits`` is the least that holds every id of the vocabulary. Any id is in block
``i // BLOCK``, whose bytes are unpacked by numpy in one go.

Documents are dealt by ranges of their id, as many as fit FILE_BYTES of text each (and the shuffle partitions at least), so part k holds what precedes part k + 1 and each file is
written by one task, whole or not at all: another attempt writes under another name, and only the
name that a finished task returned is used. Files go to a folder that all machines share.

Defined cases: null and empty texts have the end id alone; null ids come first; equal ids are in
order of text; an empty table gives no file and no rows. Other columns are not carried.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import shared_dir, width
from .tokens import Tokens

MAGIC = b"TOKBITS1"
BLOCK = 1 << 16
END = 1
#: Bytes of text for a file
FILE_BYTES = 256 << 20


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids[:, None] >> shifts & 1).astype(np.uint8)).tobytes()


def unpacked(data: bytes, count: int, bits: int) -> np.ndarray:
    """Reads each id out of the four or five bytes that hold it."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(count, dtype=np.int64) * bits
    byte = at >> 3
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word = word << np.uint64(8) | raw[byte + k]
    shift = ((bits + 14) // 8 * 8 - bits - (at & 7)).astype(np.uint64)
    return (word >> shift & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        out.write(MAGIC)
        self.rest = np.zeros(0, np.uint32)
        self.keys, self.counts, self.nulls, self.offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
        self.tokens = 0

    def add(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
        self.keys.append(keys.fill_null(0).to_numpy())
        self.counts.append(counts)
        self.tokens += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        while len(self.rest) >= BLOCK:
            self._block(self.rest[:BLOCK])
            self.rest = self.rest[BLOCK:]

    def _block(self, ids: np.ndarray) -> None:
        data = packed(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        keys, counts, nulls = (np.concatenate(x) for x in (self.keys, self.counts, self.nulls))
        for x, kind in ((keys, "<i8"), (counts, "<i8"), (nulls, "u1"), (self.offsets, "<u8")):
            self.out.write(np.asarray(x, kind).tobytes())
        self.documents = len(keys)
        self.out.write(np.array([len(keys), self.tokens, len(self.offsets), self.bits, BLOCK, self.at], "<i8").tobytes())


class TokenFile:
    """Random access to a file: keys, counts, and ids from any position."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        docs, self.tokens, blocks, self.bits, self.block, self.index = np.frombuffer(self.file.read_at(48, size - 48), "<i8").tolist()
        index = self.file.read_at(size - 48 - self.index, self.index)
        keys, self.counts = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<i8", docs, 8 * docs)
        nulls = np.frombuffer(index, "u1", docs, 16 * docs)
        self.keys = pa.array(keys, pa.int64(), mask=nulls.astype(bool))
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks, 17 * docs).astype(np.int64), self.index)
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` on, reading only their blocks."""
        if not count:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + count - 1) // self.block
        out = []
        for k in range(a, b + 1):
            n = min(self.block, self.tokens - k * self.block)
            out.append(unpacked(self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k])), n, self.bits))
        return np.concatenate(out)[start - a * self.block :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END) -> list[dict]:
    """Writes the files; returns path, documents, tokens and first position of each, in order."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = base.repartitionByRange(max(width(docs.sparkSession), -(-size // FILE_BYTES)), *order[:1]).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        tokens = Tokens.of(vocabulary)
        size = max(tokens.tokenizer.get_vocab_size(), end + 1)
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        writer = None
        with fs.open_output_stream(f"{top}/{name}") as out:
            writer = Writer(out, bits_for(size))
            for b in bw.chunks(batches, "text"):
                ids, at = tokens.encode(*bw.flat(b.column(1)))
                writer.add(b.column(0), np.diff(at) + 1, np.insert(ids, at[1:], end).astype(np.uint32))
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "documents": [writer.documents], "tokens": [writer.tokens]})

    found = sorted((r.asDict() for r in dealt.mapInArrow(run, "part long, path string, documents long, tokens long").collect()), key=lambda r: r["part"])
    at = 0
    for r in found:
        r["start"], at = at, at + r["tokens"]
    return found


def read(spark, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit unsigned) of each document in the files."""
    rows = [(r["path"], r["start"]) for r in files if r["documents"]]
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(path)
                i = 0
                while i < len(f.counts):
                    j = max(int(np.searchsorted(f.starts, f.starts[i] + 4 * BLOCK, "right")) - 1, i + 1)
                    a = int(f.starts[i])
                    ids = f.ids(a, int(f.starts[j - 1] + f.counts[j - 1]) - a)
                    at = np.append(f.starts[i:j], f.starts[j - 1] + f.counts[j - 1]) - a
                    data = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([f.keys.slice(i, j - i), pa.array(f.starts[i:j] + base), pa.array(f.counts[i:j]), data], ["doc_id", "start", "n_tokens", "ids"])
                    i = j

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Written to the shared folder and read back."""
    return read(docs.sparkSession, write(docs, shared_dir(docs.sparkSession, "tokens"), vocabulary, **options))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
