"""Passages that an earlier document has too, found in suffix trees of groups that share a prefix.

A suffix is a word position with the 50 words from there on. Which of them can be repeated at all shows at their anchors: a suffix's anchor is the least of the
hashed 12-grams that lie within its 50 words (the first of equals), so equal suffixes have equal anchors, neighbours mostly have the same one, and a document has about
one anchor for 20 words. A suffix's prefix is what reaches from its start through its anchor, of 12 to 50 words. Anchors that no two documents share are dropped (counted
by Spark with partial aggregation); the suffixes of the others meet by anchor, neighbours in one piece, so that their words travel once. Where an anchor's suffixes
would be too many for a task's memory, the prefix is lengthened to all 50 words, and aggregation and a join that splits hot keys take the place of the tree.

In a task, whole groups are sorted by prefix doubling (names of 1, 2, 4 ... words); a node 50 words deep that holds suffixes of several documents gives repeats for all
but the documents with the least id. Neighbouring repeats make up maximal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import redealt, stored

WINDOW = 50
GRAM = 12
#: Suffixes of one anchor that a task takes
LIMIT = 1 << 15
#: Words of the groups that are sorted together (a group is never cut)
TOGETHER = 1 << 21
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _windows(text: bw.Words, window: int) -> np.ndarray:
    """Positions of words that begin a window within their text."""
    at = np.arange(len(text.starts))
    return np.flatnonzero(at + window <= np.repeat(text.first[1:], text.counts))


def _rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(h) - n + 1, 0), _U)
        for k in range(n):
            out = out * _U(base) + h[k : len(h) - n + 1 + k]
    return bw.mix(out)


def anchors(h: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of each window's anchor, and the hashes of all grams."""
    g = _rolled(h, gram, 0xD1342543DE82EF95)
    best, size, span = np.arange(len(g)), 1, window - gram + 1
    while size < span:
        step = min(size, span - size)
        a, b = best[:-step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        size += step
    return best[starts] if len(starts) else starts, g


def _hashed(texts: np.ndarray, offsets: np.ndarray) -> tuple[bw.Words, np.ndarray]:
    t = bw.words(texts, offsets, bw.SPACED)
    return t, bw.hashes(t.buf, t.starts, t.ends, False)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sha256 of the words, n_words)"""
    for b in batches:
        shas, n = [], []
        for text in b.column(1):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "sha", "n_words"])


def _anchored(window: int, gram: int):
    def run(b: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        t, h = _hashed(buf, offs)
        at, g = anchors(h, _windows(t, window), window, gram)
        at, n = np.unique(at, return_counts=True)
        doc, g = np.searchsorted(t.first, at, "right") - 1, g[at]
        order = np.lexsort((g, doc))
        doc, g, n = doc[order], g[order], n[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])][: len(g)])
        total = np.add.reduceat(n, new) if len(new) else n
        return pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), b.column(0).take(pa.array(doc[new])), pa.array(total.astype(np.int64))], ["g", "doc_id", "n"])

    return bw.mapper("text", run)


def _pieces(window: int, gram: int, large: bool):
    """Suffixes under anchors that documents share: neighbours of one anchor with their words, or (large) each by the hash of all its words."""

    def run(b: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        t, h = _hashed(buf, offs)
        starts = _windows(t, window)
        at, g = anchors(h, starts, window, gram)
        keep = np.zeros(len(starts), bool)
        doc = np.searchsorted(t.first, starts, "right") - 1
        known = b.column(b.schema.get_field_index("gs"))
        edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
        for i, (a, z) in enumerate(zip(edge[:-1], edge[1:])):
            found = known[i].values
            gs, wide = found.field("g").to_numpy().view(_U), found.field("large").to_numpy(zero_copy_only=False)
            keep[a:z] = np.isin(g[at[a:z]], gs[wide == large])
        starts, at, doc = starts[keep], at[keep], doc[keep]
        ids = lambda d: [b.column(b.schema.get_field_index(c)).take(pa.array(d)) for c in ("doc_id", "sha")]
        if large:
            one, two = (_rolled(h, window, base)[starts].view(np.int64) for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5))
            return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *ids(doc), pa.array((starts - t.first[doc]).astype(np.int32))], ["one", "two", "doc_id", "sha", "start"])
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)][: len(at)])
        n = np.diff(np.append(new, len(at)))
        words = [h[s : s + k + window - 1].tobytes() for s, k in zip(starts[new].tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(g[at[new]].view(np.int64)), *ids(doc[new]), pa.array((starts[new] - t.first[doc[new]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(words, pa.binary())], ["g", "doc_id", "sha", "start", "n", "words"])

    return bw.mapper("text", run)


def names(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each start the name (sorted as the words' hashes) of the node ``window`` words deep."""
    name = np.unique(words, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < window:
        step = min(size, window - size)
        more = np.zeros(len(name), np.int64)
        more[: len(name) - step] = name[step:]
        pair = name * (len(name) + 1) + more
        size += step
        if size == window:  # the last step is for the suffixes alone
            return np.unique(pair[starts], return_inverse=True)[1]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return name[starts]


def _trees(window: int, together: int):
    """Repeats among pieces that come sorted by anchor."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        column = b.column(5).cast(pa.large_binary())
        _, edges, data = column.buffers()
        edge = np.frombuffer(edges, np.int64, len(column) + 1, column.offset * 8) // 8
        words = np.frombuffer(data, _U)[edge[0] : edge[-1]]
        n = b.column(4).to_numpy().astype(np.int64)
        begin = np.cumsum(n + window - 1) - (n + window - 1)
        piece = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        node = names(words, begin[piece] + nth, window)
        doc = b.column(1).to_numpy()[piece]
        order = np.argsort(node, kind="stable")
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.r_[True, np.diff(node[order]) > 0]))
        hit = np.flatnonzero(doc > least[node])
        new = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(piece[hit]) != 0)][: len(hit)])
        first = hit[new]
        length = np.diff(np.append(new, len(hit)))
        start = b.column(3).to_numpy()[piece[first]] + nth[first]
        rows = pa.array(piece[first])
        return pa.RecordBatch.from_arrays([b.column(1).take(rows), b.column(2).take(rows), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], ["doc_id", "sha", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            if size >= together:
                other = np.flatnonzero(b.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
                if len(other):
                    yield solve([*held, b.slice(0, other[0])])
                    held, size, b = [], 0, b.slice(other[0])
            held.append(b)
            size += int((b.column(4).to_numpy().astype(np.int64) + window - 1).sum())
        if held:
            yield solve(held)

    return run


def _cut(window: int):
    """Texts without the words that their repeats cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, texts, spans = [], [], []
            for text, found in zip(b.column(2), b.column(3)):
                words = text.as_buffer().to_pybytes().split()
                start, n = (found.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + window - 1, -1)
                inside = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.r_[False, inside, False]))
                spans.append([{"start": a, "length": z - a} for a, z in zip(turns[::2].tolist(), turns[1::2].tolist())])
                removed.append(int(inside.sum()))
                texts.append(b" ".join([words[i] for i in np.flatnonzero(~inside)]).decode())
            kept = pa.array(texts, pa.string())
            shas = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), kept, shas], ["doc_id", "sha", "n_removed", "spans", "kept", "kept_sha256"])

    return run


def find(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, together: int = TOGETHER) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_removed, spans (of repeated words: start, length), kept (the other words, where some are
    removed), kept_sha256, copy (a document with a smaller id has the same words).

    A word is repeated if it lies in a window of words that also starts in a document with a smaller id (an integer). Null texts have no words, null ids
    neither repeat nor are repeated, rows of one id don't repeat each other and are judged each by its own words. Texts of fewer words than a window hold no repeat.
    Other columns aren't read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = stored(docs.mapInArrow(_read, f"doc_id {dict(docs.dtypes)['doc_id']}, sha binary, n_words long"), "words")
    known = known.withColumn("k", F.xxhash64("sha"))
    least = known.where("doc_id IS NOT NULL").groupBy("sha", "k").agg(F.min("doc_id").alias("least"))
    told = known.join(redealt(least, "k"), ["k", "sha"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    key = f"doc_id {dict(docs.dtypes)['doc_id']}, sha binary"
    read = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    by_doc = stored(read.mapInArrow(_anchored(window, gram), f"g long, {key.split(',')[0]}, n long"), "anchors")
    shared = by_doc.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.sum("n").alias("n")).where("a < z").select("g", (F.col("n") > limit).alias("large"))
    of_doc = by_doc.join(redealt(shared, "g"), "g").groupBy("doc_id").agg(F.collect_list(F.struct("g", "large")).alias("gs"))
    # copies of whole documents need no search: their first document's windows are all that they have
    copies = told.where("copy").groupBy("doc_id").agg(F.collect_set("sha").alias("copies"))
    wanted = read.join(of_doc.join(copies, "doc_id", "left"), "doc_id")
    own = F.unhex(F.sha2(F.concat_ws(" ", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), 256))
    held = stored(wanted.withColumn("sha", own).where("copies IS NULL OR NOT array_contains(copies, sha)").select("doc_id", "sha", "text", "gs"), "touched")

    small = held.mapInArrow(_pieces(window, gram, False), f"g long, {key}, start int, n int, words binary")
    trees = small.repartition("g").sortWithinPartitions("g").mapInArrow(_trees(window, together), f"{key}, start int, n int")
    wide = stored(held.mapInArrow(_pieces(window, gram, True), f"one long, two long, {key}, start int"), "wide")
    first = wide.groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    rest = wide.join(redealt(first, "one"), ["one", "two"]).where("doc_id > least").select("doc_id", "sha", "start", F.lit(1).alias("n"))
    spans = trees.unionByName(rest).groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    kinds = "n_removed long, spans array<struct<start:int,length:int>>, kept string, kept_sha256 string"
    cut = held.select("doc_id", "sha", "text").join(spans, ["doc_id", "sha"]).mapInArrow(_cut(window), f"{key}, {kinds}")
    # equal rows of an id are cut alike
    one = stored(cut, "cut").groupBy("doc_id", "sha").agg(*[F.min(c).alias(c) for c in ("n_removed", "spans", "kept", "kept_sha256")])
    out = told.join(one, ["doc_id", "sha"], "left")
    whole = F.col("copy") & (F.col("n_words") >= window)
    none = F.array().cast("array<struct<start:int,length:int>>")
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length")))
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, "").otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        "copy",
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
