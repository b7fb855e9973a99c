"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the items' windows of ``window`` consecutive words; an item of fewer words is one
window. For each pattern length m a table gives, for a block of two consecutive words, how far the
search may move on (at most m - 1 words); where it may not move, the block's bucket lists the
windows that end so, and direct comparison of the bytes confirms an occurrence. A text is cut into
lanes of m - 1 positions which all advance at once as numpy arrays, so most lanes cost one look-up. The shift table has
SPARSE slots for each block of the windows, so most places still shift however many items there are. Windows are indices into the
items' words, so tables take a small multiple of the items' bytes.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no
windows; a repeated item counts under each of its ids; repeated rows are each reported; an item
without an id never appears in ``items``, though its hits count. Other columns are passed through, whatever their names,
unless named like a result (n_words, n_hit, hits, items), which the result then replaces; ``clean`` passes all columns through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bytewords as bw
from .common import fresh, stored

WINDOW = 10
#: Bytes of items whose tables are broadcast at once; more items are searched in several blocks.
BLOCK_BYTES = 16 << 20
SPARSE = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Length:
    """Windows of m words: shift table, and buckets by the hash of the last block."""

    def __init__(self, m: int, words: bw.Words, h: np.ndarray, start: np.ndarray, item: np.ndarray):
        """words, h: of all items, lower-cased; start, item: first word and item of each window (an item number below 0 has no id)."""
        self.m, self.b = m, min(2, m)
        self.words, self.h = words, h
        _, one, place = bw.distinct(bw.chain(*[h[start + i] for i in range(m)]))
        self.start = start[one]
        owned = np.unique(np.stack([place, item], 1)[item >= 0], axis=0)
        self.owner, self.owner_at = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(one) + 1))
        self.bits = min(26, max(10, int(SPARSE * len(one) * (m - self.b + 1)).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.b + 1, np.int32)
        for j in range(self.b - 1, m):  # blocks nearest the end last, so the least shift stays
            self.shift[self._slot(self._block(j))] = m - 1 - j
        last = self._block(m - 1)
        order = np.argsort(last, kind="stable")
        self.last, self.order = last[order], order

    def _block(self, j: int) -> np.ndarray:
        return self.h[self.start + j] if self.b == 1 else bw.chain(self.h[self.start + j - 1], self.h[self.start + j])

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, t: bw.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the last word of each occurrence, and the window's number."""
        m, lane = self.m, self.m - self.b + 1
        first, n = t.first[:-1], t.counts
        per = np.maximum(0, -(-(n - m + 1) // lane))
        total = int(per.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(n)), per)
        k = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
        at = first[text] + m - 1 + k * lane
        stop = np.minimum(at + lane, (first + n)[text])
        ends, wins = [], []
        while len(at):
            block = h[at] if self.b == 1 else bw.chain(h[at - 1], h[at])
            by = self.shift[self._slot(block)]
            zero = by == 0
            if zero.any():
                e, hb = at[zero], block[zero]
                lo, hi = np.searchsorted(self.last, hb, "left"), np.searchsorted(self.last, hb, "right")
                some = hi > lo
                e, lo, hi = e[some], lo[some], hi[some]
                if len(e):
                    c = hi - lo
                    e2 = np.repeat(e, c)
                    p = self.order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)]
                    ok = self.h[self.start[p]] == h[e2 - m + 1]  # the prefix, before all words
                    e2, p = e2[ok], p[ok]
                    if len(e2):
                        ok = (self.h[self.start[p][:, None] + np.arange(m)] == h[e2[:, None] + np.arange(1 - m, 1)]).all(1)
                        e2, p = self._confirm(t, e2[ok], p[ok])
                        ends.append(e2)
                        wins.append(p)
            at = at + np.maximum(by, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return (np.concatenate(ends), np.concatenate(wins)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _confirm(self, t: bw.Words, e: np.ndarray, p: np.ndarray, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Direct comparison of bytes, case folded."""
        keep = np.zeros(len(e), bool)
        for i in range(0, len(e), step):
            at = (e[i : i + step, None] + np.arange(1 - self.m, 1)).ravel()
            own = (self.start[p[i : i + step]][:, None] + np.arange(self.m)).ravel()
            s, n = t.starts[at], t.ends[at] - t.starts[at]
            ps = self.words.starts[own]
            same = n == self.words.ends[own] - ps
            c = np.where(same, n, 0)
            walk = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            diff = _LOWER[t.buf[np.repeat(s, c) + walk]] != self.words.buf[np.repeat(ps, c) + walk]
            bad = np.bincount(np.repeat(np.arange(len(c)), c)[diff], minlength=len(c)) > 0
            keep[i : i + step] = (same & ~bad).reshape(-1, self.m).all(1)
        return e[keep], p[keep]


class Tables:
    """Search tables, one for each length of window, of (id, text) pairs."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.keys = [k for k, _ in items]
        raw = [(x or "").encode() for _, x in items]
        offs = np.cumsum([0] + [len(x) for x in raw])
        words = bw.words(_LOWER[np.frombuffer(b"".join(raw), np.uint8)], offs, bw.ALNUM)
        h = bw.hashes(words.buf, words.starts, words.ends, False)
        size = np.minimum(words.counts, window)
        number = np.array([i if k is not None else -1 for i, k in enumerate(self.keys)], np.int64)
        self.lengths = []
        for m in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == m)
            n = words.counts[own] - m + 1
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1][own], n)
            self.lengths.append(_Length(m, words, h, start, np.repeat(number[own], n)))


def scan(t: bw.Words, found: Tables) -> tuple[np.ndarray, list[set]]:
    """For each word whether an occurrence holds it; for each text the ids of items that occur."""
    h = bw.hashes(t.buf, t.starts, t.ends, True)
    delta = np.zeros(len(h) + 1, np.int64)
    items: list[set] = [set() for _ in t.counts]
    for x in found.lengths:
        e, p = x.search(t, h)
        np.add.at(delta, e - x.m + 1, 1)
        np.add.at(delta, e + 1, -1)
        if len(e):
            pairs = np.unique(np.stack([np.searchsorted(t.first, e, "right") - 1, p], 1), axis=0)
            for d, w in pairs.tolist():
                items[d].update(found.keys[k] for k in x.owner[x.owner_at[w] : x.owner_at[w + 1]].tolist())
    return np.cumsum(delta)[:-1] > 0, items


def _blocks(items: DataFrame, key: str, text: str, limit: int) -> list[DataFrame]:
    """Items in parts whose texts fit the limit (a part of one huge item may exceed it)."""
    size = items.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    n = -(-size // limit)
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(max(1, n)))
    return [items.where(part == i) if n > 1 else items for i in range(max(1, n))]


def find(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hits (first word and length of each run of hit words) and items (ids).

    Items are broadcast while their texts fit ``block_bytes``; beyond it each block is searched on
    its own and the hits of a document are united by a key of its row.
    """
    spark = docs.sparkSession
    results = ("n_words", "n_hit", "hits", "items")
    kept = [c for c in docs.columns if c.lower() not in results]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    kind = items.schema[item].dataType
    extra = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))), T.StructField("items", T.ArrayType(kind))])
    parts = _blocks(items.select(item, item_text), item, item_text, block_bytes)
    row = fresh("row", [*kept, *results])
    if len(parts) > 1:  # written, so that rows keep their numbers if a task runs again
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def searched(frame: DataFrame, part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(Tables([tuple(r) for r in part.collect()], window))
        schema = T.StructType([*frame.schema.fields, *extra.fields])

        def each(b, buf, offs):
            t = bw.words(buf, offs, bw.ALNUM)
            hit, ids = scan(t, shared.value)
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            text_edge = t.first[1:-1]
            text_edge = text_edge[(text_edge > 0) & (text_edge < len(hit))]
            cut = text_edge[hit[text_edge] & hit[text_edge - 1]] if len(hit) else text_edge
            cut = np.unique(cut)
            start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
            stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
            at = np.searchsorted(start, t.first)
            own = np.searchsorted(t.first, start, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array(start - t.first[own]), pa.array(stop - start)], ["start", "length"])
            named = pa.array([sorted(x) for x in ids], pa.list_(to_arrow_type(kind)))
            total = np.concatenate([[0], np.cumsum(hit)])
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(t.counts), pa.array(total[t.first[1:]] - total[t.first[:-1]]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), named], [*b.schema.names, *extra.names])

        return frame.mapInArrow(bw.mapper(text, each), schema)

    if len(parts) == 1:
        return searched(docs, parts[0])
    found = None
    for part in parts:
        one = searched(docs.select(row, text), part).where(F.size("hits") > 0).select(F.col(row).alias("row"), "hits", "items")
        found = one if found is None else found.unionByName(one)
    inside = F.expr("flatten(transform(hits, h -> sequence(h.start, h.start + h.length - 1)))")
    united = found.select("row", inside.alias("w"), "items").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
    runs = F.expr("transform(filter(w, (x, i) -> i = 0 or w[i - 1] < x - 1), s -> s)")
    ends = F.expr("filter(w, (x, i) -> i = size(w) - 1 or w[i + 1] > x + 1)")
    told = united.withColumns({"s": runs, "e": ends}).select(F.col("row").alias(row), F.struct(F.size("w").cast("long").alias("n_hit"), F.expr("transform(s, (x, i) -> struct(x as start, e[i] - x + 1 as length))").alias("hits"), F.col("ids").alias("items")).alias("told"))
    none = spark.createDataFrame([], T.StructType([T.StructField(item, kind), T.StructField(item_text, T.StringType())]))
    base = searched(docs, none).select(*[F.col(f"`{c}`") for c in kept], row, "n_words")
    own = fresh("told", [*kept, *results, row])
    joined = base.join(told.withColumnRenamed("told", own), row, "left")
    of = {f.name: F.coalesce(F.col(f"{own}.{f.name}"), (F.lit(0) if f.name == "n_hit" else F.array()).cast(f.dataType)).alias(f.name) for f in extra.fields[1:]}
    return joined.select(*[F.col(f"`{c}`") for c in kept], "n_words", *of.values())


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any hit, with their own columns alone. Several blocks of items are filters one after the other."""
    for part in _blocks(items.select(item, item_text), item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Tables([tuple(r) for r in part.collect()], window))
        docs = docs.where(_free(F.col(text), shared))
    return docs


def _free(text: Column, shared) -> Column:
    @F.pandas_udf("boolean")
    def free(s: pd.Series) -> pd.Series:
        out = [np.zeros(0, bool)]
        for b in bw.chunks(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]), "text"):
            t = bw.words(*bw.flat(b.column(0)), bw.ALNUM)
            hit, _ = scan(t, shared.value)
            total = np.concatenate([[0], np.cumsum(hit)])
            out.append(total[t.first[1:]] == total[t.first[:-1]])
        return pd.Series(np.concatenate(out))

    return free(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
