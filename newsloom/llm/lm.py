"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

Tokens: runs of characters other than ASCII white space, A-Z lower-cased, then one end per text.
A word's context is the word before it or the text's begin.

    p(w | v) = max(0, c(v w) - D(c(v w))) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v) * p(w)
    p(w)     = max(0, N(. w) - d(N(. w))) / N(..) + (d1 n1 + d2 n2 + d3 n3+) / N(..) / (V + 1)

c: counts; N(. w): different contexts of w; Ni(v): words seen i times after v; D, d: the usual discounts
from counts of counts, per order. A context never seen leaves p(w). V: different tokens with the end.

Counting. Tasks send sorted arrays of (context, word, count), one for each bucket, not rows. A
bucket is chosen by the context, for the few contexts that hold over 1/1000 of all tokens by context and word,
so none grows with one hot word; the number of buckets grows with the input. Each bucket becomes a file
of sorted 64-bit hashes and 32-bit counts in the folder that all machines share; so do the words' counts, p(w) and
context weights. Files are written whole under a name of the attempt, and only those count that a finished task returned.
Scoring maps these files into memory (where the folder is no file system, a copy without a name) and looks up
each batch's distinct pairs; the pages belong to the system, which drops them at need.

Defined cases: null and empty texts have the end alone; null ids train and aren't held out; with nothing to train on
p(w) is uniform over the unknown token (log10 1 = 0).
"""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import crc32_of, fetched, fresh, shared_dir, stored

BEGIN = np.uint64(0x5BD1E995A5A5A5A5)
END = np.uint64(0x1B873593CC9E2D51)
#: Tokens that a task counts before it sends what it has
FLUSH = 3_000_000
#: Tokens in the corpus for each bucket
BUCKET_TOKENS = 2_000_000
HOT_SHARE = 1000
#: Files that a worker has mapped at once
OPEN = 4096
_PAIR, _WORD = ("<u8", "<u4"), ("<u8", "<i8", "<f8", "<f8")


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: context and token hashes, ends included, and where each text begins."""
    t = bw.words(buf, offs, bw.SPACED)
    w = np.insert(bw.hashes(t.buf, t.starts, t.ends, True), t.first[1:], END)
    first = t.first + np.arange(len(t.first))
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first[:-1]] = BEGIN
    return before, w, first


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return bw.chain(v, w)


def bucket(v: np.ndarray, w: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    h = bw.mix(v ^ np.uint64(0xA0761D6478BD642F))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        is_hot = hot[at] == v
        h = np.where(is_hot, pair(v, w), h)
    return (h % np.uint64(n)).astype(np.int64)


def totals(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sums of their numbers."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2, and more; each between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * b / a if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def _save(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Arrays of one length in a row, the widest first; returns the path."""
    fs, top = pafs.FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(f"{top}/{file}") as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    return f"{folder}/{file}"


def _map(uri: str) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        size = fs.get_file_info(path).size
        return np.memmap(path, np.uint8, "r") if size else np.zeros(0, np.uint8)
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)


@dataclass
class Model:
    """Paths of the files and what all of them share; small whatever the corpus."""

    pairs: list[tuple[str, int]]
    words: list[tuple[str, int]]
    hot: np.ndarray
    tokens: int
    distinct: int
    high: tuple[float, float, float]
    unseen: float
    name: str


class Opened:
    """A model's files in memory of a worker."""

    kept: dict[str, "Opened"] = {}

    @classmethod
    def of(cls, m: Model) -> "Opened":
        if m.name not in cls.kept:
            cls.kept.clear()
            cls.kept[m.name] = cls(m)
        return cls.kept[m.name]

    def __init__(self, m: Model):
        self.m = m
        self.open: OrderedDict[str, list[np.ndarray]] = OrderedDict()

    def _file(self, path: str, n: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Columns of a file, mapped when it is first needed; the least used of more than OPEN files is let go."""
        if path not in self.open:
            self.open[path] = self._split(path, n, kinds)
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(path)
        return self.open[path]

    @staticmethod
    def _split(path: str, n: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
        raw, out, at = _map(path), [], 0
        for i, k in enumerate(kinds, 1):
            if i == len(kinds) and n:  # counts of pairs are as wide as the largest of a file needs
                k = f"{k[:2]}{(len(raw) - at) // n}"
            size = n * int(k[-1])
            out.append(raw[at : at + size].view(k))
            at += size
        return out

    def _look(self, files: list[tuple[str, int]], kinds: tuple[str, ...], where: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        """Columns after the hash for each h, 0 where it is missing."""
        out = [np.zeros(len(h), "<i8" if k[1] == "u" else k) for k in kinds[1:]]
        order = np.argsort(where, kind="stable")
        some, edge = np.unique(where[order], return_index=True)
        for b, i, j in zip(some.tolist(), edge.tolist(), np.append(edge[1:], len(h)).tolist()):
            at, f = order[i:j], self._file(*files[b], kinds)
            if len(f[0]):
                k = np.minimum(np.searchsorted(f[0], h[at]), len(f[0]) - 1)
                ok = f[0][k] == h[at]
                for o, c in zip(out, f[1:]):
                    o[at[ok]] = c[k[ok]]
        return out

    def look_words(self, h: np.ndarray) -> list[np.ndarray]:
        return self._look(self.m.words, _WORD, (h % np.uint64(len(self.m.words))).astype(np.int64), h)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score, score of each text."""
        m = self.m
        v, w, first = tokens(buf, offs)
        wh, place = np.unique(w, return_inverse=True)
        c, p1, _ = self.look_words(wh)
        p1 = np.where(c > 0, p1, m.unseen)
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
        vh, vplace = np.unique(v, return_inverse=True)
        cv, _, gamma = self.look_words(vh)
        keys, one, kplace = bw.distinct(pair(v, w))
        (n,) = self._look(m.pairs, _PAIR, bucket(v[one], w[one], m.hot, len(m.pairs)), keys)
        of = np.abs(cv)[vplace[one]]  # the begin's count is negative, as it is no token
        n = n.astype(np.float64)
        p = np.where(of > 0, np.maximum(0, n - discount(n, m.high)) / np.maximum(of, 1) + gamma[vplace[one]] * p1[place[one]], p1[place[one]])
        return np.diff(first), bw.sums((c > 0).astype(np.int64)[place], first), bw.sums(base[place], first), bw.sums(np.log10(p)[kplace], first)


def _send(where: np.ndarray, n: int, arrays: dict[str, np.ndarray], kind: int = 0) -> pa.RecordBatch:
    """A row for each bucket that has something, with its arrays as bytes. Arrays are in order of bucket."""
    edge = np.searchsorted(where, np.arange(n + 1))
    full = np.flatnonzero(np.diff(edge))
    cols = [pa.array(full, pa.int64()), pa.array([kind] * len(full), pa.int64())]
    for a in arrays.values():
        cols.append(pa.array([a[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["bucket", "kind", *arrays])


def _rows(table: pa.Table, name: str, kind: str, only: int | None = None) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x, k in zip(table[name].to_pylist(), table["kind"].to_pylist()) if only is None or k == only] or [np.zeros(0, kind)])


_SENT = "bucket long, kind long, a binary, b binary, n binary"


def train(docs: DataFrame, use: Column | None = None, text: str = "text") -> Model:
    """Counts the rows where ``use`` holds (all by default)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "ngrams")
    texts = (docs.where(use) if use is not None else docs).select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("n")).first()
    guess = (size["c"] or 0) // 6 + size["n"]
    buckets = max(8, -(-guess // BUCKET_TOKENS))

    def unigrams(batches):
        def flush(parts):
            h, n = totals(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
            where = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            return _send(where[order], buckets, {"a": h[order], "b": h[:0], "n": n[order].astype("<u4")})

        parts, held = [], 0
        for b in bw.chunks(batches, "text"):
            _, w, _ = tokens(*bw.flat(b.column(0)))
            h, n = np.unique(w, return_counts=True)
            parts.append((h, n))
            held += len(h)
            if held > FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    def sum_words(key, table):
        h, n = totals(_rows(table, "a", "<u8"), _rows(table, "n", "<u4").astype(np.int64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "kind": pa.array([0], pa.int64()), "a": pa.array([h.tobytes()], pa.binary()), "b": pa.array([n.tobytes()], pa.binary()), "n": pa.array([np.array([n.sum(), len(n)], "<i8").tobytes()], pa.binary())})

    words = stored(texts.mapInArrow(unigrams, _SENT).groupBy("bucket").applyInArrow(sum_words, _SENT), "word-counts")
    sizes = [np.frombuffer(r["n"], "<i8") for r in words.select("n").collect()]
    total, distinct = int(sum(x[0] for x in sizes)), int(sum(x[1] for x in sizes))
    least = max(total // HOT_SHARE, 1000)

    def hottest(batches):
        for b in batches:
            for a, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(a, "<u8"), np.frombuffer(n, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= least].view("<i8"))], ["h"])

    found = fetched(words.select("a", "b").mapInArrow(hottest, "h long"))["h"].astype(np.int64).view(np.uint64)  # under HOT_SHARE by their share
    hot = np.unique(np.append(found, BEGIN))

    def bigrams(batches):
        def flush(parts):
            v, w, n = (np.concatenate([x[i] for x in parts]) for i in range(3))
            where = bucket(v, w, hot, buckets)
            order = np.lexsort((w, v, where))
            v, w, n, where = v[order], w[order], n[order], where[order]
            first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            n = np.add.reduceat(n, first)
            return _send(where[first], buckets, {"a": v[first], "b": w[first], "n": n.astype("<u4")})

        parts, held = [], 0
        for b in bw.chunks(batches, "text"):
            v, w, _ = tokens(*bw.flat(b.column(0)))
            _, one, place = bw.distinct(pair(v, w))
            parts.append((v[one], w[one], np.bincount(place)))
            held += len(one)
            if held > FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    def sum_pairs(key, table):
        v, w = _rows(table, "a", "<u8"), _rows(table, "b", "<u8")
        n = _rows(table, "n", "<u4").astype(np.int64)
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        v, w, n = v[first], w[first], np.add.reduceat(n, first)
        h = pair(v, w)
        order = np.argsort(h)
        path = _save(folder, f"pairs-{key[0].as_py():06d}", h[order], n[order].astype("<u4" if n.max(initial=0) < 1 << 32 else "<u8"))
        counts = np.array([(n == k).sum() for k in (1, 2, 3, 4)], "<i8")
        out = [pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([0], pa.int64()), pa.array([path.encode()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([np.array([len(h)], "<i8").tobytes()], pa.binary())], ["bucket", "kind", "a", "b", "n"])]
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        by = np.stack([np.add.reduceat((n == 1).astype("<u4"), at), np.add.reduceat((n == 2).astype("<u4"), at), np.add.reduceat((n > 2).astype("<u4"), at)], 1)
        ctx = v[at]
        where = (ctx % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        out.append(_send(where[order], buckets, {"a": ctx[order], "b": by[order].astype("<u4"), "n": ctx[:0]}, 1))
        ends, contexts = np.unique(w, return_counts=True)
        where = (ends % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        out.append(_send(where[order], buckets, {"a": ends[order], "b": ends[:0], "n": contexts[order].astype("<u4")}, 2))
        return pa.Table.from_batches(out)

    sent = stored(texts.mapInArrow(bigrams, _SENT).groupBy("bucket").applyInArrow(sum_pairs, _SENT), "pair-counts")
    files = {r["bucket"]: r for r in sent.where("kind = 0").collect()}
    pairs = [(bytes(files[b]["a"]).decode(), int(np.frombuffer(files[b]["n"], "<i8")[0])) if b in files else None for b in range(buckets)]
    empty = None
    if None in pairs:
        empty = (_save(folder, "empty"), 0)
    pairs = [p or empty for p in pairs]
    high = discounts(*(int(x) for x in sum((np.frombuffer(r["b"], "<i8") for r in files.values()), np.zeros(4, np.int64))))

    def continuation(key, table):
        h, n = totals(_rows(table, "a", "<u8", 2), _rows(table, "n", "<u4", 2).astype(np.int64))
        counts = [int(n.sum()), len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([counts], pa.list_(pa.int64()))})

    counted = sent.where("kind = 2").select("bucket", "kind", "a", "n").groupBy("bucket").applyInArrow(continuation, "bucket long, c array<long>")
    sums = counted.agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(6)]).first()
    c = np.array([x or 0 for x in sums], np.int64)
    low = discounts(*(int(x) for x in c[2:]))
    rest = (low[0] * c[2] + low[1] * c[3] + low[2] * (c[1] - c[2] - c[3])) / c[0] if c[0] else 1.0
    unseen = float(rest / (distinct + 1))

    def finish(key, table):
        b = key[0].as_py()
        kinds = table["kind"].to_pylist()
        own = [i for i, k in enumerate(kinds) if k == 0]
        h = np.frombuffer(table["a"][own[0]].as_py(), "<u8") if own else np.zeros(0, "<u8")
        n = np.frombuffer(table["b"][own[0]].as_py(), "<i8") if own else np.zeros(0, "<i8")
        ctx = _rows(table, "a", "<u8", 1)
        by = _rows(table, "b", "<u4", 1).reshape(-1, 3).astype(np.int64)
        order = np.argsort(ctx, kind="stable")
        ctx, by = ctx[order], by[order]
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
        ctx, by = ctx[first], np.add.reduceat(by, first, axis=0) if len(first) else by
        if b == int(BEGIN % np.uint64(buckets)):  # a context that is no token
            h, n = np.append(h, BEGIN), np.append(n, 0)
            order = np.argsort(h)
            h, n = h[order], n[order]
        ends, contexts = totals(_rows(table, "a", "<u8", 2), _rows(table, "n", "<u4", 2).astype(np.int64))
        count = n.astype(np.float64)
        count[h == BEGIN] = begins
        gamma, p = np.zeros(len(h)), np.full(len(h), unseen)
        at = np.searchsorted(h, ctx)
        gamma[at] = by @ np.array(high) / count[at]
        at = np.searchsorted(h, ends)
        p[at] += (contexts - discount(contexts, low)) / max(1, int(c[0]))
        n = np.where(h == BEGIN, -begins, n)
        path = _save(folder, f"words-{b:06d}", h, n.astype("<i8"), p, gamma)
        return pa.table({"bucket": pa.array([b], pa.int64()), "path": pa.array([path]), "size": pa.array([len(h)], pa.int64())})

    begins = int(size["n"])
    all_kinds = words.select("bucket", "kind", "a", "b", F.lit(b"").alias("n")).unionByName(sent.where("kind > 0"))
    seed = spark.createDataFrame([(b, 3, b"", b"", b"") for b in range(buckets)], _SENT)  # each bucket has a file
    made = all_kinds.unionByName(seed).groupBy("bucket").applyInArrow(finish, "bucket long, path string, size long").collect()
    listed = sorted((r["bucket"], r["path"], r["size"]) for r in made)
    return Model(pairs, [(p, n) for _, p, n in listed], hot, total, distinct, high, unseen, uuid.uuid4().hex)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 probability); names of results are replaced."""
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def scored(s: pd.Series) -> pd.DataFrame:
        opened, out = Opened.of(shared.value), []
        for b in bw.chunks(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]), "text"):
            out.append(opened.score(*bw.flat(b.column(0))))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 4
        return pd.DataFrame(dict(zip(("n_tokens", "n_known", "base_score", "score"), parts)))

    own = fresh("scored", docs.columns)
    found = docs.withColumn(own, scored(F.col(text)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], f"{own}.n_tokens", f"{own}.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), f"{own}.base_score", f"{own}.score")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_of(key), F.lit(10)) == 0, F.lit(False))


def score_held_out(docs: DataFrame) -> DataFrame:
    """Trained on what isn't held out, applied to all."""
    return score(docs, train(docs, ~held_out()))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
