"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Per language each piece of the vocabulary has a probability. A word (white space cuts words; each
begins with the vocabulary's word mark; letters lower-cased) has, per language, the sum over all of
its segmentations into pieces of the product of their probabilities, found by the forward
algorithm over bytes. A text's score is the product over its words; equal prior weights give the
likeliest language and, as ``score``, its posterior probability.

All pieces count, whatever their length, and words of any length are one lattice: pieces are found by walking a trie from all
places at once. Where no piece crosses a place, every segmentation has a border there, so a word's sum is the product of the sums of the
parts between such places, which the forward algorithm passes side by side. Sums are taken as plain products; where one comes
near the least double, its part is passed again in logarithms, so nothing has a floor.

Single bytes are pieces as well (the vocabulary's byte pieces), so every text has a segmentation.

Training: expectation maximisation over words of a bounded sample of labelled documents, all or an expected
SAMPLE of a language, those least by a hash of their id; expected piece counts are found on
the workers, and only languages x vocabulary numbers reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages
don't train; with nothing to train on every text is ``und``; ties go to the first language in order; null ids train and aren't held out;
repeated rows are each scored. Rows and other columns are kept; columns named like a result are replaced (``certain`` adds none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import crc32_of, fetched, fresh, stored

#: Documents a language that training takes, as expected
SAMPLE = 3000
ROUNDS = 3
#: Added to each piece's expected count
PRIOR = 0.02
#: Distinct words whose scores a worker remembers
REMEMBERED = 1_000_000
#: Sums under this are taken again in logarithms
SMALL = 1e-250
#: Parts of more bytes are passed in logarithms at once
LONG = 1024
_MARK = "▁".encode()


class Vocabulary:
    """A trie of the pieces' bytes: ``step[node, class of byte]`` is the next node or 0, ``piece[node]`` the piece that ends there or -1."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        pieces = {}
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                pieces[sp.id_to_piece(i).encode()] = i
        used = sorted({b for p in pieces for b in p})
        self.kind = np.zeros(256, np.int64)  # 0: bytes of no piece
        self.kind[used] = np.arange(1, len(used) + 1)
        inner = sorted({p[:k] for p in pieces for k in range(len(p))}, key=lambda x: (len(x), x))  # the root first, then nodes with children, then leaves
        number = {x: i + 1 for i, x in enumerate(inner)}
        for p in sorted(pieces):
            number.setdefault(p, len(number) + 1)
        self.step = np.zeros((len(inner) + 1, len(used) + 1), np.uint16 if len(number) < 1 << 16 else np.uint32)
        for x, i in number.items():
            if x:
                self.step[number[x[:-1]], self.kind[x[-1]]] = i
        self.piece = np.full(len(number) + 1, -1, np.int64)
        for p, i in pieces.items():
            self.piece[number[p]] = i

    _kept: dict[str, "Vocabulary"] = {}

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def matches(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all pieces in words that follow each other and end there; byte pieces come first, in order."""
        n = len(buf)
        stop = np.repeat(ends, np.diff(ends, prepend=0))
        kinds = self.kind[buf]
        starts, to, found = [np.arange(n)], [np.arange(1, n + 1)], [self.byte[buf]]
        at, node, d = np.arange(n), np.ones(n, np.int64), 0
        while len(at):
            node = self.step[node, kinds[at + d]].astype(np.int64)
            d += 1
            on = node > 0
            at, node = at[on], node[on]
            piece = self.piece[node]
            ok = piece >= 0
            starts.append(at[ok])
            to.append(at[ok] + d)
            found.append(piece[ok])
            on = (node < len(self.step)) & (at + d < stop[at])
            at, node = at[on], node[on]
        return np.concatenate(starts), np.concatenate(to), np.concatenate(found)


@dataclass
class Lattice:
    """All pieces in words, by parts that no piece crosses. A part of n bytes has n + 1 nodes; edges are in order of the place in
    their part where they end (``levels``: bounds of each place), then of their end; ``groups``: where the edges of each end begin."""

    word: np.ndarray  #: of each part
    start: np.ndarray  #: first node of each part
    end: np.ndarray  #: last node
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    levels: np.ndarray
    groups: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary, words: list[bytes]) -> "Lattice":
        ends = np.cumsum([len(w) for w in words])
        buf = np.frombuffer(b"".join(words), np.uint8)
        n = len(buf)
        a, b, piece = v.matches(buf, ends)
        crossed = np.zeros(n + 2, np.int64)
        np.add.at(crossed, a + 1, 1)
        np.add.at(crossed, b, -1)
        border = np.cumsum(crossed)[: n + 1] == 0
        cut = np.flatnonzero(border)  # 0, n and the borders of words are among them
        part = np.cumsum(border[:n]) - 1
        start = cut[:-1] + np.arange(len(cut) - 1)
        of = part[a]
        return cls._of(np.searchsorted(ends, cut[:-1], "right"), start, cut[1:] + np.arange(len(cut) - 1), a + of, b + of, piece, b - cut[of])

    @classmethod
    def _of(cls, word, start, end, source, target, piece, level) -> "Lattice":
        order = np.lexsort((target, level))
        source, target, piece, level = source[order], target[order], piece[order], level[order]
        groups = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        return cls(word, start, end, source, target, piece, np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else np.zeros(1, np.int64), groups)

    def only(self, parts: np.ndarray) -> "Lattice":
        """The lattice of some parts, with the same nodes."""
        size = int(self.end.max()) + 1
        mark = np.zeros(size + 1, np.int64)
        np.add.at(mark, self.start[parts], 1)
        np.add.at(mark, self.end[parts] + 1, -1)
        ok = np.cumsum(mark)[self.target] > 0
        level = self.target[ok] - self.start[np.searchsorted(self.start, self.target[ok], "right") - 1]
        return Lattice._of(self.word[parts], self.start[parts], self.end[parts], self.source[ok], self.target[ok], self.piece[ok], level)

    def forward(self, p: np.ndarray, logs: bool) -> np.ndarray:
        """Sums over segmentations up to each node (their logarithms where p has logarithms); p: (edges, ...)."""
        f = np.full((int(self.end.max()) + 1 if len(self.end) else 0, *p.shape[1:]), -np.inf if logs else 0.0)
        f[self.start] = 0.0 if logs else 1.0
        at = np.searchsorted(self.groups, self.levels)
        for k in range(len(self.levels) - 1):
            i, j = self.levels[k], self.levels[k + 1]
            g = self.groups[at[k] : at[k + 1]]
            if logs:
                f[self.target[g]] = np.logaddexp.reduceat(f[self.source[i:j]] + p[i:j], g - i, axis=0)
            else:
                f[self.target[g]] = np.add.reduceat(f[self.source[i:j]] * p[i:j], g - i, axis=0)
        return f

    def mirrored(self) -> tuple["Lattice", np.ndarray]:
        """The lattice read from the end, and the edge of this one that each of its edges is."""
        part = np.searchsorted(self.start, self.target, "right") - 1
        turn = lambda x: self.start[part] + self.end[part] - x
        source, target = turn(self.target), turn(self.source)
        level = target - self.start[part]
        order = np.lexsort((target, level))
        return Lattice._of(self.word, self.start, self.end, source, target, np.arange(len(source)), level), order


def word_scores(v: Vocabulary, p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural logarithm of each word's sum, (words, languages)."""
    if not words:
        return np.zeros((0, p.shape[1]))
    x = Lattice.of(v, words)
    size = x.end - x.start
    short = x if (size <= LONG).all() else x.only(np.flatnonzero(size <= LONG))
    out = np.full((len(size), p.shape[1]), -np.inf)
    with np.errstate(divide="ignore"):
        out[size <= LONG] = np.log(short.forward(p[short.piece], False)[short.end])
    low = np.flatnonzero((out < np.log(SMALL)).any(1))
    if len(low):
        y = x.only(low)
        out[low] = y.forward(np.log(p)[y.piece], True)[y.end]
    return bw.sums(out, np.searchsorted(x.word, np.arange(len(words) + 1)))


def expected(v: Vocabulary, p: np.ndarray, words: list[bytes], who: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
    """Adds to total (pieces, languages) how often each piece is expected in words that a language has so often."""
    x = Lattice.of(v, words)
    part = np.searchsorted(x.start, x.target, "right") - 1
    lang = who[x.word[part]]
    logs = np.log(p[x.piece, lang])
    f = x.forward(logs, True)
    y, order = x.mirrored()
    b = y.forward(logs[y.piece], True)
    after = b[x.start[part] + x.end[part] - x.target]
    n = count[x.word[part]] * np.exp(f[x.source] + logs + after - f[x.end[part]])
    np.add.at(total, (x.piece, lang), n)


def marked(word: bytes) -> bytes:
    """The word with its mark, lower-cased."""
    return _MARK + word.decode("utf-8", "replace").lower().encode()


def batched(words: list[bytes], most: int = 1 << 15):
    """Bounds of groups of words with so many bytes at most, of one word at least."""
    ends = np.cumsum([len(w) for w in words])
    i = 0
    while i < len(words):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")), i + 1)
        yield i, j
        i = j


def train(docs: DataFrame, use: Column, vocabulary: str, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and (pieces, languages) probabilities, from rows where ``use`` holds."""
    spark = docs.sparkSession
    labelled = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    # the part of the range of hashes that holds about ``sample`` ids: no ranking of a language's rows
    ladder = F.lit(False)
    for name in langs:
        most = min(int(min(1.0, sample / sizes[name]) * (1 << 64)) - (1 << 63), (1 << 63) - 1)
        ladder = ladder | ((F.col("lang") == name) & (F.xxhash64("id") <= most))

    def count(batches):
        for b in bw.chunks(batches, "text"):
            for name in set(b.column(0).to_pylist()):
                part = b.column(1).filter(pc.equal(b.column(0), name))
                t = bw.words(*bw.flat(part), bw.SPACED)
                h, one, place = bw.distinct(bw.hashes(t.buf, t.starts, t.ends, False))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array([t.raw(i) for i in one], pa.binary()), pa.array(np.bincount(place), pa.int64())], ["lang", "word", "n"])

    counted = stored(labelled.where(ladder).select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    size = Vocabulary.of(vocabulary).size
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches):
            v, total = Vocabulary.of(vocabulary), np.zeros((size, len(langs)))
            number = {x: i for i, x in enumerate(langs)}
            for b in batches:
                words, who, n = [marked(w) for w in b.column(1).to_pylist()], np.array([number[x] for x in b.column(0).to_pylist()], np.int64), b.column(2).to_numpy()
                for i, j in batched(words):
                    expected(v, shared.value, words[i:j], who[i:j], n[i:j], total)
            piece, lang_no = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang_no), pa.array(total[piece, lang_no])], ["piece", "lang", "n"])

        got = fetched(counted.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")))
        p = np.full((size, len(langs)), PRIOR)
        p[got["piece"], got["lang"]] += got["n"]
        p /= p.sum(0)
    return langs, p


class _Scorer:
    """Scores of words that this worker has met."""

    kept: dict = {}

    def __init__(self, vocabulary: str, p: np.ndarray):
        self.v, self.p = Vocabulary.of(vocabulary), p
        self._forget()

    def _forget(self) -> None:
        #: hashes and scores, sorted by hash: the many and the latest
        self.known = [(np.zeros(0, np.uint64), np.zeros((0, self.p.shape[1]), np.float32)) for _ in range(2)]

    def _keep(self, h: np.ndarray, score: np.ndarray) -> None:
        late = 1 if len(self.known[1][0]) + len(h) < max(20_000, len(self.known[0][0]) // 8) else 0
        parts = [self.known[1], (h, score)] if late else [*self.known, (h, score)]
        both, scores = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(both, kind="stable")
        self.known[late] = both[order], scores[order]
        if not late:
            self.known[1] = h[:0], score[:0]

    @classmethod
    def of(cls, name: str, vocabulary: str, p: np.ndarray) -> "_Scorer":
        if name not in cls.kept:
            cls.kept.clear()
            cls.kept[name] = cls(vocabulary, p)
        return cls.kept[name]

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        t = bw.words(buf, offs, bw.SPACED)
        h, one, place = bw.distinct(bw.hashes(t.buf, t.starts, t.ends, True))
        if not len(h):
            return np.zeros((len(offs) - 1, self.p.shape[1]))
        out, new = np.zeros((len(h), self.p.shape[1]), np.float32), np.ones(len(h), bool)
        for kh, ks in self.known:
            if len(kh):
                at = np.minimum(np.searchsorted(kh, h), len(kh) - 1)
                ok = kh[at] == h
                out[ok] = ks[at[ok]]
                new &= ~ok
        if new.any():
            words = [marked(t.raw(i)) for i in one[new]]
            out[new] = np.concatenate([word_scores(self.v, self.p, words[i:j]) for i, j in batched(words)])
            if sum(len(k[0]) for k in self.known) + len(h) > REMEMBERED:
                self._forget()
            self._keep(h[new], out[new])
        return bw.sums(out[place].astype(np.float64), t.first)


def guess(text: Column, langs: list[str], p: np.ndarray, vocabulary: str, spark) -> Column:
    """struct<lang, score> of a text; reads the text alone."""
    if not langs:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(p)
    names = pa.array(langs, pa.string())
    name = repr(hash(p.tobytes()))

    @F.pandas_udf("lang string, score double")
    def scored(s: pd.Series) -> pd.DataFrame:
        who, best = [], []
        for b in bw.chunks(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]), "text"):
            total = _Scorer.of(name, vocabulary, shared.value).texts(*bw.flat(b.column(0)))
            weight = np.exp(total - total.max(1, keepdims=True))
            i = total.argmax(1)
            who += names.take(pa.array(i)).to_pylist()
            best += (weight[np.arange(len(i)), i] / weight.sum(1)).tolist()
        return pd.DataFrame({"lang": pd.Series(who, dtype=object), "score": pd.Series(best, dtype=float)})

    return scored(text)


def _lettered(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    own = fresh("guess", docs.columns)
    found = docs.withColumn(own, guess(F.col(text), langs, p, vocabulary, docs.sparkSession))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(_lettered(text), F.col(f"{own}.lang")).otherwise("und").alias("lang_pred"), F.when(_lettered(text), F.col(f"{own}.score")).otherwise(0.0).alias("score"))


def certain(docs: DataFrame, vocabulary: str, least: float, text: str = "text") -> DataFrame:
    """Documents whose language is known with so much certainty, with their own columns alone."""
    langs, p = train(docs, ~held_out(), vocabulary, text)
    own = fresh("guess", docs.columns)
    found = docs.withColumn(own, guess(F.col(text), langs, p, vocabulary, docs.sparkSession))
    return found.where(_lettered(text) & (F.col(f"{own}.lang") != "und") & (F.col(f"{own}.score") >= least)).drop(own)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_of(key), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Trained on documents that aren't held out, applied to all."""
    langs, p = train(docs, ~held_out(), vocabulary)
    return predict(docs, langs, p, vocabulary)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
