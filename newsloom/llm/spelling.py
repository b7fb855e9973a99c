"""Spelling variants: a symmetric-delete join of the corpus' words, forms by count, roots by iterated joins.

Words are counted where the texts are (a table of counts for each task, handed on whenever it is full, then summed by Spark). Each word emits the hash of
itself and of each of its distinct single deletions; words that share a key meet, and one exact test of distance one decides.
A key has at most as many words as there are single insertions into it, so no key grows with the corpus. Rows carry hashes, never a
word for each of its deletions, so a word of any length costs its length. Equal 64-bit hashes of different words cost a comparison and nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .common import dropped, stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least so many times a word's occurrences
TIMES = 5
#: A run of letters loses a letter where this divides its hash
EVERY = 199
#: Counts that a task holds before it hands them on
HELD = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_GOLD = _U(0x9E3779B97F4A7C15)


def _counts(least: int, held: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{max(least, 1)},}}")  # deletions only shorten, so shorter runs never count

    def rows(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{key.as_py()}:".encode() if key.is_valid else b":")
                words = Counter(run.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode()))
                for word, n in words.items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % EVERY:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= held:
                    yield rows(total)
                    total = {}
        yield rows(total)

    return count


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, held: int = HELD) -> DataFrame:
    """(word, n): words of all whole texts with their occurrences."""
    found = docs.select(F.col("doc_id"), F.col("text").cast("string")).mapInArrow(_counts(least_length, held), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; hashes of its distinct single deletions, and the word that each of them is of."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(len(code), _BASE, _U)]), dtype=_U)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(len(code), _INVERSE, _U)]), dtype=_U)
        c = np.concatenate([[_U(0)], np.cumsum(mix(code + _GOLD) * up[:-1], dtype=_U)])
        length = size.astype(_U)
        own = mix((c[end] - c[start]) * down[start] + length * _GOLD)
        first = np.ones(len(code), bool)  # of equal letters in a row: their deletions are the same
        first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        t = np.flatnonzero(first)
        o = owner[t]
        rest = (c[t] - c[start[o]]) + (c[end[o]] - c[t + 1]) * _U(_INVERSE)
        less = mix(rest * down[start[o]] + (length[o] - _U(1)) * _GOLD)
    return own, less, o


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            own, less, of = deletion_keys(b.column(0).slice(i, 4096).to_pylist())
            yield pa.RecordBatch.from_arrays([np.concatenate([own, less]).view(np.int64), np.concatenate([own, own[of]]).view(np.int64)], ["key", "id"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([deletion_keys(b.column(0).to_pylist())[0].view(np.int64), *b.columns], ["id", "word", "n"])


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of all pairs of ``words`` (word, n: distinct) at distance exactly one."""
    known = stored(words.select("word", "n").mapInArrow(_ids, "id long, word string, n long"), "words")
    keys = known.select("word").mapInArrow(_emit, "key long, id long")
    pairs = keys.join(keys.withColumnRenamed("id", "other_id"), "key").where(F.col("id") <= F.col("other_id")).select("id", "other_id").distinct()
    other = known.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    one = pairs.join(known, "id").join(other, "other_id").where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    # words of one id meet themselves both ways already
    both = one.select("word", "n", "other", "other_n", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned"))
    pick = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a)
    return both.select(pick("word", "other"), pick("n", "other_n"), pick("other", "word"), pick("other_n", "n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): following forms to the last. A round doubles the steps made; counts grow along forms, so there is no circle."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        last, now = now, stored(moved, "roots")
        dropped(last)
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """Each word of the corpus with its form and root.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased; a run of which ``EVERY`` divides crc32("<doc_id>:<run>") loses
    one letter. Of a null id nothing is written before the colon. Null and empty texts have no words; a repeated row counts again; other columns
    don't matter; an empty table gives no rows. Of near words with equal counts the first in code-point order is the form.
    """
    words = stored(vocabulary(docs, least_length, least_count), "vocabulary")
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    ruled = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")))
    known = stored(ruled.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n"), "forms")
    out = known.join(roots(known.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
