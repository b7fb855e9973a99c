"""Document fingerprints by winnowing.

Every run of K code points has a rolling hash; of every WINDOW neighbouring ones the least is chosen,
the rightmost of equals, and its position kept. So two texts that share K + WINDOW - 1 code points in
a row share a fingerprint, and nothing shorter than K counts. A text of fewer code points than K has
the hash of the whole at position 0; one with fewer runs than a window has the least of all; an
empty or null text has none. A fingerprint is written as 16 hexadecimal digits, 8 of the hash and 8 of the
position (less significant bits of either), in order of position.

Likeness of two texts: the share of their distinct hashes that both have; 1 for two empty texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import width

K = 24
WINDOW = 40
_BASE = 0xD1342543DE82EF95
_HEX = np.array([f"{b:02x}".encode() for b in range(256)], "S2")


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Of each run of k code points: a polynomial modulo 2**64, from runs of 1, 2, 4, ... by the bits of k."""
    with np.errstate(over="ignore"):
        h, have, power = bw.mix(codes.astype(np.uint64) + np.uint64(1)), 1, np.uint64(_BASE)
        out, length = None, 0
        while True:
            if k & have:
                out = h if out is None else out[: len(h) - length] * power + h[length:]
                length += have
            if have * 2 > k:
                return bw.mix(out)
            h = h[:-have] * power + h[have:]
            have, power = have * 2, power * power


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if have < w else out


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions in code points."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = (gram_hashes(codes, min(k, n)) >> np.uint64(32)).astype(np.uint64)
    chosen = []
    step = (1 << 20) - window  # by parts, so memory stays small for any length
    for a in range(0, max(1, len(h) - window + 1), step):
        part = h[a : a + step + window - 1]
        back = np.uint64(len(part)) - np.arange(len(part), dtype=np.uint64)  # less to the right
        least = sliding_min(part << np.uint64(32) | back, min(window, len(part)))
        at = len(part) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        chosen.append(at[np.append(True, at[1:] != at[:-1])] + a)
    at = np.unique(np.concatenate(chosen))
    return h[at].astype(np.uint32), at


def written(h: np.ndarray, at: np.ndarray) -> str:
    both = np.stack([h.astype(">u4"), at.astype(np.uint32).astype(">u4")], 1).astype(">u4")
    return _HEX[np.frombuffer(both.tobytes(), np.uint8)].tobytes().decode()


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2)
    return both[:, 0].astype(np.uint32), both[:, 1].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW, into: str = "fingerprint") -> DataFrame:
    """docs with their fingerprints."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: written(*winnow(x or "", k, window)))

    return docs.withColumn(into, of(F.col(text)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (bucket, doc_id, text, borrowed): each bucket has a range of ids in full and, borrowed, the row after it.

    Order: descending id, nulls last, then text. After the last document comes the first. Only the
    bounds and first ids of the ranges go to the driver, as many as a multiple of the shuffle partitions.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = 4 * width(spark)
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(base.where("doc_id is not null").approxQuantile("doc_id", steps, 0.2 / parts)))
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def place(s: pd.Series) -> pd.Series:
        return pd.Series(len(bounds.value) - np.searchsorted(bounds.value, s.to_numpy(np.int64), "right"), dtype=np.int32)

    # 0 has the largest ids; nulls follow the smallest
    bucket = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long"))))
    tops = base.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    own = base.select(bucket.alias("bucket"), "doc_id", "text", F.lit(False).alias("borrowed"))
    if not tops:
        return own
    first = spark.createDataFrame([(r["top"], tops[i - 1]["bucket"]) for i, r in enumerate(tops)], "top long, gives int")
    found = base.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("top")))
    lent = found.groupBy("gives", "doc_id").agg(F.min("text").alias("text")).select(F.col("gives").alias("bucket"), "doc_id", "text", F.lit(True).alias("borrowed"))
    return own.unionByName(lent)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    One shuffle deals ranges of ids; a worker then sees each text with the next one.
    """
    spark = docs.sparkSession
    dealt = with_next(docs, key, text)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        import hashlib

        held = None
        for b in bw.chunks(batches, "text"):
            rows = []
            for bucket, i, t, borrowed in zip(*(c.to_pylist() for c in b.columns)):
                h, at = winnow(t, k, window)
                now = (bucket, i, t, h, at, np.unique(h))
                if held is not None and held[0] == bucket:
                    _, j, s, sh, sat, su = held
                    e = edited(s, t)
                    eh, eat = winnow(e, k, window)
                    rows.append((j, len(s), hashlib.sha256(e.encode()).hexdigest(), written(sh, sat), written(eh, eat), likeness(su, np.unique(eh)), likeness(su, now[5])))
                held = None if borrowed else now
            yield pa.RecordBatch.from_arrays([pa.array(x, kd) for x, kd in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
