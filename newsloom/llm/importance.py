"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text: its tokens (words and runs of punctuation, each with the white space before) and neighbouring pairs of
them, hashed into 2**BITS buckets. Two generative models give each bucket a probability, its share of all features: the raw
model counts all documents, the target model the labelled ones of quality 1 that aren't toxic. Counts are brought to the
target's size and smoothed by PSEUDO features in each bucket, for both models alike, so what the target sample is too small to show
counts little. A document's logarithmic weight sums the log ratios of all its features, each as often as it has it:

    log weight = sum over features of log((target count + PSEUDO) / (raw count * target total / raw total + PSEUDO))

Its key is that weight plus standard Gumbel noise from a hash of its id; the k largest keys stay, which is a sample without replacement
in proportion to the weights (Xie et al. 2023). k is a parameter, given as a share of all documents; where it is not given, it is the share of
quality 1 among the labelled. The k-th largest key is found by counting in ever narrower ranges, not by collecting.

The target model is fitted on at most about LABELS labelled documents (those least by a hash of their id); the raw model,
weights and keys cover all documents. The driver gets 2**BITS numbers a model, whatever the corpus.

Defined cases: null and empty texts have no features and the weight 0; with no labelled target all weights are 0 and all documents
stay; null labels don't count; an id labelled more than once is of the target if all its labels say so; equal keys at the bound all
stay; documents without an id share one noise. ``select`` keeps rows and all columns as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import fetched, fresh, stored
from .tokens import units

LABELS = 200_000
BITS = 16
#: Features added to each bucket of both models
PSEUDO = 20.0
SEED = 20


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features and the text of each; a text may have one more than once."""
    t = units(buf, offs)
    h = bw.hashes(t.buf, t.starts, t.ends, True)
    who = t.owner()
    parts, of = [bw.mix(h)], [who]
    if len(h) > 1:
        inside = who[:-1] == who[1:]
        parts.append(bw.chain(h[:-1], h[1:])[inside])
        of.append(who[1:][inside])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def log_ratios(target: np.ndarray, raw: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    """Of each bucket; 0 everywhere without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log(target + pseudo) - np.log(raw * (target.sum() / raw.sum()) + pseudo)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", limit: int = LABELS, bits: int = BITS) -> dict:
    """log_ratio by bucket, and share: that of quality 1 among the labelled (1 without labels)."""
    known = labels.where(F.col(quality).isNotNull() & F.col(toxic).isNotNull() & F.col(key).isNotNull())
    each = known.groupBy(F.col(key).cast("long").alias("id")).agg(F.min((F.col(quality) == 1).cast("int")).alias("good"), F.min(((F.col(quality) == 1) & (F.col(toxic) != 1)).cast("int")).alias("target"))
    n, good = each.agg(F.count("*"), F.sum("good")).first()
    sample = each.where("target = 1").select(F.col("id").alias("_id"))
    if n > limit:  # the share of the hash range that holds about as many
        sample = sample.where(F.abs(F.xxhash64("_id") % 1_000_000) < int(1_000_000 * limit / n))
    base = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
    marked = base.join(F.broadcast(sample.withColumn("_in", F.lit(True))), "_id", "left").select("text", F.coalesce("_in", F.lit(False)).alias("target"))  # about ``limit`` ids

    def count(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in bw.chunks(batches, "text"):
            f, d = features(*bw.flat(b.column(0)), bits)
            raw += np.bincount(f, minlength=len(raw))
            target += np.bincount(f[b.column(1).to_numpy(zero_copy_only=False)[d]], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    summed = fetched(marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[summed["bucket"]], target[summed["bucket"]] = summed["raw"], summed["target"]
    return {"log_ratio": log_ratios(target, raw), "share": good / n if n and target.any() else 1.0}


def log_weight(text: Column, model: dict, spark) -> Column:
    ratios = model["log_ratio"]
    bits = len(ratios).bit_length() - 1
    shared = spark.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def weight(s: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for b in bw.chunks(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]), "text"):
            f, d = features(*bw.flat(b.column(0)), bits)
            out.append(np.bincount(d, shared.value[f], b.num_rows))
        return pd.Series(np.concatenate(out))

    return weight(text)


def gumbel(key: str, seed: int) -> Column:
    """Standard Gumbel noise of an id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest of a column, by counts over ever narrower ranges."""
    if k < 1:
        return math.inf
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return -math.inf
    above = 0
    while low < high:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("long")
        counts = {r["i"]: (r["n"], r["lo"], r["hi"]) for r in df.where(F.col(column).between(low, high)).groupBy(at.alias("i")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for i in sorted(counts, reverse=True):
            if above + counts[i][0] >= k:
                low, high = counts[i][1:]
                break
            above += counts[i][0]
    return low


def weigh(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and gumbel_key of every row, written once."""
    found = docs.select(F.col(key).alias("doc_id"), log_weight(F.col(text), model, docs.sparkSession).alias("log_weight"))
    return stored(found.withColumn("gumbel_key", F.col("log_weight") + gumbel("doc_id", seed)), "weights")


def bound(keys: DataFrame, share: float) -> float:
    """The least key that stays, of the share of rows."""
    return -math.inf if share >= 1 else kth_largest(keys, "gumbel_key", round(share * keys.count()))


def select(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float | None = None, seed: int = SEED) -> DataFrame:
    """The chosen rows with their columns and no others."""
    model = fit(docs, labels, key, text)
    least = bound(weigh(docs, model, key, text, seed), model["share"] if share is None else share)
    own = fresh("key", docs.columns)
    return docs.withColumn(own, log_weight(F.col(text), model, docs.sparkSession) + gumbel(key, seed)).where(F.col(own) >= least).drop(own)


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and gumbel_key of the chosen rows."""
    model = fit(docs, labels, key, text)
    found = weigh(docs, model, key, text, seed)
    return found.where(F.col("gumbel_key") >= bound(found, model["share"] if share is None else share))
