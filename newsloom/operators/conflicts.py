"""Grouping of reports into events: leader clustering of titles within a country."""

from __future__ import annotations

import bisect
import difflib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from .components import components, redealt
from .storage import name, written

#: Longer titles are not bounded by common subsequences with each other, only by counts of characters
LONG_TITLE = 512


@dataclass
class Title:
    """What comparisons need of a normalised title: its keywords, and which of them are distinctive."""

    text: str
    words: frozenset[str]
    telling: frozenset[str]

    @classmethod
    def of(cls, text: str) -> "Title":
        words = frozenset(w for w in text.split() if len(w) >= V.KEYWORD_LENGTH)
        return cls(text, words, frozenset(w for w in words if len(w) >= V.DISTINCTIVE_LENGTH))


def shared_weight(a: Title, b: Title) -> tuple[bool, float]:
    """Whether the words alone make two titles fit, and what the words add to their score."""
    if not (a.words and b.words):
        return False, 0.0
    n, share = len(a.telling & b.telling), len(a.words & b.words) / min(len(a.words), len(b.words))
    return n >= V.STRONG_SHARED or (n > 0 and share >= V.OVERLAP_LEAST), share + 0.25 * n


def likeness(a: Title, b: Title) -> float:
    return difflib.SequenceMatcher(None, a.text, b.text).ratio()


def common(masks: list[np.ndarray], order: list[int]) -> np.ndarray:
    """The longest common subsequence of a title with each of many: no matching of blocks has more.

    A row of ``masks`` has, for a character, its places in each of the many as bits of 64-bit words (one array a word); ``order`` has the row of each
    character of the title. All advance at once (Hyyrö 2004).
    """
    n = masks[0].shape[1]
    vs = [np.full(n, np.iinfo(np.uint64).max, np.uint64) for _ in masks]
    u, total = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for row in order:
        carry = None
        for m, v in zip(masks, vs):
            np.bitwise_and(v, m[row], out=u)
            np.add(v, u, out=total)
            if len(vs) > 1:
                over = total < u
                if carry is not None:
                    np.add(total, carry, out=total)
                    over |= total < carry
                carry = over.astype(np.uint64)
            np.bitwise_xor(v, u, out=v)
            np.bitwise_or(v, total, out=v)
    return sum(np.bitwise_count(~v).astype(np.int64) for v in vs)


#: Titles that a task compares with each title of another block at once
BLOCK = 4096
#: Pairs that a task returns at once
PAIRS = 1 << 18
#: Sets of more keywords meet by single words, not by two at a time
WIDE = 40


def titles_of(rows: DataFrame) -> DataFrame:
    """Distinct titles of rows (k, c: country, t: title, d: day), written once: id, c, t, first and last place in the order, least and most day, undated."""
    place = F.struct(F.col("d").isNull().alias("undated"), "d", "k")
    found = rows.where("t <> ''").groupBy("c", "t").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("d").alias("low"), F.max("d").alias("high"), F.max(F.col("d").isNull()).alias("undated"))
    return written(found.withColumn("id", F.monotonically_increasing_id()), "titles")


def word_pairs(titles: DataFrame) -> DataFrame:
    """(a, b), a < b: titles (id, c, t) whose words can make them fit.

    Titles that fit share a distinctive word and, unless the smaller set is so small that one word is its share, another keyword, so they meet by such twos: a
    pair that shares a single word, however frequent, isn't made. Words are ordered from rare to frequent within a country. The larger set gives all its twos; of
    the smaller, the rarest shared word is among those up to its share's complement, and meets the next shared word or, if not distinctive itself, one that is.
    Sets of over ``WIDE`` words would have too many twos; they meet others by rare words.
    """
    words = titles.select("id", "c", F.explode(X.keywords(F.split("t", " "))).alias("w"))
    often = redealt(words.groupBy("c", "w").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("c", "w")), "h")
    known = words.withColumn("h", F.xxhash64("c", "w")).join(often, ["h", "c", "w"])
    sets = known.groupBy("id", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ws")).withColumn("n", F.size("ws"))
    sets = written(sets.withColumn("least", F.ceil(F.col("n") * V.OVERLAP_LEAST - 1e-9).cast("int")), "sets")
    long = lambda w: F.length(w) >= V.DISTINCTIVE_LENGTH
    narrow, wide = sets.where(F.col("n") <= WIDE), sets.where(F.col("n") > WIDE)

    def twos(first: Column | None = None) -> Column:
        """Hashes of two words, one of them distinctive: the rarer among the ``first``, the other distinctive or among one more."""
        later = lambda x, i: F.filter(F.slice("ws", i + 2, F.size("ws")), lambda y, k: long(y) | (long(x) if first is None else long(x) & (i + 1 + k <= first)))
        rarer = F.col("ws") if first is None else F.slice("ws", 1, first)
        return F.flatten(F.transform(rarer, lambda x, i: F.transform(later(x, i), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))

    def met(x: DataFrame, y: DataFrame, on: str, more: Column) -> DataFrame:
        of = x.alias("x").join(y.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col(f"x.{on}") == F.col(f"y.{on}")) & (F.col("x.id") != F.col("y.id")) & more)
        return of.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    smaller = F.col("x.n") <= F.col("y.n")
    telling = narrow.withColumn("ws", F.filter("ws", long))
    two = lambda d, first=None: d.select("id", "c", "n", F.explode(twos(first)).alias("w"))
    one = lambda d, ws="ws": d.select("id", "c", "n", F.explode(ws).alias("w"))
    strong = met(two(telling), two(telling), "w", F.col("x.id") < F.col("y.id"))
    share = met(two(narrow.where("least > 1"), F.col("n") - F.col("least") + 1), two(narrow), "w", smaller)
    single = met(one(telling.where("least = 1")), one(telling), "w", smaller)
    rare = lambda d: one(d, F.slice(F.filter("ws", long), 1, F.greatest(F.size(F.filter("ws", long)) - (V.STRONG_SHARED - 1), F.lit(0))))
    wide_strong = met(rare(wide), rare(sets), "w", F.lit(True))
    wide_share = met(one(sets, F.slice("ws", 1, F.col("n") - F.col("least") + 1)), one(wide), "w", smaller)
    return strong.unionByName(share).unionByName(single).unionByName(wide_strong).unionByName(wide_share).distinct()


def blocks_of(titles: DataFrame, days: int | None, block: int = BLOCK) -> DataFrame:
    """Titles in blocks of a country, of like length and, where a country has more than a block, of like time; with what rules a pair of blocks out."""
    words = F.least(F.ceil(F.length("t") / 64), F.lit(LONG_TITLE // 64 + 1)).cast("int")
    slot = F.lit(0) if days is None else F.when(F.col("undated"), -(2**40)).when(F.col("high") - F.col("low") > days, -(2**41)).otherwise(F.floor(F.col("low") / max(days // 4, 1)))
    sized = titles.select("id", "c", "t", "undated", *[F.when(~F.col("undated"), F.col(d)).alias(d) for d in ("low", "high")], words.alias("words"), slot.cast("long").alias("slot"))
    sized = sized.withColumn("h", F.xxhash64("c", "words", "slot"))
    cells = sized.groupBy("h", "c", "words", "slot").agg(F.count("*").alias("n"))
    whole = cells.groupBy("c", "words").agg((F.sum("n") * F.col("words") <= block).alias("whole"))
    cells = cells.join(whole, ["c", "words"]).select("h", "c", "words", "slot", F.when(~F.col("whole"), F.col("slot")).alias("cell"), F.when(F.col("whole"), 1).otherwise(F.ceil(F.col("n") * F.col("words") / block)).alias("parts"))
    dealt = sized.join(redealt(cells, "h"), ["h", "c", "words", "slot"]).withColumn("salt", F.pmod(F.xxhash64("id"), "parts"))
    low, high = F.when(~F.max("undated"), F.min("low")), F.when(~F.max("undated"), F.max("high"))
    blocks = dealt.groupBy("c", "words", "cell", "salt").agg(F.collect_list(F.struct("id", "t", "low", "high")).alias("titles"), F.min(F.length("t")).alias("short"), F.max(F.length("t")).alias("long"), low.alias("low"), high.alias("high"))
    return written(blocks.withColumn("b", F.monotonically_increasing_id()), "blocks")


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows of few bytes and much work on all workers: a number of partitions that the adaptive planner keeps."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *by)


def ratio_pairs(titles: DataFrame, days: int | None, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: titles of a country whose characters can make them fit, some days of which may be in one window.

    No filter on words or parts of them can find these, so each title is compared with the titles of a block at once by bounds, of time, counts of characters
    and then common subsequences, each for what the one before leaves; blocks whose lengths or days rule a ratio out don't meet. Pairs of blocks are dealt to all workers.
    """
    blocks = blocks_of(titles, days, block)
    x, y = (blocks.drop("titles").alias(n) for n in "xy")
    reach = lambda p, q: F.col(f"{p}.long") * (2 - V.RATIO_LEAST) >= F.col(f"{q}.short") * V.RATIO_LEAST
    near = F.lit(True) if days is None else F.coalesce(F.greatest("x.low", "y.low") - F.least("x.high", "y.high") <= days, F.lit(True))
    meet = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.b") <= F.col("y.b")) & reach("x", "y") & reach("y", "x") & near)
    pairs = meet.select(F.col("x.b").alias("xb"), F.col("y.b").alias("yb"))
    texts = lambda n: blocks.select(F.col("b").alias(f"{n}b"), F.col("titles").alias(n))
    dealt = _dealt(pairs.join(texts("x"), "xb").join(texts("y"), "yb"), "xb", "yb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                one, other = (batch.column(c)[i].values for c in (2, 3))
                for a, b in _alike(one, other, batch.column(0)[i] == batch.column(1)[i], days):
                    held.append((np.minimum(a, b), np.maximum(a, b)))
                    n += len(a)
                    if n >= PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b"])
                        held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b"])

    return dealt.select("xb", "yb", "x", "y").mapInArrow(run, "a long, b long")


def _alike(one: pa.StructArray, other: pa.StructArray, same: bool, days: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of pairs of two blocks (or of one with itself) that the bounds leave, for each title of the one in turn."""
    size = lambda v: np.array([len(t) for t in v.field("t").to_pylist()], np.int64)
    if (size(other).max() > LONG_TITLE, -len(other)) > (size(one).max() > LONG_TITLE, -len(one)):
        one, other = other, one
    ids, lengths = zip(*[(v.field("id").to_numpy(), size(v)) for v in (one, other)])
    low, high = ([v.field(d).cast(pa.float32()).to_numpy(zero_copy_only=False) for v in (one, other)] for d in ("low", "high"))
    flat = [np.frombuffer("".join(v.field("t").to_pylist()).encode("utf-32-le"), np.uint32) for v in (one, other)]
    alphabet, codes = np.unique(np.concatenate(flat), return_inverse=True)
    mine, codes = np.split(codes[: len(flat[0])], np.cumsum(lengths[0])[:-1]), codes[len(flat[0]) :]
    n, most = len(other), max(lengths[0].max(), lengths[1].max())
    kind = np.uint8 if most < 256 else np.uint32
    title = np.repeat(np.arange(n), lengths[1])
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths[1]) - lengths[1], lengths[1])
    counts = np.bincount(codes * n + title, minlength=len(alphabet) * n).reshape(len(alphabet), n).astype(kind)
    masks = []
    if lengths[1].max() <= LONG_TITLE:
        for k in range(-(-int(lengths[1].max()) // 64)):
            masks.append(np.zeros((len(alphabet), n), np.uint64))
            at = place // 64 == k
            np.bitwise_or.at(masks[k], (codes[at], title[at]), np.uint64(1) << (place[at] % 64).astype(np.uint64))
    totals = np.arange(2 * most + 1)
    need = np.floor(totals * V.RATIO_LEAST / 2).astype(np.int64)
    need += 2.0 * need / np.maximum(totals, 1) < V.RATIO_LEAST
    row = np.zeros(len(alphabet), np.int64)
    for i, title in enumerate(mine):
        times = np.bincount(title, minlength=len(alphabet)).astype(kind)
        chars = np.flatnonzero(times)
        row[chars] = np.arange(len(chars))
        least = need[lengths[1] + len(title)]
        left = np.minimum(counts[chars], times[chars, None]).sum(0, dtype=kind) >= least
        if days is not None:
            left &= ~(np.maximum(low[1], low[0][i]) - np.minimum(high[1], high[0][i]) > days)  # undated: no number
        if same:
            left[: i + 1] = False
        at = np.flatnonzero(left)
        if len(at) and masks:
            at = at[common([np.stack([m[c].take(at) for c in chars]) for m in masks], row[title].tolist()) >= least[at]]
        if len(at):
            yield np.full(len(at), ids[0][i]), ids[1][at]


def similarity(titles: DataFrame, days: int | None = V.WINDOW_DAYS, block: int = BLOCK) -> DataFrame:
    """(t, s, score): a row of title t fits a seed of title s, if its time allows it; only where a row of s is before one of t."""
    found = word_pairs(titles).withColumn("alike", F.lit(False)).unionByName(ratio_pairs(titles, days, block).withColumn("alike", F.lit(True)))
    pairs = found.groupBy("a", "b").agg(F.max("alike").alias("alike"))
    side = lambda n: titles.select(F.col("id").alias(n), F.struct("t", "first", "last").alias(f"of_{n}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    ahead = [F.struct(F.col(t).alias("t"), F.col(f"of_{t}.t").alias("title"), F.col(s).alias("s"), F.col(f"of_{s}.t").alias("seed"), (F.col(f"of_{s}.first") < F.col(f"of_{t}.last")).alias("can")) for t, s in ("ab", "ba")]
    can = known.select("alike", F.explode(F.array(*ahead)).alias("e")).select("e.*", "alike").where("can").select("t", "title", "s", "seed", "alike")
    return _dealt(can, "t", "s").mapInArrow(_scored, "t long, s long, score double")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, title, s, seed, alike in zip(*[c.to_pylist() for c in batch.columns]):
            a, b = Title.of(title), Title.of(seed)
            fits, extra = shared_weight(a, b)
            ratio = likeness(a, b) if fits or alike else 0.0
            if fits or ratio >= V.RATIO_LEAST:
                out.append((t, s, ratio + extra))
        columns = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["t", "s", "score"])


class Leaders:
    """Seeds of a component in order. A row looks at the seeds of its own title and of those that its title fits, nothing else."""

    def __init__(self, days: int | None):
        self.days, self.count = days, 0
        self.seeds: dict[int, tuple[list[float], list[int]]] = {}  # days (undated: infinite) and numbers, by title

    def _live(self, title: int, day: int | None) -> int | None:
        """The earliest seed of a title that a row of a day can join. Rows come by date, so seeds of a title do."""
        days, numbers = self.seeds.get(title, ((), ()))
        at = 0 if day is None or self.days is None else bisect.bisect_left(days, day - self.days)
        return numbers[at] if at < len(numbers) else None

    def place(self, title: int, own: float, day: int | None, fits: list[dict]) -> tuple[int, int]:
        """The cluster that a row joins or begins, and the title of its seed; ``own``: the score of a title with itself."""
        best = None
        for s, score in [(title, own), *((f["s"], f["score"]) for f in fits)]:
            seed = self._live(s, day)
            if seed is not None and (best is None or (-score, seed) < best[:2]):
                best = (-score, seed, s)
        if best:
            return best[1], best[2]
        days, numbers = self.seeds.setdefault(title, ([], []))
        days.append(np.inf if day is None else day)
        numbers.append(self.count)
        self.count += 1
        return numbers[-1], title


def assign(df: DataFrame, key: str, country: str = "country", title: str = "article_title", date: str = "date_published", days: int | None = V.WINDOW_DAYS, block: int = BLOCK) -> DataFrame:
    """df with conflict_id and coverage_count, which replace columns of these names.

    Within a country, oldest first (undated last, ties by key), each row joins the seed that fits best or becomes one. Which titles fit which is found before, for
    distinct titles, by joins; rows of titles that nothing connects don't concern each other, so each component of that graph is a sequence of its own. A row
    comes with the titles that its own fits, so a task holds seeds, and its time is linear in rows and their edges. Rows without a title are
    each an event of their own. Sizes of clusters are an aggregate. The same title in two windows makes two clusters of one id.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("conflict_id", "coverage_count")])
    own = name("key", df.columns)
    day = F.datediff(F.try_to_date(F.substring(F.coalesce(F.col(date), F.lit("")).cast("string"), 1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    rows = df.select(F.col(key).alias("k"), F.lower(F.trim(F.coalesce(F.col(country), F.lit("")))).alias("c"), X.normalised_title(F.coalesce(F.col(title), F.lit(""))).alias("t"), day.alias("d"))
    rows = written(rows, "rows")
    titles = titles_of(rows)
    edges = written(similarity(titles, days, block), "edges")
    label = components(edges.select(F.col("t").alias("u"), F.col("s").alias("v")))
    fits = edges.groupBy("t").agg(F.collect_list(F.struct("s", "score")).alias("fits")).withColumnRenamed("t", "id")
    n_telling = F.size(X.keywords(F.split("t", " "), V.DISTINCTIVE_LENGTH))
    self_score = 1.0 + F.when(F.size(X.keywords(F.split("t", " "))) > 0, 1.0 + 0.25 * n_telling).otherwise(0.0)
    told = titles.select("id", "c", "t", self_score.alias("own")).join(fits, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    told = told.select(F.xxhash64("c", "t").alias("h"), "c", "t", "id", "own", F.coalesce("fits", F.array().cast("array<struct<s:bigint,score:double>>")).alias("fits"), F.coalesce("component", "id").alias("component"))
    placed = rows.where("t <> ''").withColumn("h", F.xxhash64("c", "t")).join(redealt(told, "h"), ["h", "c", "t"])
    ordered = placed.select("component", "k", "id", "own", "d", "fits").repartition("component").sortWithinPartitions("component", F.col("d").asc_nulls_last(), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, Leaders(days)
        for b in batches:
            found = []
            for c, *row in zip(*[b.column(n).to_pylist() for n in ("component", "id", "own", "d", "fits")]):
                if c != now:
                    now, leaders = c, Leaders(days)
                found.append(leaders.place(*row))
            numbers, seeds = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("component"), pa.array(numbers, pa.int64()), pa.array(seeds, pa.int64())], ["k", "component", "cluster", "seed"])

    kind = dict(df.dtypes)[key]
    joined = written(ordered.mapInArrow(run, f"k {kind}, component long, cluster long, seed long"), "clusters")
    sizes = redealt(joined.groupBy("component", "cluster").agg(F.count("*").alias("coverage_count")), "component")
    ids = titles.select(F.col("id").alias("seed"), X.conflict_id(F.col("c"), F.col("t")).alias("conflict_id"))
    found = joined.join(sizes, ["component", "cluster"]).join(ids, "seed").select("k", "conflict_id", "coverage_count")
    blank = rows.where("t = ''").select("k", X.conflict_id(F.col("c"), F.lit("")).alias("conflict_id"), F.lit(1).cast("long").alias("coverage_count"))
    told = found.unionByName(blank).withColumnRenamed("k", own)
    return df.join(told, df[key].eqNullSafe(told[own]), "left").drop(own)


def multi_covered(df: DataFrame, row_id: str) -> DataFrame:
    """How many conflict ids have a first row with a coverage over 1."""
    first = df.groupBy("conflict_id").agg(F.min_by("coverage_count", row_id).alias("c"))
    return first.agg(F.count_if(F.col("c") > 1).alias("multi"))


def overlap(a: Column, b: Column) -> Column:
    """struct<shared, telling, share> of two arrays of title words: common keywords, the distinctive ones among them, and their share of the smaller set."""
    x, y = X.keywords(a), X.keywords(b)
    both = F.array_intersect(x, y)
    least = F.least(F.size(x), F.size(y))
    return F.struct(F.size(both).cast("long").alias("shared"), F.size(X.keywords(both, V.DISTINCTIVE_LENGTH)).cast("long").alias("telling"), F.when(least > 0, F.size(both) / least).otherwise(0.0).alias("share"))


def representative(df: DataFrame, group: str, rank: Column, row_id: str, columns: list[str]) -> DataFrame:
    """For each group (blank: each row on its own) its size, first row id, and columns of the first row of the highest rank."""
    own = F.when(F.coalesce(F.col(group), F.lit("")) == "", F.concat(F.lit("__row"), F.col(row_id).cast("string"))).otherwise(F.col(group))
    best = F.max_by(F.struct(*columns), F.struct(rank, -F.col(row_id)))
    out = df.groupBy(own.alias("group_key")).agg(F.count("*").alias("size"), F.min(row_id).alias("first_row"), best.alias("_b"))
    return out.select("group_key", "size", "first_row", *[F.col(f"_b.{c}").alias(c) for c in columns])
