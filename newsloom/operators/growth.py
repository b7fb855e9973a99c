"""A growing table: union of batches, ordered duplicates, order, caps, back-fill of missing columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import name, removed, shared_path, written  # noqa: F401 (part of this module's interface)


def merged(existing: DataFrame, fresh: DataFrame, order: str = "ordinal") -> DataFrame:
    """All rows, those of the existing table first: columns of both, blank where missing, and row_id = (origin, ordinal)."""
    tagged = [d.withColumn("row_id", F.struct(F.lit(i).alias("origin"), F.col(order).cast("long").alias("ordinal"))) for i, d in enumerate((existing, fresh))]
    out = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    text = [c for c, k in out.dtypes if k == "string"]
    return out.na.fill("", text)


#: Rows of a component that one task decides in order
COMPONENT = 200_000


def first_of_each(df: DataFrame, row_id: str = "row_id", keys: tuple[str, ...] = ("article_id", "article_url"), most: int = COMPONENT) -> DataFrame:
    """Rows in order, without those that share a non-blank key with a row that was kept before.

    A dropped row doesn't hide later ones, so this is the first maximal independent set of the graph of shared keys. Of rows with equal keys only
    the first can stay, so an aggregate reduces them to one, however many there are. Rows that shared keys connect then make up components: each is
    streamed in order through a task that holds the keys of its kept rows. Components of more than ``most`` different combinations of keys are
    decided in rounds, all at once: what comes first under each of its keys stays, and its neighbours go. Row ids are unique. Rows without a key stay.
    """
    each = [F.nullif(F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.col(row_id).alias("r"), *each)
    keyed = rows.where(F.coalesce(*names).isNotNull())
    first = written(keyed.groupBy(*names).agg(F.min("r").alias("r")), "first")
    nodes = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.xxhash64(F.lit(i), n)) for i, n in enumerate(names)]))
    told = first.withColumn("nodes", nodes)
    pairs = told.select(F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("u"), F.slice("nodes", 2, F.size("nodes") - 1).alias("v"))).alias("e"), "r").select("e.u", "e.v", "r")
    label = components(pairs.repartitionByRange("r").sortWithinPartitions("r"))  # rows that share keys are often near each other
    placed = told.withColumn("node", F.get("nodes", F.lit(0))).drop("nodes").join(label, "node", "left").select("r", *names, F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    large = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component")
    kind = dict(first.dtypes)["r"]
    small = placed.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "r")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, set()
        for b in batches:
            stay = []
            for c, *ks in zip(*[b.column(n).to_pylist() for n in ("component", *names)]):
                if c != now:
                    now, taken = c, set()
                own = {(i, k) for i, k in enumerate(ks) if k is not None}
                stay.append(not own & taken)
                if stay[-1]:
                    taken |= own
            yield b.select(["r"]).filter(pa.array(stay, pa.bool_()))

    kept = small.select("component", "r", *names).mapInArrow(decide, f"r {kind}")
    kept = kept.unionByName(_in_rounds(placed.join(large, "component", "left_semi").select("r", *names), names))
    stay = rows.where(F.coalesce(*names).isNull()).select("r").unionByName(kept)
    return df.join(stay.withColumnRenamed("r", row_id), row_id, "left_semi")


def _in_rounds(left: DataFrame, names: list[str]) -> DataFrame:
    """The rows of large components that stay."""
    kept, left = left.select("r").limit(0), written(left, "left")
    while not left.isEmpty():
        first = left
        for n in names:
            least = left.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("r").alias(f"m{n}"))
            first = first.join(least, n, "left")
        heads = written(first.where(F.least(*[F.coalesce(F.col(f"m{n}"), F.col("r")) for n in names], F.col("r")) == F.col("r")).select("r", *names), "heads")
        kept = kept.unionByName(heads.select("r"))
        rest = left.join(heads.select("r"), "r", "left_anti")
        for n in names:
            rest = rest.join(heads.where(F.col(n).isNotNull()).select(n).distinct(), n, "left_anti")
        before, left = left, written(rest.select("r", *names), "left")
        removed(before)
    return kept


def date_order(date: str = "date_published", row_id: str = "row_id") -> list[Column]:
    """Latest text first, blank ones last, ties as they came."""
    return [F.when(F.coalesce(F.col(date), F.lit("")) != "", F.col(date)).otherwise("0000-00-00").desc(), F.col(row_id).asc()]


def capped(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group, in the order."""
    place = name("place", df.columns)
    return df.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(place) <= n).drop(place)


def seeds_within(found: DataFrame, most: int) -> DataFrame:
    """Rows (seed, url) of the seeds up to and with the one that brings the distinct addresses over ``most``."""
    new = found.groupBy("url").agg(F.min("seed").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    before = new.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a seed
    return found.join(F.broadcast(before.where(F.col("before") <= most).select("seed")), "seed", "left_semi")


def needs_text(text: Column, status: Column, again: bool = False) -> Column:
    missing = F.trim(F.coalesce(text, F.lit(""))) == ""
    return missing & (F.lit(again) | ~F.coalesce(status, F.lit("")).startswith("error"))


def not_yet(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among what is done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def first_needed(df: DataFrame, needs: Column, most: int | None, row_id: str) -> DataFrame:
    """The rows that need work, in their order the first ``most`` of them."""
    todo = df.where(needs)
    return todo if most is None else todo.orderBy(row_id).limit(most)


def one_of_each(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: of several the one with the least values (nulls last), in order of the columns."""
    order = F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))])
    return df.groupBy(*key).agg(F.min(order).alias("least")).select(*key, *[F.col(f"least.v_{c}").alias(c) for c in columns])


def back_filled(df: DataFrame, found: DataFrame, key: str, columns: list[str], needs: Column | str) -> DataFrame:
    """New values of some columns where a row needs and has them; others stay. Of several new values of a key the least ones count.

    ``needs``: a condition on df's columns, or the one of the columns whose new value says by being there that a row is filled.
    """
    new = {c: name(f"new_{c}", [*df.columns, *columns]) for c in columns}
    needs = F.col(f"`{new[needs]}`").isNotNull() if isinstance(needs, str) else needs
    out = df.join(one_of_each(found, [key], columns).withColumnsRenamed(new), key, "left")
    filled = {c: F.when(needs, F.coalesce(F.col(f"`{n}`"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")) for c, n in new.items()}
    return out.withColumns(filled).drop(*new.values())


def numbered(df: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """Rows with their number (from 1) in the whole order, which has to be a total one.

    Ranges of the order are sorted on their own and written once; only their sizes, one number a range, go through the driver.
    """
    taken = list(df.columns)
    part, own = name("range", taken), name("within", taken)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # range << 33 | place in it
    dealt = written(ranged.withColumn(part, F.shiftright(number, 33).cast("int")).withColumn(own, number.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    before, at = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(i, 0)
    starts = F.array(*[F.lit(b).cast("long") for b in before or [0]])
    return dealt.select(*[F.col(f"`{c}`") for c in taken], (F.get(starts, F.col(part)) + F.col(own) + 1).alias(into))


def status_counts(df: DataFrame, status: str = "text_status") -> DataFrame:
    s = F.col(status)
    return df.agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "empty").alias("empty"), F.count_if(s.startswith("error")).alias("errors"))


def run_counts(fetched: DataFrame, combined: DataFrame, kept: DataFrame, before: DataFrame) -> DataFrame:
    """fetched, merged, dropped and new rows of a run, in a row."""
    n = lambda d, name: d.agg(F.count("*").alias(name))
    out = n(fetched, "fetched").crossJoin(n(combined, "merged")).crossJoin(n(kept, "kept")).crossJoin(n(before, "existing"))  # of single rows
    return out.select("fetched", "merged", (F.col("merged") - F.col("kept")).alias("dropped"), F.greatest(F.col("kept") - F.col("existing"), F.lit(0)).alias("new"))
