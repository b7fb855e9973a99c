"""Reading and writing of article tables: CSV with whole texts, Parquet inside, caches and boundaries."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..operators import rules
from ..operators.growth import one_of_each

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, blanks as empty text; a missing file is an empty article table."""
    try:
        df = spark.read.options(**_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in V.ARTICLE_COLUMNS]))
    return df.na.fill("")


def write_rows(df: DataFrame, path: str) -> None:
    """The canonical columns, then the others in their order; the commit protocol makes it whole or nothing."""
    first = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in V.ARTICLE_COLUMNS]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in V.ARTICLE_COLUMNS]
    out = df.select(*first, *rest)
    out = out.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in out.columns])
    out.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def articles(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns."""
    return ensure(df, V.ARTICLE_COLUMNS).select(*V.ARTICLE_COLUMNS)


def write_by_source(df: DataFrame, path: str) -> None:
    articles(df).write.mode("overwrite").partitionBy("source").option("header", True).csv(path)


def ensure(df: DataFrame, names: list[str]) -> DataFrame:
    """With every named column, empty where it was missing."""
    return df.withColumns({c: F.lit("") for c in names if c not in df.columns})


def admin_last(df: DataFrame) -> DataFrame:
    """Without legacy columns, the five admin columns at the end."""
    df = ensure(df, V.ADMIN_COLUMNS)
    drop = [c for c in V.LEGACY_ADMIN_COLUMNS if c not in V.ADMIN_COLUMNS]
    keep = [c for c in df.columns if c not in (*V.ADMIN_COLUMNS, *drop)]
    return df.select(*[F.col(f"`{c}`") for c in (*keep, *V.ADMIN_COLUMNS)])


def with_cache(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries joined to cached answers (which may be null: known to have none), and those not in the cache. A query cached twice has its least answer."""
    rest = [c for c in cache.columns if c not in ("query", "iso2")]
    once = one_of_each(cache, ["query", "iso2"], rest) if rest else cache.distinct()
    known = queries.join(once, ["query", "iso2"], "left")
    return known, queries.join(once, ["query", "iso2"], "left_anti").select("query", "iso2").distinct()


def updated_cache(cache: DataFrame, answers: DataFrame, path: str) -> None:
    """Writes the cache with new answers (null latitudes too, so that they aren't asked again) to a fresh path; what was cached before wins."""
    fresh = answers.select(*cache.columns).join(cache, ["query", "iso2"], "left_anti")
    rest = [c for c in cache.columns if c not in ("query", "iso2")]
    cache.unionByName(one_of_each(fresh, ["query", "iso2"], rest)).write.mode("errorifexists").parquet(path)


def months_done(spark: SparkSession, store: str) -> list[dt.date]:
    """The months that a store has whole; a store that isn't there has none."""
    try:
        return sorted({r["month"] for r in spark.read.schema("month date").parquet(f"{store}/done").collect()})
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def months_added(fresh: DataFrame, store: str, months: list[dt.date]) -> DataFrame:
    """Rows of some months put into a store by month, and the rows of all months that it has whole.

    A month's partition is replaced as one, so that what a broken run left of it goes; only then is it listed as finished.
    """
    spark, columns = fresh.sparkSession, [c for c in fresh.columns if c != "month"]
    if months:
        fresh.select(*columns, "month").write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{store}/months")
        spark.createDataFrame([(m,) for m in months], "month date").coalesce(1).write.mode("append").parquet(f"{store}/done")
    done = months_done(spark, store)
    if not done:
        return fresh.limit(0)
    kept = spark.read.schema(fresh.select(*columns, "month").schema).parquet(f"{store}/months")
    return kept.where(F.col("month").isin(done)).select(*fresh.columns)


def boundaries(spark: SparkSession, path: str, iso3: str, level: int) -> DataFrame:
    """One country and level of boundaries stored by (iso3, level): other partitions aren't read."""
    return spark.read.parquet(path).where((F.col("iso3") == iso3) & (F.col("level") == level))


def run_sources(pages: DataFrame, names: list[str] | None = None, most: int = 50) -> tuple[DataFrame | None, dict[str, str]]:
    """Articles of all sources that come with the library, or some, in one table; a source that cannot be planned is left out and its reason told.

    pages: landed pages (url, html, status), listing pages of the sources' seeds among them.
    """
    out, failed = None, {}
    for name in names or rules.shipped():
        try:
            part = articles(rules.crawl(pages, rules.shipped_source(name), most))
        except Exception as e:  # noqa: BLE001  one source's failure is its own
            failed[name] = str(e)
            continue
        out = part if out is None else out.unionByName(part)
    return out, failed
