"""Growing tables as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import growth, storage


def first_writer(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the time that rows may be late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def append_new(path: str, key: str):
    """A foreachBatch function: appends the batch's rows whose key the table doesn't have; batches may be repeated."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if getattr(e, "getCondition", lambda: "")() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        fresh.write.mode("append").parquet(path)

    return put


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("one long, two long, bucket int, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_first(path: str, row_id: str = "row_id", keys: tuple[str, ...] = ("article_id", "article_url"), buckets: int = 256):
    """A foreachBatch function: appends the batch's rows that share no non-blank key with a row that was kept before, in this batch or an earlier one.

    The table (``appended`` reads it) holds the rows that ``growth.first_of_each`` would keep of all batches together, however they are cut, if row ids grow from batch to
    batch. Of older rows only hashes of keys are read (128 bits), from a table by bucket and batch, and only the buckets that the batch's keys fall
    into; a bucket of a batch is one file, whatever the number of tasks. A batch that is repeated, after a failure or a restart, replaces what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = storage.written(batch, "batch")
        blank = lambda k: F.nullif(F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))), F.lit(""))
        hashed = lambda k, i: F.when(blank(k).isNotNull(), F.struct(F.xxhash64(F.lit(i), blank(k)).alias("one"), F.xxhash64(blank(k), F.lit(~i)).alias("two")))
        each = F.explode(F.array_compact(F.array(*[hashed(k, i) for i, k in enumerate(keys)]))).alias("h")
        of = lambda d: d.select(F.col(row_id).alias("r"), each).select("r", "h.one", "h.two", F.pmod(F.col("h.one"), F.lit(buckets)).cast("int").alias("bucket"))
        nodes, older = of(rows), _known(spark, f"{path}/keys")
        left = rows
        if older is not None and number > 0:
            meet = [r["bucket"] for r in nodes.select("bucket").distinct().collect()]  # as many as there are buckets, at most
            older = older.where(F.col("bucket").isin(meet) & (F.col("batch") < number)).select("one", "two")
            left = rows.join(nodes.join(older, ["one", "two"], "left_semi").select(F.col("r").alias(row_id)), row_id, "left_anti")
        kept = storage.written(growth.first_of_each(left, row_id, keys), "kept")
        kept.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        of(kept).select("one", "two", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={number}")
        storage.removed(rows)
        storage.removed(kept)

    return put


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``append_first`` kept so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch")
