"""What the operators share: shared folder, names, key columns."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = os.path.join(tempfile.gettempdir(), "newsloom-shared")
#: Folders made so far, by session; a caller removes them when its results are written
_MADE: dict[str, list[str]] = {}
_PATH: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every machine sees. Without it a local one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{_OWN}"
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Deletes all intermediate folders made by this application so far; to be called when results that read them are written."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        remove(spark, path)
    return len(made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH[id(out)] = path
    weakref.finalize(out, _PATH.pop, id(out), None)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    path = _PATH.pop(id(df), None)
    if path:
        remove(df.sparkSession, path)


def redealt(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, of whose partitioning by integer columns Spark no longer knows: a join then deals both sides anew, which
    lets the adaptive planner split the rows of a key that has many."""
    return df.withColumns({c: F.col(c).bitwiseXOR(F.lit(0).cast(dict(df.dtypes)[c])) for c in columns})


def fetched(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded result as arrays on the driver, through Arrow."""
    table = df.toArrow()
    return {n: table[n].to_numpy() for n in table.column_names}


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that isn't taken (Spark's names ignore case)."""
    low = {t.lower() for t in taken}
    return next(n for n in itertools.chain([f"_{name}"], (f"_{name}{i}" for i in itertools.count())) if n.lower() not in low)


def crc32_of(key: str) -> Column:
    """crc32 of a key written as text; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
