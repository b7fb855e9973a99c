"""Tables between the steps of a job: in the folder that all machines share, and gone when they have served."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders made by an application, and where a table read back was written
_MADE: dict[str, list[str]] = {}
_PATH: dict[int, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share (spark.checkpoint.dir); without one only in local mode, in a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/newsloom-shared"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts lineage through the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH[id(out)] = path
    weakref.finalize(out, _PATH.pop, id(out), None)
    return out


def removed(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    path = _PATH.pop(id(df), None)
    if path:
        _delete(df.sparkSession, path)
        _MADE[df.sparkSession.sparkContext.applicationId].remove(path)


def clear(spark: SparkSession) -> int:
    """Deletes all folders that this application made so far; to be called when the results that read them are written."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        _delete(spark, path)
    return len(made)


def name(wanted: str, taken: list[str]) -> str:
    """A column name that no column has."""
    while wanted.lower() in {t.lower() for t in taken}:
        wanted += "_"
    return wanted
