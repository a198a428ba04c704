"""Shared-folder tables that cut lineage, so a lost executor never forces a long recompute."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="courtfold-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def whole_number(name: str) -> Column:
    """A column as a long; null where it isn't a whole number in a long's range."""
    return F.col(name).try_cast("long")


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, by Spark's own compression or the one named, and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/courtfold-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def joined_by_size(texts: DataFrame, ids: DataFrame, on: Column, how: str = "left_semi") -> DataFrame:
    """A semi- or anti-join of texts with a saved table of ids: broadcast if it has at most BROADCAST_IDS rows (8 MB), else one exchange of the texts."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(ids.hint("broadcast" if small else "merge"), on, how)
