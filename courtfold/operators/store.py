"""Tables in the shared folder: steps kept once, and partitions replaced all at once by versions that a manifest names."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="courtfold-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there, so that what is used again isn't computed again, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/courtfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that is an exchange of both sides: kept files of ids and names are small enough to be broadcast long after the driver can't hold several of them."""
    return rows.hint("merge")


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        return bytes(self.spark.read.format("binaryFile").load(f"{self.path}/{name}").first().content).decode()

    def create(self, name: str, text: str) -> None:
        """Write a file whole under a name that must be new: it is renamed to it, which fails if another writer was first."""
        part = self.at(f"_{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(part, self.at(name)):
            self.fs.delete(part, False)
            raise ValueError(f"{self.path}/{name} is there already: another writer has published")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


MANIFEST = "manifest-"


def _manifest(folder: Folder) -> tuple[int, dict[str, str]]:
    names = [n for n in folder.names() if n.startswith(MANIFEST)]
    return (int(names[-1][len(MANIFEST) :]), json.loads(folder.read(names[-1]))) if names else (0, {})


def _partitions(folder: Folder, version: str, depth: int) -> list[str]:
    """Paths of the partitions that a version wrote, as the writer left them; nothing is computed again to find them."""
    found = [""]
    for _ in range(depth):
        found = [f"{p}{n}/" for p in found for n in folder.names(f"{version}/{p}") if "=" in n]
    return [p.rstrip("/") for p in found]


def publish(df: DataFrame, path: str, by: list[str], rebuilt: list[tuple] = ()) -> None:
    """Replace the partitions (by the columns `by`) that df holds, and take away those of `rebuilt` that it doesn't; the others stay.

    df is written to a folder of its own. A manifest that names the folder of each partition is then added under the next number, in one step: readers see the
    old rows or the new ones, a writer that fails before it changes nothing, and of two writers that began with one manifest the second fails.
    """
    folder = Folder(df.sparkSession, path)
    number, current = _manifest(folder)
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{folder.path}/{version}")
    gone = {"/".join(f"{c}={v}" for c, v in zip(by, values)) for values in rebuilt}
    after = {p: v for p, v in current.items() if p not in gone} | {p: version for p in _partitions(folder, version, len(by))}
    folder.create(f"{MANIFEST}{number + 1:09d}", json.dumps(after))


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that the latest manifest names, by a schema that includes the partition columns; none if nothing is published."""
    folder = Folder(spark, path)
    current = _manifest(folder)[1]
    out = None
    for version in sorted(set(current.values())):
        own = [f"{folder.path}/{version}/{p}" for p, v in sorted(current.items()) if v == version]
        part = spark.read.schema(schema).option("basePath", f"{folder.path}/{version}").parquet(*own)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(spark: SparkSession, path: str) -> int:
    """Delete versions and manifests that the latest manifest doesn't need, and what failed writers left; returns how many. Only while nobody writes or reads old ones."""
    folder = Folder(spark, path)
    number, current = _manifest(folder)
    old = [n for n in folder.names() if n.startswith("_") or (n.startswith("v-") and n not in current.values()) or (n.startswith(MANIFEST) and int(n[len(MANIFEST) :]) < number)]
    for n in old:
        folder.delete(n)
    return len(old)
