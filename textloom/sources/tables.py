"""Text tables and folders."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", format: str = "parquet", **options) -> DataFrame:
    """A table of any Spark format as (doc_id, text) and its other columns."""
    df = spark.read.format(format).options(**options).load(path)
    return df.withColumnsRenamed({id_col: "doc_id", text_col: "text"})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    Where the session names none, a temporary folder takes its place on a local
    master; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


class Folder:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.path)))

    def read_json(self, name: str) -> dict:
        text = self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]
        return json.loads(text)

    def write_json(self, name: str, value: dict) -> bool:
        """Write by renaming a finished file; False if *name* is already there.

        The rename never overwrites (it is atomic where the file system's is).
        """
        from py4j.protocol import Py4JJavaError

        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        temp, final = self._path(f"{self.path}/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(temp), self._fs.makeQualified(final), keep)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if not self._fs.exists(final):
                raise e
            return False
        return True

    def age_seconds(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.path}/{name}")).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
