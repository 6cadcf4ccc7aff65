"""What the operators of this subpackage share: reading, keys, scratch tables."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation rules.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as a string that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that name a row even where ids are null or repeated.

    ``rid`` is the id (0 for a null one) and ``rhash`` a hash of the text whose
    lowest bit says that the id is null, so rows that share an id but not a text
    stay apart. Rows equal in both get equal keys and hence equal results.
    """
    mark = F.when(F.col(id_col).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("rid"),
        F.xxhash64(whole_text(text_col)).bitwiseAND(F.lit(-2)).bitwiseOR(mark).alias("rhash"),
    ]


def row_id() -> Column:
    """The id that row_key() packed, null again where it was null."""
    return F.when(F.col("rhash").bitwiseAND(F.lit(1)) == 0, F.col("rid"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like *names* that *df* does not have (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
        taken.add(name.lower())
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and the master is local (tests on one
    machine) a temporary folder takes its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch *tables* that are no longer read."""
    for t in tables:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Give back disk: scratch *tables* no longer read, and shuffle files of finished queries.

    Spark's cleaner drops a query's shuffle files once nothing refers to the
    query; it learns of that from the garbage collector, a moment later.
    """
    discard(spark, *tables)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """*df* written as Parquet to the shared folder and read back.

    It cuts the lineage: a lost executor later costs a re-read, not a rerun.
    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
