"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters to lower, all other bytes stay.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The white space that the corpus operators strip and split at: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a local session takes a local one; a cluster's files would be
    lost to the other machines, so there it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_quillstone_dir", None) or tempfile.mkdtemp(prefix="spark-")
        spark._quillstone_dir = base
    return f"{base.rstrip('/')}/quillstone-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, **options: object) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of shared_table() from the shared folder. What was made of them must have been written itself, so that nothing reads them again, not even for a lost executor."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns: a 128-bit key that is never null. Rows that are equal in the columns share it."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]
    return [F.xxhash64(F.lit(1), *marked).alias("k1"), F.xxhash64(F.lit(2), *marked).alias("k2")]
