"""Tables and files: the shared folder, snapshots, text vaults, attachments."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text


def shared_path(spark: SparkSession) -> str:
    """A new place under spark.checkpoint.dir; where that is unset, a local one for local sessions, and an error on a cluster, whose other machines wouldn't see it."""
    base, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/quillstone-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that plans stay short and lost executors cost nothing."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the plans that are done: their broadcasts, shuffle files and what the driver keeps of them go when its garbage is collected, which it does late by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def keep_newest(spark: SparkSession, path: str, n: int) -> list[str]:
    """Of the snapshot folders in path, by name, all but the newest n go: what went. Names sort by time."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(hadoop) if x.isDirectory())
    old = names[: max(0, len(names) - n)]
    for name in old:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return old


def append(df: DataFrame, path: str) -> None:
    """An append-only sink: revisions, audit events."""
    df.write.mode("append").parquet(path)


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


#: Characters of a text that tell whether it is binary, and the share of broken ones from which it is.
SAMPLE, BROKEN = 4096, 0.05


def _utf16(units: Column, low_first: bool) -> Column:
    """Bytes after the mark as UTF-16, never failing: surrogates without their other half, and a last odd byte, become U+FFFD."""
    digits = F.hex(units)
    one = r"(..)(..)"
    ordered = F.regexp_replace(digits, one, "$2$1") if low_first else digits  # four hexadecimal digits a unit, the high byte first
    odd = F.length(digits) % 4 == 2
    whole = F.when(odd, F.substring(ordered, F.lit(1), F.length(ordered) - 2)).otherwise(ordered)
    high, low = r"D[89AB][0-9A-F]{2}", r"D[CDEF][0-9A-F]{2}"
    # units are told apart by a blank after each; a half is lone if its other half isn't beside it
    spaced = F.regexp_replace(whole, r"(....)", "$1 ")
    mended = F.regexp_replace(F.regexp_replace(spaced, rf"{high} (?!{low} )", "FFFD "), rf"(?<!{high} ){low} ", "FFFD ")
    text = F.decode(F.unhex(F.replace(mended, F.lit(" "), F.lit(""))), "UTF-16BE")
    return F.when(odd, F.concat(text, F.lit("\ufffd"))).otherwise(text)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 where a byte order mark says so, else UTF-8; without the mark. What isn't well formed becomes U+FFFD; no bytes make it fail."""
    mark = F.hex(F.substring(content, 1, 3))
    rest = F.substring(content, 3, F.octet_length(content))
    wide = F.when(mark.startswith("FFFE"), _utf16(rest, True)).when(mark.startswith("FEFF"), _utf16(rest, False))
    body = F.when(mark == "EFBBBF", F.substring(content, 4, F.octet_length(content))).otherwise(content)
    return F.coalesce(wide, F.make_valid_utf8(body.cast("string")))


def looks_binary(text: Column) -> Column:
    """A NUL, or over one U+FFFD in twenty, among the first SAMPLE characters."""
    sample = F.substring(text, 1, SAMPLE)
    bad = F.length(sample) - F.length(F.replace(sample, F.lit("\ufffd"), F.lit("")))
    return F.contains(sample, F.lit("\0")) | (bad > BROKEN * F.length(sample))


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows: path, size, sha256, text (null where it is binary), status. Empty files have no row, as the reader passes them over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("body", decoded(F.col("content")))
    binary, html = looks_binary(F.col("body")), F.col("path").rlike(r"(?i)\.html?$")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(~binary, F.when(html, text.html_text(F.col("body"))).otherwise(F.col("body"))).alias("text"), F.when(binary, "unsupported").otherwise("extracted").alias("status"))


def write_vault(docs: DataFrame, path: str) -> None:
    """Markdown with front matter, partitioned by project: docs (project_id, title, tags, body)."""
    head = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct("title")), F.lit("\ntags: "), F.to_json("tags"), F.lit("\n---\n"))
    docs.select(text.path_segment(F.coalesce("project_id", F.lit("shared"))).alias("project"), F.concat(head, "body").alias("value")).write.mode("overwrite").partitionBy("project").option("lineSep", "\n\0\n").text(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
