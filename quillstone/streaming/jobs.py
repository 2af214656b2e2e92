"""Structured Streaming jobs. Rows are kept by transaction time and late ones are never dropped, so no watermark cuts them off.

A source without files gives no rows; null times fall in no window; a batch that runs again, after a restart, writes over its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.sources.store import cut, shared_path


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches wrote; no rows if there was none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def bucket_counts(spark: SparkSession, path: str, schema: str, width: str = "1 day") -> DataFrame:
    """Counts of events by tumbling window and type over a stream of files: each micro-batch is pre-aggregated and appended, and the sums of all batches are read.
    A batch that runs again writes over its own part."""
    out = shared_path(spark)

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.window("ts", width).start.alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-marks").trigger(availableNow=True).start().awaitTermination()
    return _parts(spark, out, "bucket timestamp, event_type string, n long, total double").groupBy("bucket", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def sessions(spark: SparkSession, path: str, schema: str, gap: str = "30 minutes", files: int = 8) -> DataFrame:
    """Gap sessions of users over a stream of files. Each micro-batch appends the sessions of its own rows, so no state grows and no late row is dropped; sessions of several
    batches that meet are joined where they are read."""
    out = shared_path(spark)

    def add(batch: DataFrame, number: int) -> None:
        found = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
        found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-marks").trigger(availableNow=True).start().awaitTermination()
    own = Window.partitionBy("user_id").orderBy("start", "end")
    parts = _parts(spark, out, "user_id long, start timestamp, end timestamp, n long").withColumn("before", F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("before") >= F.col("start"), 0).otherwise(1)
    return parts.withColumn("nth", F.sum(opens).over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("nth")


def queue_pass(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a pass has still to do: rows without a marker."""
    return cut(queue.join(done.select(key), key, "left_anti"))
