"""Keyed state with expiry over a stream: the latest value of each key, held until it expires.

A row (key, value, at) counts until ``at + ttl``, or until a later one of its key (later by time, then by value) takes its place. Each batch is merged with the state as the batch before left it, by joins alone: no
call is made for a key. State is one row a key and goes when ``ttl`` has passed by the watermark, the latest time of the batches before less ttl, so it grows with the keys alive and not with the stream. A row
that comes too late for the watermark has expired by the latest time seen, so dropping it changes nothing, and the order and the batches in which rows come don't either. Null keys are a key; rows without a time
are left out; repeated rows count once.

What a batch changes, and the state after it, are written to folders of their own in the shared folder; a batch that runs again, after a restart from the checkpoint, reads the state of the batch before it and
writes over its own. States older than the last two go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.store import cut, drop
from quillstone.streaming.jobs import _parts

CHANGE = "key string, value string, at timestamp, gone boolean"
STATE = "key string, value string, at timestamp"


def merged(held: DataFrame, batch: DataFrame, before: int | None, now: int | None, ttl_s: float) -> DataFrame:
    """key, value, at, changed, gone: the state after a batch of rows (key, value, at). before, now: the watermarks under which the batch came and went (microseconds, or null)."""
    micros = int(ttl_s * 1e6)
    late = F.coalesce(F.unix_micros("at") < F.lit(before).cast("long"), F.lit(False))
    order = F.struct("at", F.col("value").isNotNull().alias("there"), "value")
    new = batch.filter(F.col("at").isNotNull() & ~late).select("key", order.alias("r"), F.lit(True).alias("new"))
    both = new.unionByName(held.select("key", order.alias("r"), F.lit(False).alias("new")))
    best = both.groupBy("key").agg(F.max("r").alias("r"), F.max(F.when(~F.col("new"), F.col("r"))).alias("old"))
    gone = F.coalesce(F.unix_micros("r.at") + micros <= F.lit(now).cast("long"), F.lit(False))
    return best.select("key", "r.value", "r.at", (~F.col("r").eqNullSafe(F.col("old"))).alias("changed"), gone.alias("gone"))


def keep_state(spark: SparkSession, stream: DataFrame, path: str, ttl_s: float) -> list[int]:
    """Runs the stream over what is there and stops: changes go to path, batch by batch; run again, it goes on from its checkpoint. How many rows of state there were after each batch."""
    sizes = []

    def put(batch: DataFrame, number: int) -> None:
        micros = int(ttl_s * 1e6)
        held = _parts(spark, f"{path}/state/{number - 1}", STATE)
        marks = _parts(spark, f"{path}/latest/{number - 1}", "latest long").first()
        rows = cut(batch.select("key", "value", "at"))  # read once
        seen = rows.agg(F.max(F.unix_micros("at")).alias("latest")).first()["latest"]
        before = marks["latest"] if marks else None
        latest = max((x for x in (seen, before) if x is not None), default=None)
        mark = lambda x: None if x is None else x - micros
        after = cut(merged(held, rows, mark(before), mark(latest), ttl_s))
        changes = after.filter("changed").withColumn("gone", F.lit(False)).unionByName(after.filter("gone"))
        changes.select("key", "value", "at", "gone", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/changes/part={number}")
        after.filter("NOT gone").select("key", "value", "at").write.mode("overwrite").parquet(f"{path}/state/{number}")
        spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{path}/latest/{number}")
        for old in ("state", "latest"):
            drop(spark, f"{path}/{old}/{number - 2}")
        sizes.append(after.filter("NOT gone").count())

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    return sizes


def current(spark: SparkSession, path: str, now, ttl_s: float) -> DataFrame:
    """key, value, at of the keys alive at now: the last change of each, if its time isn't over."""
    changes = _parts(spark, f"{path}/changes", f"{CHANGE}, batch int, part int")
    last = changes.filter("NOT gone").groupBy("key").agg(F.max_by(F.struct("value", "at"), F.struct("at", "batch")).alias("r")).select("key", "r.*")
    return last.filter(F.unix_micros("at") + int(ttl_s * 1e6) > F.unix_micros(now))
