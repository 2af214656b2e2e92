"""Keyed state with expiry: batches, late and repeated rows, restarts, and its size."""

import random

from pyspark.sql import functions as F

from quillstone.streaming import state

ROWS = "key string, value string, at timestamp"


def put(spark, rows, path):
    spark.createDataFrame(rows, "key string, value string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, ttl_s):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    return state.keep_state(spark, stream, f"{tmp}/out", ttl_s)


def alive(rows, now, ttl_days):
    best = {}
    for key, value, at in rows:
        if at is not None and (key not in best or (at, value is not None, value or "") > best[key]):
            best[key] = (at, value is not None, value or "")
    return {(k, v if there else None) for k, (at, there, v) in best.items() if int(at[8:10]) + ttl_days > now}


def test_replays_are_the_batch_rule(spark, tmp_path):
    """Rows of all times in all batches, repeated ones, null keys, values and times; the driver restarts after every batch."""
    r, rows, sizes = random.Random(5), [], []
    for batch in range(4):
        new = [(r.choice(["a", "b", "c", None, "d"]), r.choice(["x", "y", None, "z"]), r.choice([None, *[f"2024-01-{d:02} 00:00:00" for d in range(1 + 6 * batch, 8 + 6 * batch)], "2024-01-01 00:00:00"])) for _ in range(12)]
        rows += new + [new[0]]
        put(spark, new + [new[0]], f"{tmp_path}/in")
        sizes += run(spark, tmp_path, 3 * 86_400)
    now = F.lit("2024-01-26").cast("timestamp")
    got = {(x.key, x.value) for x in state.current(spark, f"{tmp_path}/out", now, 3 * 86_400).collect()}
    assert got == alive(rows, 26, 3)
    assert run(spark, tmp_path, 3 * 86_400) in ([], [sizes[-1]])  # nothing new, nothing read again


def test_state_falls_after_expiry(spark, tmp_path):
    put(spark, [(f"k{i}", "v", "2024-01-01 00:00:00") for i in range(50)], f"{tmp_path}/in")
    first = run(spark, tmp_path, 86_400)
    put(spark, [("late", "v", "2024-01-09 00:00:00")], f"{tmp_path}/in")
    second = run(spark, tmp_path, 86_400)
    assert max(first) >= 50 and second[-1] <= 2
    assert [x.key for x in state.current(spark, f"{tmp_path}/out", F.lit("2024-01-09 12:00:00").cast("timestamp"), 86_400).collect()] == ["late"]


def test_batches_merge_without_a_call_for_a_key(spark):
    """State and batch meet in joins and aggregates alone; ties, late rows, expiry and what didn't change by hand."""
    frame = lambda rows: spark.createDataFrame(rows, "key string, value string, at string").withColumn("at", F.col("at").cast("timestamp"))
    day = lambda d: f"2024-01-{d:02} 00:00:00"
    micros = lambda d: 1_704_067_200_000_000 + (d - 1) * 86_400_000_000
    held = frame([("same", "v", day(6)), ("old", "v", day(3)), ("tie", "a", day(6)), (None, "v", day(6))])
    batch = frame([("same", "v", day(6)), ("same", "u", day(5)), ("tie", "b", day(6)), ("tie", None, day(6)), ("late", "v", day(1)), ("new", None, day(8)), (None, "w", day(7)), ("none", "v", None)])
    out = state.merged(held, batch, micros(2), micros(6), 2 * 86_400)
    assert {(r.key, r.value, r.changed, r.gone) for r in out.collect()} == {("same", "v", False, False), ("old", "v", False, True), ("tie", "b", True, False), ("new", None, True, False), (None, "w", True, False)}
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
