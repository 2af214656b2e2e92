"""The domain's tables, derived from the given ones. DOMAIN is the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOW = "2024-03-15 00:00:00"
AT = "2024-01-20 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def at() -> Column:
    return F.lit(AT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each event; the next event of the user and type supersedes it."""
    e, i = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        i.alias("fact_id"),
        F.concat_ws(" ", "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("item"), F.regexp_extract("props", "([0-9]+)", 1)).alias("content"),
        F.when(i % 23 != 0, F.col("event_type")).alias("category"),
        F.col("user_id").alias("entity_id"),
        F.col("ts").alias("valid_from"),
        F.lead("ts").over(own).alias("valid_to"),
        F.col("ts").alias("recorded_at"),
        F.when(i % 17 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("deleted_at"),
        F.when(i % 19 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("pruned_at"),
        ((i % 50 + 50) / 100.0).alias("confidence"),
        ((i * 7 % 100) / 100.0).alias("importance"),
        (i % 13).alias("reference_count"),
        F.lag("event_id").over(own).alias("supersedes_id"),
        F.when(i % 11 == 0, F.array(i - 1, i - 2)).alias("merged_from"),
        F.when(i % 3 != 0, F.concat(F.lit("p"), (i % 4).cast("string"))).alias("project_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("user_id"),
        F.when(i % 5 != 0, F.concat(F.lit("a"), (i % 7).cast("string"))).alias("agent_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
    )


def with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str = "fact_id") -> DataFrame:
    """rows with a vector each, by key modulo the number of vectors. The vector table stays whole and is joined by its key."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.withColumn("vec_id", F.col(key) % F.lit(v.count())).join(v, "vec_id").drop("vec_id")


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of each user's value by type, as intervals."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("pref_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("value"), F.col("ts").alias("valid_from"), F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("valid_to"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).alias("project_id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("obs_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("content"), F.col("ts").alias("recorded_at"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each turn of a conversation."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("episode_id"), F.col("turn").alias("position"), "role", "text")


def relates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer to nation and supplier to nation."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    edge = lambda kind, key, nation: [F.concat(F.lit(kind), F.col(key).cast("string")).alias("src"), F.concat(F.lit("n"), F.col(nation).cast("string")).alias("dst")]
    return c.select(*edge("c", "c_custkey", "c_nationkey")).unionByName(s.select(*edge("s", "s_suppkey", "s_nationkey")))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact_id, entity): the user and the item that a fact names; some facts name none."""
    e = table(spark, sf_dir, "events")
    item = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    user = e.filter("event_id % 29 <> 0").select(F.col("event_id").alias("fact_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"))
    return user.unionByName(e.filter(item % 2 == 0).select(F.col("event_id").alias("fact_id"), F.concat(F.lit("item:"), item.cast("string")).alias("entity")))


def since(seconds: Column) -> Column:
    """So many seconds after the start of 2024."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + seconds)


def named(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(F.count("*").alias("turns")), F.col("episode_id")
    return c.select("episode_id", "turns", F.when(i % 5 != 0, named("a", i % 7)).alias("agent_id"), named("s", i % 20).alias("session_id"), F.when(i % 3 != 0, named("p", i % 4)).alias("project_id"), named("u", i % 10).alias("user_id"), since(i * 3600).alias("recorded_at"), F.when(i % 4 == 0, "provisional").otherwise("full").alias("summary_kind"))


DOMAIN = f"""
WITH RECURSIVE facts AS (
  SELECT event_id AS fact_id, concat_ws(' ', event_type, 'user', CAST(user_id AS VARCHAR), 'item', regexp_extract(props, '([0-9]+)', 1)) AS content,
    CASE WHEN event_id % 23 <> 0 THEN event_type END AS category, user_id AS entity_id, ts AS valid_from,
    lead(ts) OVER own AS valid_to, ts AS recorded_at,
    CASE WHEN event_id % 17 = 0 THEN ts + INTERVAL 1 DAY END AS deleted_at, CASE WHEN event_id % 19 = 0 THEN ts + INTERVAL 2 DAY END AS pruned_at,
    (event_id % 50 + 50) / 100.0::DOUBLE AS confidence, (event_id * 7 % 100) / 100.0::DOUBLE AS importance, event_id % 13 AS reference_count,
    lag(event_id) OVER own AS supersedes_id, CASE WHEN event_id % 11 = 0 THEN [event_id - 1, event_id - 2] END AS merged_from,
    CASE WHEN event_id % 3 <> 0 THEN 'p' || (event_id % 4) END AS project_id, 'u' || (user_id % 10) AS user_id,
    CASE WHEN event_id % 5 <> 0 THEN 'a' || (event_id % 7) END AS agent_id, 's' || user_id AS session_id
  FROM events WINDOW own AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
fact_vectors AS (SELECT f.*, CAST(embedding AS DOUBLE[]) AS embedding FROM facts f JOIN embeddings v ON f.fact_id % (SELECT count(*) FROM embeddings) = v.vec_id),
preferences AS (SELECT event_id AS pref_id, concat_ws(':', CAST(user_id AS VARCHAR), event_type) AS key, value, ts AS valid_from,
    lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to, CASE WHEN event_id % 3 <> 0 THEN 'p' || (event_id % 4) END AS project_id FROM events),
observations AS (SELECT event_id AS obs_id, 's' || user_id AS session_id, concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS content, ts AS recorded_at, ts + INTERVAL 7 DAY AS expires_at FROM events),
chunks AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS episode_id, turn AS position, role, text FROM conversations),
relates AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
mentions AS (SELECT event_id AS fact_id, 'user:' || user_id AS entity FROM events WHERE event_id % 29 <> 0 UNION ALL SELECT event_id, 'item:' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0),
episodes AS (SELECT conv_id AS episode_id, count(*) AS turns, CASE WHEN conv_id % 5 <> 0 THEN 'a' || (conv_id % 7) END AS agent_id, 's' || (conv_id % 20) AS session_id, CASE WHEN conv_id % 3 <> 0 THEN 'p' || (conv_id % 4) END AS project_id,
    'u' || (conv_id % 10) AS user_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600) AS recorded_at, CASE WHEN conv_id % 4 = 0 THEN 'provisional' ELSE 'full' END AS summary_kind FROM conversations GROUP BY conv_id),
params AS (SELECT TIMESTAMP '{NOW}' AS t_now, TIMESTAMP '{AT}' AS t_at)
"""
