"""Introspection: counts, buckets, histograms, ledgers, searches, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scoring, temporal, text
from quillstone.operators import lifecycle
from quillstone.plans.registry import query
from quillstone.sources import derive as D
from quillstone.sources import store


@query("SELECT 'fact' AS kind, count(*) AS n FROM facts UNION ALL SELECT 'preference', count(*) FROM preferences UNION ALL SELECT 'observation', count(*) FROM observations UNION ALL SELECT 'chunk', count(*) FROM chunks UNION ALL SELECT 'document', count(*) FROM documents")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"fact": D.facts(spark, sf_dir).select("fact_id"), "preference": D.preferences(spark, sf_dir), "observation": D.observations(spark, sf_dir), "chunk": D.chunks(spark, sf_dir), "document": D.table(spark, sf_dir, "documents")}
    out = None
    for kind, df in kinds.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


LIFE = "CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN pruned_at IS NOT NULL THEN 'pruned' WHEN valid_to IS NOT NULL THEN 'superseded' ELSE 'active' END"


@query(f"SELECT {LIFE} AS state, count(*) AS n FROM facts GROUP BY 1")
def fact_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("pruned_at").isNotNull(), "pruned").when(F.col("valid_to").isNotNull(), "superseded").otherwise("active")
    return D.facts(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE expires_at > t_at) AS active, count(*) FILTER (WHERE expires_at <= t_at) AS expired FROM observations, params")
def observation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observations(spark, sf_dir).agg(F.count_if(F.col("expires_at") > D.at()).alias("active"), F.count_if(F.col("expires_at") <= D.at()).alias("expired"))


@query("SELECT coalesce(category, 'uncategorized') AS category, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM facts GROUP BY category")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facts(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance")).withColumn("category", F.coalesce("category", F.lit("uncategorized")))


@query("SELECT kind, strftime(bucket, '%Y-%m-%d %H') AS bucket, count(*) AS n FROM (SELECT 'fact' AS kind, date_trunc('day', recorded_at) AS bucket FROM facts UNION ALL SELECT 'preference', date_trunc('hour', valid_from) FROM preferences), params WHERE bucket >= TIMESTAMP '2024-01-05' GROUP BY kind, bucket")
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.facts(spark, sf_dir).select(F.lit("fact").alias("kind"), F.date_trunc("day", "recorded_at").alias("bucket"))
    b = D.preferences(spark, sf_dir).select(F.lit("preference").alias("kind"), F.date_trunc("hour", "valid_from").alias("bucket"))
    return a.unionByName(b).filter("bucket >= TIMESTAMP '2024-01-05'").groupBy("kind", F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT entity_id, count(*) AS n FROM facts WHERE valid_to IS NULL AND deleted_at IS NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, entity_id LIMIT 20")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facts(spark, sf_dir).filter(F.col("valid_to").isNull() & temporal.visible()).groupBy("entity_id").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.col("n").desc(), "entity_id").limit(20)


@query("SELECT entity_id, CAST(sum(reference_count) AS BIGINT) AS refs, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(greatest(0, max(importance) - 0.1), 6) AS importance, epoch_us(min(valid_from)) AS since, count(DISTINCT category) AS categories FROM facts GROUP BY 1")
def merge_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge of an entity's facts takes from them."""
    return D.facts(spark, sf_dir).groupBy("entity_id").agg(F.sum("reference_count").alias("refs"), F.round(F.min("confidence"), 6).alias("least"), F.round(F.max("confidence"), 6).alias("most"), F.round(F.greatest(F.lit(0.0), F.max("importance") - 0.1), 6).alias("importance"), F.unix_micros(F.min("valid_from")).alias("since"), F.size(F.collect_set("category")).cast("long").alias("categories"))


RET = "exp(-d / ((1 + 2 * reference_count) * (1 + 4 * importance)))"


@query(f"SELECT CAST(least(9, floor(r * 10)) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (WHERE importance >= 0.75) AS exempt, count(*) FILTER (WHERE d < 30) AS within_window, count(*) FILTER (WHERE importance < 0.75 AND d >= 30 AND r < 0.05) AS prunable FROM (SELECT *, {RET} AS r FROM (SELECT *, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 AS d FROM facts, params WHERE deleted_at IS NULL AND valid_to IS NULL)) GROUP BY 1")
def retention_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = temporal.days_since(F.col("recorded_at"), D.now())
    rows = D.facts(spark, sf_dir).filter(temporal.visible() & F.col("valid_to").isNull()).withColumn("d", d).withColumn("r", scoring.retention(F.col("d"), F.col("reference_count"), F.col("importance")))
    return rows.groupBy(F.least(F.lit(9), F.floor(F.col("r") * 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.expr("importance >= 0.75")).alias("exempt"), F.count_if(F.expr("d < 30")).alias("within_window"), F.count_if(F.expr("importance < 0.75 AND d >= 30 AND r < 0.05")).alias("prunable"))


@query(f"SELECT fact_id, round({RET}, 6) AS retention FROM (SELECT *, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 AS d FROM facts, params WHERE deleted_at IS NULL AND importance < 0.75) ORDER BY round({RET}, 9), fact_id LIMIT 50")
def at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.retention(temporal.days_since(F.col("recorded_at"), D.now()), F.col("reference_count"), F.col("importance"))
    return D.facts(spark, sf_dir).filter(temporal.visible() & (F.col("importance") < 0.75)).withColumn("r", F.round(r, 9)).orderBy("r", "fact_id").limit(50).select("fact_id", F.round("r", 6).alias("retention"))


@query("SELECT fact_id FROM (SELECT fact_id, row_number() OVER (ORDER BY fact_id) - 1 AS i, count(*) OVER () AS n FROM facts) WHERE i % CAST(ceil(n / 500.0) AS BIGINT) = 0")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ceil(n/500)-th fact in order of id: rows are dealt by ranges of ids, numbered in their part, and moved by the counts of the parts before, one row a part."""
    f = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = store.cut(f.repartitionByRange(parts, "fact_id").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as parts
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("fact_id")) - 1).join(F.broadcast(before), "part")
    return placed.filter((F.col("before") + F.col("nth")) % F.ceil(F.col("total") / 500.0) == 0).select("fact_id")


@query("SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY k DESC, id) AS nth FROM (SELECT 'fact' AS kind, fact_id AS id, importance AS k FROM facts UNION ALL SELECT 'document', doc_id, n_chars FROM documents UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer)) WHERE nth <= 33")
def balanced_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal share of 99 nodes for each kind, by the kind's own order."""
    pick = lambda df, kind, key, by: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(by).cast("double").alias("k"))
    rows = pick(D.facts(spark, sf_dir), "fact", "fact_id", "importance").unionByName(pick(D.table(spark, sf_dir, "documents"), "document", "doc_id", "n_chars")).unionByName(pick(D.table(spark, sf_dir, "customer"), "customer", "c_custkey", "c_acctbal"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("k").desc(), "id"))).filter("nth <= 33").select("kind", "id")


@query("SELECT fact_id, importance FROM facts WHERE category = 'click' AND contains(lower(content), 'user 1') ORDER BY importance DESC, fact_id LIMIT 25 OFFSET 10")
def facts_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facts(spark, sf_dir).filter((F.col("category") == "click") & F.lower("content").contains("user 1")).orderBy(F.col("importance").desc(), "fact_id").offset(10).limit(25).select("fact_id", "importance")


@query("SELECT doc_id, lower(left(text, 20)) AS title FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' ORDER BY title, doc_id LIMIT 25", plain=True)
def documents_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").filter(F.lower("text").contains("the") & (F.col("lang") == "en"))
    return d.select("doc_id", F.lower(F.left("text", F.lit(20))).alias("title")).orderBy("title", "doc_id").limit(25)


@query("SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer WHERE contains(lower(c_name), '00001') UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001')) ORDER BY label, kind, id LIMIT 30", plain=True)
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over kinds, merged into one order."""
    find = lambda t, kind, key, name: D.table(spark, sf_dir, t).filter(F.lower(name).contains("00001")).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("label"))
    return find("customer", "customer", "c_custkey", "c_name").unionByName(find("supplier", "supplier", "s_suppkey", "s_name")).orderBy("label", "kind", "id").limit(30)


@query("SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500", plain=True)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").filter("event_id > 100").orderBy("event_id").limit(500).select("event_id")


@query("SELECT fact_id, content FROM facts WHERE fact_id IN (3, 5, 8, 13, 9999999)")
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a given list of ids, which reaches the scan as a filter."""
    return D.facts(spark, sf_dir).filter(F.col("fact_id").isin(3, 5, 8, 13, 9_999_999)).select("fact_id", "content")


@query("SELECT lower(trim(role)) AS name, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS members FROM conversations GROUP BY 1 HAVING count(*) > 1", plain=True)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "conversations").groupBy(text.normal_name(F.col("role")).alias("name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("members")).filter("n > 1")


@query("SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM facts WHERE supersedes_id IS NOT NULL) AS supersedes, (SELECT count(DISTINCT entity_id) FROM facts) AS entities, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM relates) AS edges")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir).agg(F.count("*").alias("facts"), F.count("supersedes_id").alias("supersedes"), F.count_distinct("entity_id").alias("entities"))
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    return f.crossJoin(one(D.table(spark, sf_dir, "documents"), "documents")).crossJoin(one(D.relates(spark, sf_dir), "edges"))  # single rows


@query("SELECT episode_id, string_agg(text, chr(10) ORDER BY position) AS transcript, count(*) AS n FROM chunks GROUP BY 1")
def reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text"))), lambda x: x.text)
    return D.chunks(spark, sf_dir).groupBy("episode_id").agg(F.array_join(parts, "\n").alias("transcript"), F.count("*").alias("n"))


@query("SELECT chunk_id, next_id FROM (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY episode_id ORDER BY position) AS next_id FROM chunks) WHERE next_id IS NOT NULL")
def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunks(spark, sf_dir).withColumn("next_id", F.lead("chunk_id").over(Window.partitionBy("episode_id").orderBy("position"))).filter("next_id IS NOT NULL").select("chunk_id", "next_id")


@query("SELECT key, pref_id AS latest FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC, pref_id DESC) AS nth FROM preferences) WHERE nth = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(D.preferences(spark, sf_dir), ["key"], [F.col("valid_from").desc(), F.col("pref_id").desc()]).select("key", F.col("pref_id").alias("latest"))


#: What follows an ampersand, as in functions.text.entities: named ones first, then numbers; others as they are.
ENTITY = """CASE WHEN regexp_matches(x, '^(?i)(amp|lt|gt|quot|apos|nbsp);') THEN map {'amp': '&', 'lt': '<', 'gt': '>', 'quot': chr(34), 'apos': chr(39), 'nbsp': ' '}[lower(regexp_extract(x, '^([A-Za-z]+);', 1))] || regexp_replace(x, '^[A-Za-z]+;', '')
WHEN regexp_matches(x, '^#[0-9]{1,7};') THEN chr(CAST(regexp_extract(x, '^#([0-9]+);', 1) AS INT)) || regexp_replace(x, '^#[0-9]+;', '')
WHEN regexp_matches(x, '^#[xX][0-9A-Fa-f]{1,5};') THEN chr(CAST('0x' || regexp_extract(x, '^#[xX]([0-9A-Fa-f]+);', 1) AS INT)) || regexp_replace(x, '^#[xX][0-9A-Fa-f]+;', '') ELSE '&' || x END"""


@query(rf"""WITH s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&') AS p FROM (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN '&#8217;s &#x27;' WHEN 1 THEN ' a&apos;b &bogus; &amp;lt;' ELSE '' END AS html FROM pages))
SELECT page_id, trim(regexp_replace(p[1] || array_to_string(list_transform(p[2:], lambda x: {ENTITY}), ''), '[\s\x{{a0}}]+', ' ', 'g')) AS text FROM s""", plain=True)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text, with entities of every form put at the end of some."""
    more = F.when(F.col("page_id") % 4 == 0, "&#8217;s &#x27;").when(F.col("page_id") % 4 == 1, " a&apos;b &bogus; &amp;lt;").otherwise("")
    return D.table(spark, sf_dir, "pages").select("page_id", text.html_text(F.concat("html", more)).alias("text"))


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS short,
regexp_replace(lower(trim(text)), '\\s+', '_', 'g') AS predicate, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(left(text, 100), '\\s+\\S*\\z', '') END AS clipped, sha256(text) AS content_hash FROM documents""", plain=True)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return D.table(spark, sf_dir, "documents").select("doc_id", text.approx_tokens(t).alias("tokens"), text.truncate(t, 40).alias("short"), text.predicate(t).alias("predicate"), text.clip(t, 100).alias("clipped"), F.sha2(t.cast("binary"), 256).alias("content_hash"))


@query("SELECT event_id AS job_id, epoch_us(CASE WHEN n < 5 THEN ts + CAST(least(21600, 60 * pow(2, n)) AS BIGINT) * INTERVAL 1 SECOND END) AS next_at, n >= 5 AS dead FROM (SELECT *, event_id % 8 AS n FROM events)", plain=True)
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").withColumns({"n": F.col("event_id") % 8, "ts": F.col("ts").cast("timestamp")})
    return e.select(F.col("event_id").alias("job_id"), F.unix_micros(scoring.next_retry(F.col("n"), F.col("ts"), 5)).alias("next_at"), (F.col("n") >= 5).alias("dead"))


@query("SELECT event_id FROM events WHERE event_id % 8 < 5 AND event_id % 3 <> 0 AND ts + CAST(least(21600, 60 * pow(2, event_id % 8)) AS BIGINT) * INTERVAL 1 SECOND <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50", plain=True)
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not yet done (id not a multiple of three), attempts left, waiting time over; oldest first."""
    e = D.table(spark, sf_dir, "events").withColumns({"n": F.col("event_id") % 8, "ts": F.col("ts").cast("timestamp")})
    due = scoring.next_retry(F.col("n"), F.col("ts"), 5) <= F.lit("2024-01-20").cast("timestamp")
    return e.filter((F.col("event_id") % 3 != 0) & due).orderBy("ts", "event_id").limit(50).select("event_id")
