"""Graph queries, state changes, consolidation, chunking and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import temporal, text
from quillstone.operators import chunking, consolidate, graph, lifecycle
from quillstone.plans.registry import query
from quillstone.sources import derive as D
from quillstone.sources import store
from quillstone.streaming import jobs, state

BOTH = "around AS (SELECT src, dst FROM relates UNION ALL SELECT dst, src FROM relates)"


@query(f", {BOTH} SELECT node, min(depth) AS depth FROM (SELECT 'c1' AS node, 0 AS depth UNION ALL SELECT dst, 1 FROM around WHERE src = 'c1' UNION ALL SELECT b.dst, 2 FROM around a JOIN around b ON a.dst = b.src WHERE a.src = 'c1') GROUP BY node")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(D.relates(spark, sf_dir), spark.createDataFrame([("c1",)], "node string"), 2)


@query("SELECT src, dst FROM relates WHERE src IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 5000) AND dst IN ('n1', 'n2', 'n3', 'n4')")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = D.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.induced(D.relates(spark, sf_dir), rich.unionByName(spark.createDataFrame([(f"n{i}",) for i in range(1, 5)], "node string"))).select("src", "dst")


START = "(SELECT fact_id FROM facts WHERE entity_id = 7 ORDER BY fact_id LIMIT 1 OFFSET 5)"


@query(f", older AS (SELECT fact_id, supersedes_id, 0 AS step FROM facts WHERE fact_id = {START} UNION ALL SELECT f.fact_id, f.supersedes_id, step - 1 FROM facts f JOIN older c ON f.fact_id = c.supersedes_id), newer AS (SELECT fact_id, 0 AS step FROM facts WHERE fact_id = {START} UNION ALL SELECT f.fact_id, step + 1 FROM facts f JOIN newer c ON f.supersedes_id = c.fact_id) SELECT fact_id, step, epoch_us(valid_from) AS began FROM (SELECT fact_id, step FROM older UNION SELECT fact_id, step FROM newer) JOIN facts USING (fact_id)")
def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a fact goes back to and that goes back to it, link by link, however long."""
    f = D.facts(spark, sf_dir)
    start = f.filter("entity_id = 7").select("fact_id").orderBy("fact_id").offset(5).limit(1).select(F.col("fact_id").alias("node"))
    links = f.filter("supersedes_id IS NOT NULL").select(F.col("fact_id").alias("src"), F.col("supersedes_id").alias("dst"))
    return graph.chain(f, store.cut(links), start).select("fact_id", "step", F.unix_micros("valid_from").alias("began"))


@query(f""", {BOTH}, once AS (SELECT DISTINCT src, dst FROM around), s1 AS (SELECT dst AS node, row_number() OVER (ORDER BY dst) AS nth, count(*) OVER () AS n FROM once WHERE src = 'n1' QUALIFY nth <= 20), f AS (SELECT node, nth, count(*) OVER () AS n FROM s1),
hop AS (SELECT o.dst, f.nth, f.n, row_number() OVER (PARTITION BY o.src ORDER BY o.dst) AS own FROM once o JOIN f ON o.src = f.node), near AS (SELECT dst AS node, min((nth, own)) AS place FROM hop WHERE own <= greatest(8, 20 // n) GROUP BY dst),
new AS (SELECT node, row_number() OVER (ORDER BY place, node) AS nth FROM near WHERE node <> 'n1' AND node NOT IN (SELECT node FROM s1)), room AS (SELECT greatest(0, 20 - 1 - count(*)) AS room FROM s1),
t AS (SELECT coalesce(bool_or(nth > room), false) AS truncated FROM new, room)
SELECT node, depth, truncated FROM (SELECT 'n1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM new, room WHERE nth <= room), t""")
def adaptive_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node, its neighbours and theirs: the more neighbours, the fewer of each one's, and so many nodes in all."""
    return graph.adaptive_neighbourhood(D.relates(spark, sf_dir), "n1", 20)


LINKS = """links AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, c_acctbal AS weight FROM customer UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey + 1), 1.0 FROM customer WHERE c_custkey < (SELECT max(c_custkey) FROM customer)),
named AS (SELECT 'c' || c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE ' ' || c_mktsegment END || (c_nationkey % 9) AS name FROM customer),
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) GROUP BY 1),
moves AS (SELECT node, first_value(node) OVER (PARTITION BY lower(trim(name)) ORDER BY degree DESC, node) AS surv FROM named JOIN deg USING (node))"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with nations and with each other, and their names, many alike but for case and blanks."""
    c, k = D.table(spark, sf_dir, "customer"), F.col("c_custkey")
    most = c.agg(F.max("c_custkey").alias("most"))
    links = c.select(D.named("c", k).alias("src"), D.named("n", F.col("c_nationkey")).alias("dst"), F.col("c_acctbal").cast("double").alias("weight"))
    links = links.unionByName(c.crossJoin(F.broadcast(most)).filter(k < F.col("most")).select(D.named("c", k).alias("src"), D.named("c", k + 1).alias("dst"), F.lit(1.0).alias("weight")))  # one row
    name = F.concat(F.when(k % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment")), (F.col("c_nationkey") % 9).cast("string"))
    return links, c.select(D.named("c", k).alias("node"), name.alias("name"))


@query(f", {LINKS} SELECT src, dst, count(*) AS n, round(CAST(sum(weight) AS DOUBLE), 2) AS weight FROM (SELECT coalesce(a.surv, src) AS src, coalesce(b.surv, dst) AS dst, weight FROM links LEFT JOIN moves a ON a.node = src LEFT JOIN moves b ON b.node = dst) WHERE src <> dst GROUP BY ALL")
def entity_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities alike but for case and blanks become one, and their edges follow: parallel ones folded, loops dropped."""
    links, named = _linked(spark, sf_dir)
    out = graph.contracted(links, store.cut(graph.merge_moves(named, links)), {"n": F.count("*"), "weight": F.sum("weight")})
    return out.withColumn("weight", F.round("weight", 2))


@query(f", {LINKS} SELECT surv AS node, any_value(name) FILTER (WHERE node = surv) AS name, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE node <> surv), '') AS aliases, count(*) - 1 AS n_merged FROM named JOIN moves USING (node) GROUP BY 1")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that stay, with the names of those that went into them."""
    links, named = _linked(spark, sf_dir)
    return graph.merged_entities(named, store.cut(graph.merge_moves(named, links))).withColumn("aliases", F.array_join("aliases", ","))


RANKS = ", ".join(f"r{i} AS (SELECT node, sum(x) AS rank FROM (SELECT 'c1' AS node, 0.15::DOUBLE AS x UNION ALL SELECT f.dst, 0.85::DOUBLE * r.rank / f.degree FROM r{i - 1} r JOIN flow f ON f.src = r.node) GROUP BY node)" for i in range(1, 21))


@query(f", {BOTH}, flow AS MATERIALIZED (SELECT a.src, a.dst, d.degree FROM around a JOIN (SELECT src, count(*) AS degree FROM around GROUP BY src) d USING (src)), r0 AS (SELECT 'c1' AS node, 0.15::DOUBLE AS rank), {RANKS.replace('AS (SELECT node', 'AS MATERIALIZED (SELECT node')} SELECT node, round(rank, 9) AS rank FROM r20 WHERE rank > 0")
def personal_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graph.pagerank(D.relates(spark, sf_dir), spark.createDataFrame([("c1",)], "node string"))
    return r.filter("rank > 0").select("node", F.round("rank", 9).alias("rank"))


@query("SELECT node, min(node) OVER (PARTITION BY dst) AS root FROM (SELECT src AS node, dst FROM relates UNION ALL SELECT DISTINCT dst, dst FROM relates)")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(D.relates(spark, sf_dir))


@query("SELECT dst AS node, count(*) AS degree FROM relates GROUP BY 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.relates(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))


@query("SELECT o.o_custkey AS old_key, count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NULL GROUP BY 1", plain=True)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no live parent."""
    live = D.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return D.table(spark, sf_dir, "orders").join(live, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("old_key")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'orphan' WHEN b.id IS NULL THEN 'missing' WHEN a.v <> b.v THEN 'stale' ELSE 'same' END AS state FROM (SELECT event_id AS id, value AS v FROM events WHERE event_id % 5 <> 0) a FULL JOIN (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN value + 1 ELSE value END AS v FROM events WHERE event_id % 7 <> 0) b ON a.id = b.id", plain=True)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    a = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("a"), F.col("value").alias("va"))
    b = e.filter("event_id % 7 <> 0").select(F.col("event_id").alias("b"), F.when(F.col("event_id") % 9 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("vb"))
    state = F.when(F.col("a").isNull(), "orphan").when(F.col("b").isNull(), "missing").when(F.col("va") != F.col("vb"), "stale").otherwise("same")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("id"), state.alias("state"))


@query("SELECT key, pref_id, version, epoch_us(valid_to) AS closed FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from, pref_id) AS version FROM preferences)")
def preference_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.intervals(D.preferences(spark, sf_dir).drop("valid_to"), ["key"]).select("key", "pref_id", F.col("version").cast("long").alias("version"), F.unix_micros("valid_to").alias("closed"))


@query("SELECT f.fact_id, epoch_us(CASE WHEN c THEN greatest(f.valid_from, new_from) ELSE f.valid_to END) AS closed, c AS applied FROM (SELECT f.*, p.new_from, p.new_from IS NOT NULL AND f.valid_to IS NULL AND f.deleted_at IS NULL AS c FROM facts f LEFT JOIN (SELECT fact_id - 1 AS old_id, valid_from AS new_from FROM facts WHERE fact_id % 4 = 0) p ON f.fact_id = p.old_id) f")
def supersede_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir)
    pairs = f.filter("fact_id % 4 = 0").select((F.col("fact_id") - 1).alias("old_id"), F.col("valid_from").alias("new_from"))
    return lifecycle.supersede(f, pairs).select("fact_id", F.unix_micros("valid_to").alias("closed"), "applied")


@query("SELECT fact_id, h AND deleted_at IS NULL AS applied, CASE WHEN h AND deleted_at IS NULL THEN epoch_us(coalesce(valid_to, t_now)) ELSE epoch_us(valid_to) END AS closed FROM (SELECT *, fact_id % 6 = 0 AS h FROM facts), params")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir)
    return lifecycle.soft_delete(f, f.filter("fact_id % 6 = 0"), D.now()).select("fact_id", "applied", F.unix_micros("valid_to").alias("closed"))


@query("SELECT coalesce(o.id, n.id) AS id, coalesce(n.value, o.value) AS value, coalesce(n.tag, o.tag) AS tag FROM (SELECT event_id AS id, value, event_type AS tag FROM events WHERE event_id % 2 = 0) o FULL JOIN (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN value * 2 END AS value, 'new' AS tag FROM events WHERE event_id % 3 = 0) n ON o.id = n.id", plain=True)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    old = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), "value", F.col("event_type").alias("tag"))
    new = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.col("value") * 2).alias("value"), F.lit("new").alias("tag"))
    return lifecycle.upsert(old, new, "id")


@query("SELECT chunk_id, episode_id FROM chunks WHERE episode_id % 2 = 1 UNION ALL SELECT chunk_id + 1000000, episode_id FROM chunks WHERE episode_id % 2 = 0 AND position = 0")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir).select("chunk_id", "episode_id", "position")
    new = c.filter("episode_id % 2 = 0 AND position = 0").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), "episode_id", "position")
    return lifecycle.replace_children(c, new, "episode_id").select("chunk_id", "episode_id")


@query("SELECT k, value FROM (SELECT concat_ws('|', 'user=' || user_id, event_type) AS k, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events), params WHERE nth = 1 AND ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15' AND starts_with(k, 'user=1')")
def working_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each key that hasn't expired, by prefix."""
    e = D.table(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.concat_ws("|", F.concat(F.lit("user="), F.col("user_id").cast("string")), "event_type")})
    last = lifecycle.latest(e.filter(F.col("k").startswith("user=1")), ["k"], [F.col("ts").desc(), F.col("event_id").desc()])
    return last.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 30 DAYS")).filter(temporal.live(F.lit("2024-02-15").cast("timestamp"))).select("k", "value")


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1", plain=True)
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").filter((F.col("user_id") == 7) & F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")))
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS intention_id, CASE WHEN o_orderkey % 7 = 0 THEN 'done' WHEN o_orderdate <= TIMESTAMP '1995-01-01' - INTERVAL 7 DAY THEN 'expired' WHEN o_orderdate <= TIMESTAMP '1995-01-01' THEN 'due' ELSE 'pending' END AS state FROM orders", plain=True)
def intentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done, expired after a grace of seven days, due, or pending."""
    when, due = F.lit("1995-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("intention_id"), F.when(F.col("o_orderkey") % 7 == 0, "done").when(due <= when - F.expr("INTERVAL 7 DAYS"), "expired").when(due <= when, "due").otherwise("pending").alias("state"))


@query("SELECT event_id AS original_id, 'fact' AS original_kind, 'edit' AS reason, user_id, value, event_type FROM events", plain=True)
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all rows appended to a revision log in two goes, and read back out of their JSON."""
    rows, path = D.table(spark, sf_dir, "events"), store.shared_path(spark)
    for half in (0, 1):
        store.append(lifecycle.revision(rows.filter(F.col("event_id") % 2 == half), "event_id", "fact", "edit"), path)
    kept = spark.read.schema("original_id long, original_kind string, reason string, snapshot string").parquet(path)
    return kept.withColumn("s", F.from_json("snapshot", "event_id long, user_id long, value double, event_type string")).filter("s.event_id = original_id").select("original_id", "original_kind", "reason", "s.user_id", "s.value", "s.event_type")


VEC = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, a.label, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query(f", {VEC} SELECT a AS id, min(b) AS first FROM p WHERE s >= 0.45 AND b < a GROUP BY 1")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.duplicates(_vectors(spark, sf_dir), ["label"], 0.45)


@query(f", {VEC} SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(max(s), 6) AS score FROM p WHERE s >= 0.5 GROUP BY 1, 2")
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.synonyms(_vectors(spark, sf_dir), ["label"], 0.5).withColumn("score", F.round("score", 6))


@query(f", {VEC} SELECT a AS new_id, b AS old_id FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round((1 + s) / 2, 9) DESC, b) AS nth2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round((1 + s) / 2, 9) DESC, b) AS nth FROM p WHERE (1 + s) / 2 >= 0.7) WHERE nth <= 8 AND b < a) WHERE nth2 = 1")
def supersede_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.supersede_candidates(_vectors(spark, sf_dir), ["label"], 0.7)


@query()
def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.clusters(_vectors(spark, sf_dir), ["label"], 0.4)


@query("SELECT fact_id FROM (SELECT *, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 AS d FROM facts, params) WHERE valid_to IS NULL AND deleted_at IS NULL AND importance < 0.75 AND d >= 30 AND exp(-d / ((1 + 2 * reference_count) * (1 + 4 * importance))) < 0.05")
def prune_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.prunable(D.facts(spark, sf_dir), D.now()).select("fact_id")


@query("SELECT i AS insight_id FROM (SELECT DISTINCT entity_id AS i FROM facts WHERE importance >= 0.9) WHERE i NOT IN (SELECT entity_id FROM facts WHERE importance >= 0.9 AND valid_to IS NULL AND deleted_at IS NULL)")
def retired_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insight for each entity with important facts; retired once all those are closed."""
    f = D.facts(spark, sf_dir).filter("importance >= 0.9")
    sources = f.select(F.col("entity_id").alias("insight_id"), "fact_id")
    return consolidate.retired(sources.select("insight_id").distinct(), sources, f.filter("valid_to IS NULL AND deleted_at IS NULL"))


@query("SELECT fact_id FROM facts WHERE importance >= 0.85 AND valid_to IS NULL AND deleted_at IS NULL")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.promotable(D.facts(spark, sf_dir)).select("fact_id")


@query()
def extraction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir).select("episode_id", "position", text.approx_tokens(F.col("text")).cast("long").alias("tokens"))
    return consolidate.packed(c, 120)


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE text <> ''", plain=True)
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, cut into chunks and joined again without their overlaps."""
    c = chunking.chunked(D.table(spark, sf_dir, "documents"))
    part = F.struct("position", F.expr("substring(text, overlap_chars + 1)").alias("body"))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.body), "").alias("text"))


@query("SELECT lang AS bucket, '[[' || doc_id || ']]' AS link FROM documents", plain=True)
def vault_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to all documents, written as index files in a folder a bucket, in order over the files' names and lines, and read back."""
    path = store.shared_path(spark)
    d = D.table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), "doc_id", F.concat(F.lit("[["), F.col("doc_id").cast("string"), F.lit("]]")).alias("link"))
    d.repartitionByRange("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").select("bucket", "link").write.partitionBy("bucket").text(path)
    return spark.read.schema("value string, bucket string").text(path).select("bucket", F.col("value").alias("link"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", plain=True)
def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type over the events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = jobs.bucket_counts(spark, f"{sf_dir}/event[s].parquet", schema)  # a pattern, as a stream has no single file for its base
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT k AS key, id AS value, epoch_us(ts) AS at FROM (SELECT event_type || user_id AS k, CAST(event_id AS VARCHAR) AS id, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS nth FROM events) WHERE nth = 1 AND ts + INTERVAL 60 DAY > TIMESTAMP '2024-03-15'", plain=True)
def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type, as state that expires, over a stream of four batches, each with events of all times."""
    e, path = D.table(spark, sf_dir, "events"), store.shared_path(spark)
    rows = e.select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("at"))
    for part in range(4):
        rows.filter(F.pmod(F.col("value").cast("long"), F.lit(4)) == part).write.parquet(f"{path}/in/part={part}")
        stream = spark.readStream.schema("key string, value string, at timestamp").parquet(f"{path}/in/part=*")
        state.keep_state(spark, stream, path, 60 * 86_400)
    return state.current(spark, path, D.now(), 60 * 86_400).withColumn("at", F.unix_micros("at"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0", plain=True)
def queue_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("event_id")
    return jobs.queue_pass(e, e.filter("event_id % 3 = 0"), "event_id")


@query("SELECT event_id, value FROM events", plain=True)
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as snapshots, of which the newest two stay, and the newest is read back."""
    path = store.shared_path(spark)
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        store.backup({"events": D.table(spark, sf_dir, "events").select("event_id", "value")}, f"{path}/{day}")
    if store.keep_newest(spark, path, 2) != ["2024-01-01"]:
        raise AssertionError("the oldest snapshot should go")
    return store.restore(spark, f"{path}/2024-01-03", ["events"])["events"]


@query("SELECT 'events' AS name, count(*) AS n, count(DISTINCT event_id) AS keys FROM events UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'pages', count(*), count(DISTINCT page_id) FROM pages UNION ALL SELECT 'conversations', count(*), count(DISTINCT conv_id) FROM conversations", plain=True)
def backup_restore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several whole tables in one snapshot, with the newest of two read back: rows and keys of each."""
    path, keys = store.shared_path(spark), {"events": "event_id", "documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
    for day in ("2024-01-01", "2024-01-02"):
        store.backup({name: D.table(spark, sf_dir, name) for name in keys}, f"{path}/{day}")
        store.keep_newest(spark, path, 1)
    back = store.restore(spark, f"{path}/2024-01-02", list(keys))
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(keys[name]).alias("keys")) for name, df in back.items()))
