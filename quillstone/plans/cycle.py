"""Queries of the batch cycle's passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import temporal, text
from quillstone.operators import consolidate, cycle, lifecycle, resume
from quillstone.plans.registry import query
from quillstone.sources import derive as D
from quillstone.sources import store
from quillstone.sources.journal import Journal

VECTORS = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query(f", {VECTORS}, new AS (SELECT * FROM v WHERE id % 3 = 0), live AS (SELECT * FROM v WHERE id % 3 <> 0) SELECT n.id, list_transform((SELECT list((l.id, s) ORDER BY round(s, 9) DESC, l.id) FROM (SELECT l.id, list_cosine_similarity(n.e, l.e) AS s FROM live l WHERE l.label = n.label) l WHERE s >= 0.3)[:5], lambda x: x[1]) AS near FROM new n".replace("AS near FROM", "AS near FROM").replace("SELECT n.id, list_transform(", "SELECT id, array_to_string(near, ',') AS near FROM (SELECT n.id, list_transform(") + ") WHERE near IS NOT NULL AND len(near) > 0")
def dedup_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five live vectors of its bucket next to each new one."""
    v = _vectors(spark, sf_dir).withColumn("side", (F.col("id") % 3 != 0).cast("int"))
    best = consolidate.nearest(v, ["label"], 0.3, 5, sided=True)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("right_id").cast("string").alias("r"), F.col("right_id").alias("n"))), lambda a, b: F.when(a.s < b.s, -1).when(a.s > b.s, 1).when(a.n < b.n, -1).otherwise(1))
    return best.groupBy(F.col("left_id").alias("id")).agg(F.array_join(F.transform(order, lambda x: x.r), ",").alias("near"))


@query(f""", {VECTORS}, near AS (SELECT a.id, b.id AS other FROM v a JOIN v b ON a.label = b.label AND b.id < a.id AND list_cosine_similarity(a.e, b.e) >= 0.45), start AS (SELECT id FROM v WHERE id % 5 = 0),
held AS (SELECT v.id, EXISTS (SELECT 1 FROM near n WHERE (n.id = v.id AND n.other % 5 = 0) OR (n.other = v.id AND n.id % 5 = 0)) AS h FROM v WHERE v.id % 5 <> 0),
todo AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM held WHERE NOT h), fold AS (SELECT 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
SELECT t.k, CASE WHEN len(list_filter(f.kept, lambda x: x IN (SELECT other FROM near WHERE near.id = t.id))) = 0 THEN list_append(f.kept, t.id) ELSE f.kept END FROM fold f JOIN todo t ON t.k = f.k + 1)
SELECT unnest(kept) AS id FROM (SELECT kept FROM fold ORDER BY k DESC LIMIT 1)""".replace("len(list_filter(f.kept, lambda x: x IN (SELECT other FROM near WHERE near.id = t.id))) = 0", "NOT list_has_any(f.kept, coalesce((SELECT list(other) FROM near WHERE near.id = t.id), []))"))
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts that neither a live one nor an earlier new one is near to, as the cycle takes them in, in order of id."""
    v = _vectors(spark, sf_dir)
    return consolidate.fresh(v.filter("id % 5 <> 0"), v.filter("id % 5 = 0"), ["label"], 0.45)


@query("SELECT fact_id FROM facts WHERE fact_id % 2 = 1 AND valid_to IS NULL AND deleted_at IS NULL AND recorded_at <= (SELECT t_now FROM params) - INTERVAL 60 SECOND ORDER BY recorded_at, fact_id LIMIT 50")
def unchecked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts not yet checked for supersession (here odd ids), past the grace time."""
    f = D.facts(spark, sf_dir).withColumn("checked_at", F.when(F.col("fact_id") % 2 == 0, F.col("recorded_at")))
    return cycle.sweep_queue(f, D.now()).select("fact_id")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 8 < 5 ORDER BY page_id LIMIT 40", plain=True)
def attachment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments not extracted yet with attempts left, the oldest first."""
    return D.table(spark, sf_dir, "pages").filter((F.col("page_id") % 3 != 0) & (F.col("page_id") % 8 < 5)).orderBy("page_id").limit(40).select("page_id")


@query("SELECT episode_id FROM episodes WHERE summary_kind = 'provisional' ORDER BY recorded_at, episode_id LIMIT 50")
def provisional_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.episodes(spark, sf_dir).filter("summary_kind = 'provisional'").orderBy("recorded_at", "episode_id").limit(50).select("episode_id")


def _fit(x: str) -> str:
    return f"CASE WHEN length({x}) <= 256 THEN {x} ELSE regexp_replace(left({x}, 256), '\\s\\S*\\z', '') END"


def _round(source: str) -> str:
    """One round of map and reduce over parts of 4,800 characters."""
    parts = f"list_transform(range(0, CAST(ceil(length(b) / 4800.0) AS BIGINT)), lambda i: {_fit('substr(b, i * 4800 + 1, 4800)')})"
    return f"(SELECT episode_id, CASE WHEN length(b) > 4800 THEN array_to_string({parts}, chr(10)) ELSE b END AS b FROM {source})"


BODY = "(SELECT conv_id AS episode_id, string_agg(text, chr(10) ORDER BY turn) AS b FROM conversations GROUP BY 1)"


@query(f"SELECT episode_id, CASE WHEN summary_kind = 'provisional' THEN s END AS summary FROM episodes JOIN (SELECT episode_id, {_fit('b')} AS s FROM {_round(_round(BODY))}) USING (episode_id)")
def installed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional summaries replaced by the default summariser's, full ones untouched (here null)."""
    e = D.episodes(spark, sf_dir).withColumn("summary", F.lit(None).cast("string"))
    t = cycle.Tables(D.facts(spark, sf_dir), e, D.chunks(spark, sf_dir), D.mentions(spark, sf_dir))
    return cycle.summaries_pass(t, D.now(), cycle.Hooks()).episodes.select("episode_id", "summary")


@query("SELECT chunk_id, CAST(nth AS INT) AS nth, content, epoch_us(recorded_at) AS began, project_id FROM (SELECT chunk_id, episode_id, unnest(p) AS content, generate_subscripts(p, 1) - 1 AS nth FROM (SELECT chunk_id, episode_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS p FROM chunks)) JOIN episodes USING (episode_id)")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts out of chunks by the default extractor, with their episode's scope and time."""
    out = cycle.extracted(D.chunks(spark, sf_dir), D.episodes(spark, sf_dir))
    return out.select("chunk_id", "nth", "content", F.unix_micros("valid_from").alias("began"), "project_id")


@query("SELECT src, dst, round(max(confidence), 6) AS confidence FROM (SELECT confidence, e[1] AS src, e[2] AS dst FROM (SELECT fact_id, list(DISTINCT entity ORDER BY entity)[1:2] AS e FROM mentions GROUP BY 1) JOIN facts USING (fact_id) WHERE len(e) = 2) WHERE confidence >= 0.6 AND src <> dst GROUP BY 1, 2")
def extracted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cycle.named_together(D.facts(spark, sf_dir), D.mentions(spark, sf_dir))
    return cycle.relations(found).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT f.fact_id, f.pruned, epoch_us(CASE WHEN f.pruned THEN coalesce(f.closed, f.t_now) ELSE f.closed END) AS closed FROM (SELECT f.*, CASE WHEN valid_to IS NULL AND deleted_at IS NULL AND n.new_id <> f.fact_id THEN greatest(f.valid_from, n.new_from) ELSE valid_to END AS closed,
  valid_to IS NULL AND n.new_id IS NOT DISTINCT FROM f.fact_id AND deleted_at IS NULL AND importance < 0.75 AND d >= 30 AND exp(-d / ((1 + 2 * reference_count) * (1 + 4 * importance))) < 0.05 AS pruned FROM (SELECT *, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 AS d FROM facts, params) f
  LEFT JOIN (SELECT entity_id, category, arg_max(fact_id, (valid_from, fact_id)) AS new_id, max(valid_from) AS new_from FROM facts WHERE valid_to IS NULL AND deleted_at IS NULL GROUP BY ALL) n ON n.entity_id = f.entity_id AND n.category IS NOT DISTINCT FROM f.category) f""")
def cycle_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole cycle with the default hooks: what the facts are after its passes."""
    e = D.episodes(spark, sf_dir).withColumn("summary", F.lit(None).cast("string"))
    t = cycle.run(cycle.Tables(D.facts(spark, sf_dir), e, D.chunks(spark, sf_dir), D.mentions(spark, sf_dir)), D.now())
    hit = t.pruned.withColumn("pruned", F.lit(True))
    return t.facts.join(hit, "fact_id", "left").select("fact_id", F.coalesce("pruned", F.lit(False)).alias("pruned"), F.unix_micros("valid_to").alias("closed"))


@query("""SELECT o_orderkey AS intention_id, CASE WHEN o_orderkey % 6 = 0 THEN 'completed' WHEN o_orderkey % 6 = 1 THEN 'cancelled' WHEN o_orderkey % 6 = 2 THEN 'pending' WHEN o_orderdate <= TIMESTAMP '1995-01-01' - INTERVAL 7 DAY THEN 'expired' ELSE 'pending' END AS status,
CAST(o_orderkey % 6 = 2 AS INT) AS fired, o_orderkey % 6 < 2 OR (o_orderkey % 6 > 2 AND o_orderdate <= TIMESTAMP '1995-01-01' - INTERVAL 7 DAY) AS closed, o_orderkey % 6 = 0 AS complete FROM orders""", plain=True)
def intention_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, cancelled, fired, and expired intentions after a pass."""
    i, now, never = F.col("o_orderkey"), F.lit("1995-01-01").cast("timestamp"), F.lit(None).cast("timestamp")
    o = D.table(spark, sf_dir, "orders")
    rows = o.select(i.alias("intention_id"), F.lit("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("due_at"), never.alias("valid_to"), never.alias("completed_at"), F.lit(0).alias("fired"), never.alias("last_fired_at"))
    changes = o.select(i.alias("intention_id"), F.when(i % 6 == 0, "completed").when(i % 6 == 1, "cancelled").when(i % 6 == 2, "fired").alias("change")).filter("change IS NOT NULL")
    out = cycle.moved_intentions(rows, changes, now)
    return out.select("intention_id", "status", "fired", F.col("valid_to").isNotNull().alias("closed"), F.col("completed_at").isNotNull().alias("complete"))


@query("SELECT o_orderkey AS intention_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100", plain=True)
def due_intentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending intentions due by a time, the earliest first."""
    o = D.table(spark, sf_dir, "orders").filter((F.col("o_orderkey") % 7 != 0) & (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp")))
    return o.orderBy("o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("intention_id"))


@query("SELECT event_id AS run_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS state FROM events", plain=True)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs left running (here clicks) by a process that began before this one."""
    e = D.table(spark, sf_dir, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.col("ts").cast("timestamp").alias("began"), F.lit(None).cast("timestamp").alias("ended"))
    return cycle.reaped(runs, D.at()).select("run_id", "state")


@query("SELECT event_id AS job_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 5 END AS attempts, event_id % 4 <> 0 AND event_id % 3 = 0 AS done FROM events", plain=True)
def requeued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = D.table(spark, sf_dir, "events"), F.col("event_id")
    jobs = e.select(i.alias("job_id"), F.when(i % 3 == 0, F.col("ts").cast("timestamp")).alias("done_at"), (i % 5).alias("attempts"), F.lit(None).cast("timestamp").alias("next_at"))
    return cycle.requeued(jobs, e.filter("event_id % 4 = 0").select(i.alias("job_id"))).select("job_id", "attempts", F.col("done_at").isNotNull().alias("done"))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 300)", plain=True)
def batch_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 300 of what is to go, goes."""
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type")
    return cycle.bounded_delete(e, F.col("event_type") == "view", ["event_id"], 300).select("event_id")


@query("SELECT doc_id, priority, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS nth FROM (SELECT doc_id, 1 AS priority, 'labels' AS source FROM labels UNION ALL SELECT doc_id, 2, 'long' FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, 3, 'all' FROM documents)) WHERE nth = 1", plain=True)
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several lists, each kept as the first list had it."""
    d = D.table(spark, sf_dir, "documents")
    parts = [(D.table(spark, sf_dir, "labels"), 1, "labels"), (d.filter("n_chars > 2000"), 2, "long"), (d, 3, "all")]
    rows = None
    for df, n, name in parts:
        one = df.select("doc_id", F.lit(n).alias("priority"), F.lit(name).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("doc_id").agg(F.min_by("source", "priority").alias("source"), F.min("priority").alias("priority"))


@query(", best AS (SELECT fact_id FROM facts WHERE deleted_at IS NULL ORDER BY importance DESC, fact_id LIMIT 10) SELECT entity FROM mentions WHERE fact_id IN (SELECT fact_id FROM best) UNION SELECT entity FROM mentions WHERE entity IN ('user:7', 'item:4')")
def seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk's seeds: the entities linked to the request and those of the best facts."""
    m = D.mentions(spark, sf_dir)
    best = D.facts(spark, sf_dir).filter(temporal.visible()).orderBy(F.col("importance").desc(), "fact_id").limit(10).select("fact_id")
    return m.join(best, "fact_id", "left_semi").select("entity").unionByName(m.filter(F.col("entity").isin("user:7", "item:4")).select("entity")).distinct()


@query("SELECT name, kind FROM (SELECT lower(trim(p_name)) AS name, first(p_type ORDER BY typed DESC, p_partkey) AS kind FROM (SELECT p_name, p_type, 1 AS typed, p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT upper(p_name), NULL, 0, p_partkey FROM part) GROUP BY 1)", plain=True)
def typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names listed with a type win over bare ones alike but for case."""
    p = D.table(spark, sf_dir, "part")
    rows = p.filter("p_partkey % 2 = 0").select("p_name", "p_type", F.lit(0).alias("bare"), "p_partkey").unionByName(p.select(F.upper("p_name").alias("p_name"), F.lit(None).cast("string").alias("p_type"), F.lit(1).alias("bare"), "p_partkey"))
    return rows.groupBy(text.normal_name(F.col("p_name")).alias("name")).agg(F.min_by(F.struct("p_type"), F.struct("bare", "p_partkey"))["p_type"].alias("kind"))


@query("SELECT g AS \"group\", CAST(sum(reference_count) AS BIGINT) AS refs, epoch_us(max(last_used)) AS last_used, count(*) AS n, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS merged_from, coalesce((SELECT string_agg(DISTINCT entity, ',' ORDER BY entity) FROM mentions m WHERE m.fact_id IN (SELECT fact_id FROM facts h WHERE h.fact_id // 4 = g AND h.valid_to IS NULL AND h.deleted_at IS NULL)), '') AS entities FROM (SELECT *, fact_id // 4 AS g, CASE WHEN fact_id % 3 = 0 THEN recorded_at END AS last_used FROM facts WHERE valid_to IS NULL AND deleted_at IS NULL) GROUP BY 1")
def fact_merge_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged facts with pooled uses, the latest use, all members and all their entities."""
    f = D.facts(spark, sf_dir).withColumn("last_used", F.when(F.col("fact_id") % 3 == 0, F.col("recorded_at")))
    members = f.select(F.floor(F.col("fact_id") / 4).alias("group"), "fact_id")
    new, _ = lifecycle.merge(f, members, D.now(), D.mentions(spark, sf_dir))
    return new.select("group", F.col("reference_count").alias("refs"), F.unix_micros("last_used").alias("last_used"), "n", F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ",").alias("merged_from"), F.array_join("entities", ",").alias("entities"))


def _signs(content):
    """An embedder by which texts are alike if they are equal: 128 numbers out of the text's hash."""
    return F.transform(F.split(F.sha2(content.cast("binary"), 512), ""), lambda d: F.instr(F.lit("0123456789abcdef"), d).cast("double") - 8.5)


def _ends(facts: DataFrame) -> DataFrame:
    """First and last word of a fact."""
    words = F.split(F.lower("content"), " ")
    return facts.select("fact_id", F.explode(F.array_distinct(F.array(F.element_at(words, 1), F.element_at(words, -1)))).alias("entity"))


CYCLE = """, f0 AS (SELECT fact_id, split_part(content, ' ', 1) || ' item ' || (entity_id % 5) AS content, category, valid_from, valid_to, recorded_at, deleted_at, confidence, importance, reference_count, project_id, user_id, fact_id % 2 = 0 AS checked FROM facts),
ep AS (SELECT * FROM episodes ORDER BY recorded_at, episode_id LIMIT 30),
said AS (SELECT episode_id, recorded_at, project_id, user_id, unnest(p) AS content, generate_subscripts(p, 1) AS nth FROM (SELECT e.*, list_filter(string_split(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY position), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS p
  FROM ep e JOIN chunks USING (episode_id) WHERE text IS NOT NULL GROUP BY ALL)),
new AS (SELECT (SELECT max(fact_id) FROM f0) + row_number() OVER (ORDER BY recorded_at, episode_id, nth, content) AS fact_id, * FROM said),
added AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM f0 WHERE f0.content = n.content AND f0.valid_to IS NULL AND f0.deleted_at IS NULL AND f0.project_id IS NOT DISTINCT FROM n.project_id AND f0.user_id IS NOT DISTINCT FROM n.user_id)
  QUALIFY row_number() OVER (PARTITION BY content, project_id, user_id ORDER BY fact_id) = 1),
ends AS (SELECT fact_id, unnest(list_distinct([lower(string_split(content, ' ')[1]), lower(string_split(content, ' ')[-1])])) AS entity FROM added),
m1 AS (SELECT fact_id, entity FROM mentions UNION ALL SELECT DISTINCT fact_id, entity FROM ends WHERE entity <> ''),
f1 AS (SELECT fact_id, content, category, valid_from, valid_to, recorded_at, deleted_at, confidence, importance, reference_count, project_id, user_id, checked FROM f0 UNION ALL SELECT fact_id, content, 'note', recorded_at, NULL, t_now, NULL, 0.8, 0.5, 0, project_id, user_id, true FROM added, params),
q AS (SELECT fact_id, content, project_id, user_id, valid_from FROM f1, params WHERE NOT checked AND valid_to IS NULL AND deleted_at IS NULL AND recorded_at <= t_now - INTERVAL 60 SECOND ORDER BY recorded_at, fact_id LIMIT 50),
hit AS (SELECT old_id, min(new_id) AS new_id FROM (SELECT q.fact_id AS new_id, min(o.fact_id) AS old_id FROM q JOIN f1 o ON o.content = q.content AND o.project_id IS NOT DISTINCT FROM q.project_id AND o.user_id IS NOT DISTINCT FROM q.user_id AND o.fact_id < q.fact_id WHERE o.valid_to IS NULL AND o.deleted_at IS NULL GROUP BY 1) GROUP BY 1),
f2 AS (SELECT f1.* REPLACE (CASE WHEN h.new_id IS NOT NULL THEN greatest(f1.valid_from, n.valid_from) ELSE f1.valid_to END AS valid_to, f1.checked OR f1.fact_id IN (SELECT fact_id FROM q) AS checked) FROM f1 LEFT JOIN hit h ON h.old_id = f1.fact_id LEFT JOIN f1 n ON n.fact_id = h.new_id),
live AS (SELECT * FROM f2 WHERE valid_to IS NULL AND deleted_at IS NULL),
home AS (SELECT fact_id, entity FROM m1 JOIN live USING (fact_id) JOIN (SELECT entity, count(*) AS n FROM m1 WHERE fact_id IN (SELECT fact_id FROM live) GROUP BY 1 HAVING count(*) >= 2) USING (entity) QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY n DESC, entity) = 1),
c AS (SELECT live.*, min(fact_id) OVER (PARTITION BY entity, content, project_id, user_id, part) AS cluster, count(*) OVER (PARTITION BY entity, content, project_id, user_id, part) AS n FROM (SELECT live.*, entity, (row_number() OVER (PARTITION BY entity, content, project_id, user_id ORDER BY fact_id) - 1) // 6 AS part FROM live JOIN home USING (fact_id)) live),
made AS (SELECT (SELECT max(fact_id) FROM f2) + row_number() OVER (ORDER BY cluster) AS fact_id, * FROM (SELECT cluster, any_value(content) AS content, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS merged_from, max(importance) AS importance, any_value(project_id) AS project_id, any_value(user_id) AS user_id, CAST(sum(reference_count) AS BIGINT) AS refs FROM c WHERE n >= 2 GROUP BY cluster)),
f3 AS (SELECT f2.* REPLACE (CASE WHEN fact_id IN (SELECT fact_id FROM c WHERE n >= 2) THEN t_now ELSE valid_to END AS valid_to), '' AS merged_from FROM f2, params
  UNION ALL SELECT fact_id, content, NULL, NULL, NULL, t_now, NULL, NULL, importance, refs, project_id, user_id, true, merged_from FROM made, params),
known AS (SELECT fact_id AS insight_id, 'insight ' || content AS content FROM f0 WHERE importance >= 0.95 AND fact_id % 2 = 0),
asks AS (SELECT *, min(fact_id) OVER (PARTITION BY content, project_id, user_id) AS insight_id FROM f3 WHERE importance >= 0.85 AND valid_to IS NULL AND deleted_at IS NULL AND fact_id NOT IN (SELECT insight_id FROM known)),
f4 AS (SELECT *, valid_to IS NULL AND deleted_at IS NULL AND importance < 0.75 AND d >= 30 AND exp(-d / ((1 + 2 * reference_count) * (1 + 4 * importance))) < 0.05 AS pruned FROM (SELECT *, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 AS d FROM f3, params)),
f5 AS (SELECT *, CASE WHEN pruned THEN t_now ELSE valid_to END AS closed FROM f4),
src AS (SELECT insight_id, insight_id AS fact_id FROM known UNION ALL SELECT insight_id, fact_id FROM asks)
SELECT 'fact' AS part, fact_id AS id, content || '|' || merged_from AS told, epoch_us(closed) AS at, pruned AS flag FROM f5
UNION ALL SELECT 'checked', fact_id, '', NULL, checked FROM f5
UNION ALL SELECT 'insight', i.insight_id, content, NULL, NOT EXISTS (SELECT 1 FROM src JOIN f5 USING (fact_id) WHERE src.insight_id = i.insight_id AND closed IS NULL AND deleted_at IS NULL) FROM (SELECT * FROM known UNION ALL SELECT fact_id, content FROM asks WHERE fact_id = insight_id) i
UNION ALL SELECT 'source', insight_id, CAST(fact_id AS VARCHAR), NULL, false FROM src
UNION ALL SELECT 'mark', episode_id, '', NULL, false FROM ep
UNION ALL SELECT 'relation', count(*), '', NULL, false FROM (SELECT DISTINCT list_sort(list(entity))[1], list_sort(list(entity))[2] FROM ends WHERE entity <> '' GROUP BY fact_id HAVING count(*) = 2)"""


@query(CYCLE.replace("\\\\", "\\"))
def cycle_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole cycle over committed tables, run pass by pass: facts, checks, insights with their sources, marks and relations after it. Texts are alike here if they are equal."""
    f, e, none = D.facts(spark, sf_dir), D.episodes(spark, sf_dir), F.lit(None)
    content = F.concat(F.split_part("content", F.lit(" "), F.lit(1)), F.lit(" item "), (F.col("entity_id") % 5).cast("string"))
    facts = f.withColumns({"content": content, "pruned_at": none, "merged_from": none, "checked_at": F.when(F.col("fact_id") % 2 == 0, F.col("recorded_at"))}).withColumn("embedding", _signs(F.col("content")))
    known = facts.filter("importance >= 0.95 AND fact_id % 2 = 0").select(F.col("fact_id").alias("insight_id"), F.concat(F.lit("insight "), "content").alias("content"), "project_id", "user_id")
    tables = {"facts": facts, "episodes": e, "chunks": D.chunks(spark, sf_dir), "mentions": D.mentions(spark, sf_dir), "insights": known.withColumn("embedding", _signs(F.col("content"))), "sources": known.select("insight_id", F.col("insight_id").alias("fact_id"))}
    journal = Journal(spark, store.shared_path(spark))
    resume.begin(journal, tables)
    parts = resume.Parts(embed=_signs, entities=_ends, batch=30, group_tokens=10**9)
    for step in resume.PASSES:  # one at a time, as a driver that is stopped after each would
        resume.run(journal, "night", D.now(), parts, passes=[step])
    t = journal.tables()
    row = lambda df, part, key, told, at=none, flag=F.lit(False): df.select(F.lit(part).alias("part"), F.col(key).cast("long").alias("id"), told.alias("told"), at.cast("long").alias("at"), flag.alias("flag"))
    told = F.concat("content", F.lit("|"), F.coalesce(F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ","), F.lit("")))
    out = [
        row(t["facts"], "fact", "fact_id", told, F.unix_micros("valid_to"), F.col("pruned_at").isNotNull()),
        row(t["facts"], "checked", "fact_id", F.lit(""), flag=F.col("checked_at").isNotNull()),
        row(t["insights"], "insight", "insight_id", F.col("content"), flag=F.col("retired_at").isNotNull()),
        row(t["sources"], "source", "insight_id", F.col("fact_id").cast("string")),
        row(t["marks"].filter("step = 'extraction'"), "mark", "key", F.lit("")),
        row(t["relations"].agg(F.count("*").alias("n")), "relation", "n", F.lit("")),
    ]
    return reduce(DataFrame.unionByName, out)
