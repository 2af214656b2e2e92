"""Record keeping: expansion and reranking of recall, versions, merges, repairs, attribution, sinks and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import temporal, text, vectors
from quillstone.operators import graph, lifecycle, retrieval
from quillstone.plans.graphs import BOTH
from quillstone.plans.recall import BM25
from quillstone.plans.registry import query
from quillstone.sources import derive as D
from quillstone.sources import files, ingest, readers, store
from quillstone.streaming import jobs

OPEN = "valid_to IS NULL AND deleted_at IS NULL"


@query(f"SELECT fact_id, min(position) AS rank, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS chunk_ids FROM facts JOIN chunks ON episode_id = entity_id AND position % 3 = fact_id % 3 WHERE role = 'user' AND {OPEN} GROUP BY 1")
def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = D.facts(spark, sf_dir), D.chunks(spark, sf_dir)
    links = c.select("chunk_id", F.col("episode_id").alias("entity_id"), (F.col("position") % 3).alias("third")).join(f.select("fact_id", "entity_id", (F.col("fact_id") % 3).alias("third")), ["entity_id", "third"]).select("chunk_id", "fact_id")
    found = retrieval.chunk_facts(c.filter("role = 'user'").select("chunk_id", F.col("position").alias("rank")), links, f)
    return found.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ","))


@query(f", {BOTH}, once AS (SELECT DISTINCT src, dst FROM around), s1 AS (SELECT dst FROM once WHERE src = 'n1' QUALIFY row_number() OVER (ORDER BY dst) <= 8) SELECT 'n1' AS node, 0 AS depth UNION ALL SELECT dst, 1 FROM s1 UNION ALL SELECT * FROM (SELECT DISTINCT o.dst, 2 FROM once o JOIN s1 ON o.src = s1.dst QUALIFY row_number() OVER (PARTITION BY o.src ORDER BY o.dst) <= 8) t(node, depth) WHERE node <> 'n1' AND node NOT IN (SELECT dst FROM s1)")
def capped_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(D.relates(spark, sf_dir), spark.createDataFrame([("n1",)], "node string"), 2, cap=8)


@query("""SELECT fact_id, string_agg(source || ':' || (place - 1), ',' ORDER BY source) AS found, bool_or(source <> 'sibling') AS direct FROM (
SELECT fact_id, 'a' AS source, row_number() OVER (ORDER BY importance DESC, fact_id) AS place FROM facts QUALIFY place <= 100
UNION ALL SELECT fact_id, 'b', row_number() OVER (ORDER BY confidence DESC, fact_id) AS place FROM facts QUALIFY place <= 100
UNION ALL SELECT fact_id, 'sibling', row_number() OVER (ORDER BY importance DESC, fact_id) AS place FROM facts WHERE entity_id = 7 QUALIFY place <= 50) GROUP BY 1""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir)
    best = lambda rows, by, n, source: retrieval.ranked(rows.orderBy(F.col(by).desc(), "fact_id").limit(n), "fact_id", source, by)
    c = retrieval.candidates([best(f, "importance", 100, "a"), best(f, "confidence", 100, "b"), best(f.filter("entity_id = 7"), "importance", 50, "sibling")], "fact_id")
    return c.withColumn("found", F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["source"], x["rank"].cast("string"))), ","))


@query("SELECT *, rank_after < rank_before AS promoted FROM (SELECT fact_id, row_number() OVER (ORDER BY confidence DESC, fact_id) - 1 AS rank_after, place - 1 AS rank_before FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, fact_id) AS place FROM facts QUALIFY place <= 20)) WHERE rank_after < 10")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's twenty best, reordered by another score; ten stay."""
    f = D.facts(spark, sf_dir).orderBy(F.col("importance").desc(), "fact_id").limit(20)
    hits = retrieval.ranked(f, "fact_id", "x", "importance").join(f, "fact_id")
    return retrieval.rerank(hits, "fact_id", F.col("confidence")).withColumns({c: F.col(c).cast("long") for c in ("rank_after", "rank_before")})


@query("SELECT fact_id, reference_count + CASE WHEN importance >= 0.97 THEN 1 ELSE 0 END AS reference_count, CASE WHEN importance >= 0.97 THEN epoch_us(t_now) END AS last_used FROM facts, params")
def use_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir)
    return lifecycle.tick(f, f.filter("importance >= 0.97"), D.now()).select("fact_id", "reference_count", F.unix_micros("last_used").alias("last_used"))


@query(f", m AS (SELECT * FROM facts WHERE {OPEN} AND importance < 0.5 QUALIFY count(*) OVER (PARTITION BY entity_id) >= 2) SELECT 'merged' AS kind, entity_id AS id, CAST(sum(reference_count) AS BIGINT) AS refs, count(*) AS n, round(greatest(0, max(importance) - 0.1), 6) AS importance, epoch_us(min(valid_from)) AS at FROM m GROUP BY 2 UNION ALL SELECT 'closed', fact_id, reference_count, 1, round(importance, 6), epoch_us(t_now) FROM m, params")
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's open facts of low importance, two at least, folded into one."""
    f = D.facts(spark, sf_dir)
    low = f.filter(F.col("valid_to").isNull() & temporal.visible() & (F.col("importance") < 0.5))
    members = low.join(low.groupBy("entity_id").count().filter("count >= 2"), "entity_id", "left_semi").select(F.col("entity_id").alias("group"), "fact_id")
    new, closed = lifecycle.merge(f, members, D.now())
    shape = lambda df, kind, key, n, at: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("reference_count").alias("refs"), n.cast("long").alias("n"), F.round("importance", 6).alias("importance"), F.unix_micros(at).alias("at"))
    return shape(new, "merged", "group", F.col("n"), "valid_from").unionByName(shape(closed, "closed", "fact_id", F.lit(1), "valid_to"))


@query(", s AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY valid_from, pref_id) AS version, valid_to IS NULL AS live FROM preferences) SELECT key, version, value, live AND value <= 100 AS live FROM s UNION ALL SELECT key, version + 1, value * 2, true FROM s WHERE live AND value > 100")
def version_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = lifecycle.intervals(D.preferences(spark, sf_dir), ["key"]).select("key", F.col("version").cast("long").alias("version"), "value", F.col("valid_to").isNull().alias("live"))
    return lifecycle.new_versions(state, state.filter("live AND value > 100").select("key", (F.col("value") * 2).alias("value")), "key")


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN event_id % 9 = 0 THEN 'new' ELSE event_type END AS event_type FROM events", plain=True)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields given in a change are set, to null too; the others stay."""
    e, i = D.table(spark, sf_dir, "events").select("event_id", "value", "event_type"), F.col("event_id")
    changes = e.filter("event_id % 3 = 0").select("event_id", F.when(i % 6 != 0, F.col("value") + 1).alias("value"), F.lit(True).alias("set_value"), F.lit("new").alias("event_type"), (i % 9 == 0).alias("set_event_type"))
    return lifecycle.patch(e, changes, "event_id", ["value", "event_type"])


@query("SELECT job_id, attempts, epoch_us(CASE WHEN job_id % 2 <> 0 THEN ts WHEN attempts < 5 THEN t_now + CAST(60 * pow(2, attempts) AS BIGINT) * INTERVAL 1 SECOND END) AS next_at, attempts >= 5 AS dead FROM (SELECT event_id AS job_id, ts, event_id % 6 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS attempts FROM events), params")
def failure_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), (F.col("event_id") % 6).alias("attempts"), F.col("ts").cast("timestamp").alias("next_at"))
    return lifecycle.record_failures(e, e.filter("job_id % 2 = 0"), "job_id", D.now(), 5).withColumn("next_at", F.unix_micros("next_at"))


@query("SELECT lower(trim(name)) AS name_norm, arg_min(name, event_id) AS name, arg_min(kind, event_id) AS kind, count(*) AS n FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS name, 't' || (event_id % 3) AS kind FROM events) GROUP BY 1", plain=True)
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alike but for case and blanks are one entity; its first kind stays."""
    i = F.col("event_id")
    e = D.table(spark, sf_dir, "events").select(i, F.when(i % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("name"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("kind"))
    return lifecycle.fold_names(e, "name", "kind", "event_id")


@query("WITH b AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS part FROM b), w AS (SELECT event_id AS node, last_value(event_id) OVER (PARTITION BY user_id, event_type, part ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS survivor, count(*) OVER (PARTITION BY user_id, event_type, part) AS n FROM g) SELECT node, survivor FROM w WHERE n > 1", plain=True)
def lineage_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts linked by supersession are one lineage; its last fact survives."""
    f = D.facts(spark, sf_dir)
    edges = f.filter("supersedes_id IS NOT NULL AND fact_id % 3 <> 0").select(F.col("fact_id").alias("src"), F.col("supersedes_id").alias("dst"))
    return graph.survivors(edges, f, "fact_id", ["valid_from", "fact_id"])


@query("SELECT f.fact_id, epoch_us(greatest(f.valid_from, n.valid_from)) AS closed FROM facts f JOIN facts n ON n.supersedes_id = f.fact_id")
def event_time_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superseded facts close at the later start of both."""
    f = D.facts(spark, sf_dir)
    n = f.filter("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("fact_id"), F.col("valid_from").alias("new_from"))
    return f.select("fact_id", "valid_from").join(n, "fact_id").select("fact_id", F.unix_micros(temporal.closes_at(F.col("valid_from"), F.col("new_from"))).alias("closed"))


@query("SELECT f.fact_id, CASE WHEN m.n > 0 THEN 'merged' WHEN s.n > 0 THEN 'superseded' ELSE 'open' END AS evidence FROM facts f LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest(merged_from) AS id FROM facts) GROUP BY 1) m ON f.fact_id = m.id LEFT JOIN (SELECT supersedes_id AS id, count(*) AS n FROM facts GROUP BY 1) s ON f.fact_id = s.id")
def lifecycle_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir)
    count = lambda c, n: f.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("fact_id")).agg(F.count("*").alias(n))
    evidence = F.when(F.col("merged") > 0, "merged").when(F.col("superseded") > 0, "superseded").otherwise("open")
    merged = f.select(F.explode("merged_from").alias("fact_id")).groupBy("fact_id").agg(F.count("*").alias("merged"))
    return f.select("fact_id").join(merged, "fact_id", "left").join(count("supersedes_id", "superseded"), "fact_id", "left").select("fact_id", evidence.alias("evidence"))


HEAD, TAIL = BM25.rsplit("\nSELECT", 1)


@query(f"{HEAD}, hits AS (SELECT{TAIL}) SELECT doc_id, score, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS snippet FROM hits JOIN documents USING (doc_id)")
def ledger_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text hits with a snippet; texts are read for the hits alone, a bounded list."""
    d = D.table(spark, sf_dir, "documents")
    hits = retrieval.bm25(d, "doc_id", "text", "released under license", 50)
    return d.join(F.broadcast(hits), "doc_id").select("doc_id", F.round("score", 6).alias("score"), text.truncate(F.col("text"), 60).alias("snippet"))


LABELLED = "CASE role WHEN 'user' THEN 'USER(u' || (conv_id % 3) || ')' WHEN 'assistant' THEN 'ASSISTANT' ELSE 'note' END || ': ' || text"


@query(f"SELECT conv_id, list_extract(regexp_extract_all(string_agg({LABELLED}, chr(10) ORDER BY turn), '(?m)^(USER(?:\\([^)\\n]{{1,64}}\\))?|ASSISTANT|TOOL|SYSTEM TRIGGER[^:\\n]*):', 1), -1) AS speaker FROM conversations GROUP BY 1".replace("\\\\", "\\"), plain=True)
def last_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", F.struct("turn", F.expr(LABELLED.replace("(conv_id % 3)", "CAST(conv_id % 3 AS STRING)")).alias("line")).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"])
    return c.groupBy("conv_id").agg(text.last_speaker(F.array_join(lines, "\n")).alias("speaker"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'u' || user_id WHEN event_id % 7 = 0 THEN 'u' || user_id WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'click' THEN 'c' WHEN event_type = 'view' THEN NULL ELSE 'u' || user_id END AS owner FROM events", plain=True)
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, user = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    people = F.array(F.struct(F.lit(" Click").alias("label"), F.lit("c").alias("user_id")), F.struct(F.lit("view").alias("label"), F.lit(None).cast("string").alias("user_id")))
    owner = text.attributed_user(F.when(i % 5 != 0, people), F.when(i % 11 != 0, F.col("event_type")), i % 7 != 0, user)
    return D.table(spark, sf_dir, "events").select("event_id", owner.alias("owner"))


@query("SELECT conv_id, turn, role FROM conversations", plain=True)
def answer_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read out of answers with thinking, fences and text around it."""
    c = D.table(spark, sf_dir, "conversations")
    answer = F.concat(F.lit("<think>{ or [</think>Here: ```json\n"), F.to_json(F.struct("conv_id", "turn", "role")), F.lit(" so far```"))
    return c.select(F.from_json(text.answer_json(answer), "conv_id long, turn long, role string").alias("j")).select("j.*")


@query("SELECT vec_id, label, '[' || len(embedding) || ' items]' AS embedding FROM embeddings", plain=True)
def inspector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.display(D.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("int")))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents('Áé ' || p_name || '  ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') || '-' || left(sha256(p_brand), 8) AS segment,
concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN 'p_brand=' || p_brand END, 'p_type=' || p_type) AS scope_key FROM part""", plain=True)
def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    keyed = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("p_brand"), "p_type").select("p_partkey", text.scope_key("p_brand", "p_type").alias("scope_key"))
    return p.select("p_partkey", text.slug(F.concat(F.lit("Áé "), F.concat_ws("  ", "p_name", "p_brand"))).alias("slug"), text.path_segment(F.col("p_brand")).alias("segment")).join(keyed, "p_partkey")


@query("SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, CAST('0x' || left(md5(w), 8) AS BIGINT) % 256 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\\s\\x0b]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)".replace("\\\\", "\\"), plain=True)
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of texts by hashed words."""
    return vectors.hashed_terms(D.table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 8 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM b) SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts) + INTERVAL 8 HOUR) AS ended, count(*) AS n FROM g GROUP BY user_id, part", plain=True)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap sessions of users over the events as a stream of files."""
    out = jobs.sessions(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema, "8 hours")
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("began"), F.unix_micros(F.col("end").cast("timestamp")).alias("ended"), "n")


@query("SELECT event_id, user_id, value FROM events", plain=True)
def json_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read under a fixed schema."""
    path = store.shared_path(spark)
    D.table(spark, sf_dir, "events").select("event_id", "user_id", "value").write.json(path)
    return store.read_events(spark, path, "event_id long, user_id long, value double")


@query("SELECT project, sha256(body) AS body_hash, count(*) AS n FROM (SELECT lang AS project, '---' || chr(10) || 'title: {\"title\":\"' || doc_id || '\"}' || chr(10) || 'tags: [\"' || lang || '\"]' || chr(10) || '---' || chr(10) || text AS body FROM documents WHERE text IS NOT NULL) GROUP BY ALL".replace('\\"', '"'), plain=True)
def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Markdown with front matter, by project, and read back."""
    path = store.shared_path(spark)
    d = D.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    store.write_vault(d.select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("title"), F.array("lang").alias("tags"), F.col("text").alias("body")), path)
    back = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), T.StructField("project", T.StringType())])).option("lineSep", "\n\0\n").text(path)
    return back.groupBy("project", F.sha2(F.col("value").cast("binary"), 256).alias("body_hash")).agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, CAST('0x' || left(md5(w), 8) AS BIGINT) % 256 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER d), 6) AS weight, 256 AS dim, 1.0 AS square, round(max(n) OVER d / sqrt(sum(n * n) OVER d), 6) AS most FROM w WINDOW d AS (PARTITION BY doc_id)""", plain=True)
def hashed_vectors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense unit vectors of all texts, as recall takes them: every number but the zeros by its place, and the vector's size, square and greatest share."""
    v = D.table(spark, sf_dir, "documents").select("doc_id", vectors.hashed_words(F.col("text")).alias("v"))
    whole = v.select("doc_id", "v", F.size("v").cast("long").alias("dim"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("square"), F.round(F.array_max("v"), 6).alias("most"))
    numbers = whole.select("doc_id", F.posexplode_outer("v").alias("bucket", "x"), "dim", "square", "most").filter("x > 0")  # outer, as Spark filters what an inner one explodes, and would embed each text twice for it
    return numbers.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("weight"), "dim", "square", "most")


@query("SELECT page_id AS id, sha256(html) AS sha256, octet_length(encode(html)) AS size, sha256(html) AS again, true AS sound, 0 AS swept FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'the same' ELSE html END AS html FROM pages) WHERE html IS NOT NULL", plain=True)
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored by content, every third alike, twice; read back and checked. Nothing is left to sweep."""
    root, i = store.shared_path(spark), F.col("page_id")
    rows = D.table(spark, sf_dir, "pages").select(i.alias("id"), F.when(i % 3 == 0, F.lit("the same")).otherwise(F.col("html")).cast("binary").alias("content")).filter("content IS NOT NULL")
    files.put_blobs(rows, root)
    refs = files.put_blobs(rows, root)
    swept = files.sweep_blobs(refs, root)
    return files.get_blobs(refs, root).select("id", "sha256", "size", F.sha2("content", 256).alias("again"), "sound", F.lit(swept).alias("swept"))


def _vault_docs(spark: SparkSession, sf_dir: str, renamed: bool) -> DataFrame:
    d, i = D.table(spark, sf_dir, "documents"), F.col("doc_id")
    title = F.concat(F.lit("Doc "), F.when((i % 10 == 1) & F.lit(renamed), "new").otherwise("old"))
    rows = d.select("doc_id", F.col("lang").alias("project_id"), title.alias("title"), F.array("source").alias("tags"), F.when((i % 20 == 2) & F.lit(renamed), "other").otherwise(F.col("text")).alias("body"))
    return rows.filter("doc_id % 10 <> 0") if renamed else rows


@query("""SELECT round, state, count(*) AS n FROM (SELECT 1 AS round, 'missing' AS state FROM documents UNION ALL SELECT 2, 'same' FROM documents
UNION ALL SELECT 3, unnest(CASE WHEN doc_id % 10 = 0 THEN ['orphan'] WHEN doc_id % 10 = 1 THEN ['orphan', 'missing'] WHEN doc_id % 20 = 2 AND text IS DISTINCT FROM 'other' THEN ['stale'] ELSE ['same'] END) FROM documents
UNION ALL SELECT 4, 'same' FROM documents WHERE doc_id % 10 <> 0) GROUP BY ALL""", plain=True)
def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files: written, written again, then with every tenth gone and others renamed or changed, and again: what state each run found."""
    root, out = store.shared_path(spark), []
    for n, renamed in enumerate((False, False, True, True), 1):
        found = files.write_vault_files(_vault_docs(spark, sf_dir, renamed), root, D.now())
        out.append(found.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(n).alias("round"), "state", "n"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT lang || '/doc-' || CASE WHEN doc_id % 10 = 1 THEN 'new' ELSE 'old' END || '--' || doc_id || '.md' AS path FROM documents WHERE doc_id % 10 <> 0", plain=True)
def vault_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real listing of a vault after documents went and were renamed."""
    root = store.shared_path(spark)
    for renamed in (False, True):
        files.write_vault_files(_vault_docs(spark, sf_dir, renamed), root, D.now())
    return files.listing(spark, root, "*.md").select("path")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'image/png' ELSE 'application/zip' END AS mime,
CASE page_id % 6 WHEN 4 THEN 'skipped' WHEN 5 THEN 'unsupported' ELSE 'done' END AS status,
CASE page_id % 6 WHEN 0 THEN 'Page ' || page_id || ' & more' WHEN 1 THEN '{"u":"' || url || '"}' WHEN 2 THEN 'id,url' || chr(10) || page_id || ',' || url WHEN 3 THEN 'é ' || url ELSE '' END AS text FROM pages""", plain=True)
def reader_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of six kinds, with and without a stated type, through the chain of readers."""
    i, url = F.col("page_id"), F.col("url")
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode(F.concat(F.lit("é "), url), "UTF-16LE"))
    body = F.when(i % 6 == 0, F.concat(F.lit("<!DOCTYPE html><p>Page "), i.cast("string"), F.lit(" &amp; more</p>"))).when(i % 6 == 1, F.to_json(F.struct(url.alias("u")), {"ignoreNullFields": "false"})).when(i % 6 == 2, F.concat(F.lit("id,url\n"), i.cast("string"), F.lit(","), url))
    content = F.when(i % 6 == 3, utf16).when(i % 6 == 4, F.unhex(F.lit("89504E470D0A1A0A"))).when(i % 6 == 5, F.unhex(F.lit("504B030400"))).otherwise(F.encode(body, "UTF-8"))
    pages = D.table(spark, sf_dir, "pages").select("page_id", content.alias("content"), F.when(i % 6 == 2, "Text/CSV; charset=utf-8").alias("mime"))
    return readers.extracted(pages).select("page_id", "mime", "status", "text")


RULES_SQL = "SELECT event_id, event_id // 400 = 1 AS large, event_id % 11 = 0 AS malformed, event_id % 7 = 0 AS no_user, event_id % 5 = 0 AND value IS NOT NULL AS no_value, event_type FROM events"


@query(f"WITH r AS ({RULES_SQL}), s AS (SELECT *, event_id // 400 AS b FROM r), t AS (SELECT s.*, count(*) OVER (PARTITION BY b) > 399 AND b % 4 = 1 AS big FROM s) SELECT 'accepted' AS rule, count(*) FILTER (WHERE NOT (malformed OR no_user OR no_value OR big)) AS n FROM t UNION ALL SELECT 'malformed', count(*) FILTER (WHERE malformed) FROM t UNION ALL SELECT 'user', count(*) FILTER (WHERE NOT malformed AND no_user) FROM t UNION ALL SELECT 'value', count(*) FILTER (WHERE NOT malformed AND no_value) FROM t UNION ALL SELECT 'batch_too_large', count(*) FILTER (WHERE big) FROM t UNION ALL SELECT 'replayed', count(*) FILTER (WHERE big AND NOT (malformed OR no_user OR no_value)) FROM t", plain=True)
def json_ingestion_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSON lines in batches, some lines malformed, some breaking rules, some batches too large: rows accepted, rules broken, and what goes in once large batches are cut."""
    e, i = D.table(spark, sf_dir, "events"), F.col("event_id")
    row = F.to_json(F.struct("event_id", F.when(i % 7 != 0, F.col("user_id")).alias("user_id"), F.when(i % 5 == 0, -F.abs("value") - 1).otherwise(F.col("value")).alias("value")))
    number = F.floor(i / 400)
    copies = F.when(number % 4 == 1, 1).otherwise(0)  # batches of 400 pass; those marked are held to 399
    lines = e.select((2 * number + copies).alias("batch"), F.when(i % 11 == 0, F.concat(row, F.lit("}{"))).otherwise(row).alias("line"))
    schema, rules = "event_id long, user_id long, value double", {"user": F.col("user_id").isNotNull(), "value": F.col("value") >= 0}
    held, free = lines.filter("batch % 2 = 1"), lines.filter("batch % 2 = 0")
    (a, p), (b, q) = ingest.ingested(held, schema, rules, 399), ingest.ingested(free, schema, rules)
    bad = store.cut(p.unionByName(q))
    again, _ = ingest.replayed(bad.filter(F.array_contains("broken", "batch_too_large")), F.col("line"), schema, rules)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    every = spark.createDataFrame([(r,) for r in ("malformed", "user", "value", "batch_too_large")], "rule string")
    return count(a.unionByName(b), "accepted").unionByName(every.join(ingest.report(bad), "rule", "left").select("rule", F.coalesce("n", F.lit(0).cast("long")).alias("n"))).unionByName(count(again, "replayed"))
