"""Recall: ranked lists, fusion, expansion, scoring; and point-in-time snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scope, scoring, temporal, vectors
from quillstone.operators import fulltext, lifecycle, retrieval
from quillstone.plans.registry import query
from quillstone.sources import derive as D
from quillstone.sources import store

WORDS = "purchase user 7 item"


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return D.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]  # one request's vector


PROBE = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
COS = f"list_cosine_similarity(embedding, {PROBE})"


@query("SELECT fact_id, entity_id, category, importance FROM facts f, params WHERE deleted_at IS NULL AND valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at) AND fact_id NOT IN (SELECT unnest(merged_from) FROM facts, params WHERE valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at))")
def fact_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.snapshot(D.facts(spark, sf_dir), D.at()).select("fact_id", "entity_id", "category", "importance")


@query("SELECT key, pref_id, value FROM preferences, params WHERE valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at) AND project_id IS NULL")
def preference_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.preferences(spark, sf_dir).filter(temporal.valid_at(D.at()) & F.col("project_id").eqNullSafe(F.lit(None))).select("key", "pref_id", "value")


@query(f"SELECT fact_id, round({COS}, 6) AS raw, round((1 + {COS}) / 2, 6) AS score FROM fact_vectors, params WHERE deleted_at IS NULL AND valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at) AND (project_id = 'p1' OR project_id IS NULL) ORDER BY round((1 + {COS}) / 2, 9) DESC, fact_id LIMIT 20")
def fact_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = temporal.visible() & temporal.valid_at(D.at()) & scope.allows({"project_id": "p1"}, "filter", ("project_id",))
    rows = D.with_vectors(spark, sf_dir, D.facts(spark, sf_dir).filter(where))
    raw = vectors.cosine(F.col("embedding"), F.array(*map(F.lit, _probe(spark, sf_dir))))
    return rows.withColumn("raw", raw).withColumn("s", F.round(vectors.index_score(F.col("raw")), 9)).orderBy(F.col("s").desc(), "fact_id").limit(20).select("fact_id", F.round("raw", 6).alias("raw"), F.round("s", 6).alias("score"))


@query(f"SELECT vec_id, label, round((1 + {COS}) / 2, 6) AS score FROM embeddings_d WHERE (1 + {COS}) / 2 >= 0.6".replace("embeddings_d", "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"))
def vector_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = vectors.cosine(F.col("embedding"), F.array(*map(F.lit, _probe(spark, sf_dir))))
    return D.table(spark, sf_dir, "embeddings").withColumn("s", vectors.index_score(raw)).filter("s >= 0.6").select("vec_id", F.col("label").cast("int").alias("label"), F.round("s", 6).alias("score"))


@query(f", o AS (SELECT o.*, CAST(embedding AS DOUBLE[]) AS embedding FROM observations o JOIN embeddings ON obs_id % (SELECT count(*) FROM embeddings) = vec_id) SELECT obs_id, round((1 + {COS}) / 2, 6) AS score FROM o, params WHERE session_id = 's7' AND expires_at > t_at ORDER BY round((1 + {COS}) / 2, 9) DESC, obs_id LIMIT 20")
def observation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.observations(spark, sf_dir).filter((F.col("session_id") == "s7") & temporal.live(D.at()))
    rows = D.with_vectors(spark, sf_dir, own, "obs_id")
    raw = vectors.cosine(F.col("embedding"), F.array(*map(F.lit, _probe(spark, sf_dir))))
    return rows.withColumn("s", F.round(vectors.index_score(raw), 9)).orderBy(F.col("s").desc(), "obs_id").limit(20).select("obs_id", F.round("s", 6).alias("score"))


BM25 = """, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM documents),
n AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM w),
q AS (SELECT unnest(['license', 'released', 'under']) AS term),
h AS (SELECT doc_id, q.term, CAST(len(list_filter(terms, lambda t: t = q.term)) AS DOUBLE) AS tf, CAST(len(terms) AS DOUBLE) AS len FROM w, q WHERE list_contains(terms, q.term)),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h JOIN d USING (term), n GROUP BY doc_id) ORDER BY round(score, 9) DESC, doc_id LIMIT 50"""


@query(BM25)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(D.table(spark, sf_dir, "documents"), "doc_id", "text", "released under license", 50).select("doc_id", F.round("score", 6).alias("score"))


INDEXED = "(SELECT * FROM documents WHERE doc_id % 7 <> 0)"


@query(BM25.replace("FROM documents)", f"FROM {INDEXED})").replace("['license', 'released', 'under']", "['license', 'mit', 'released', 'the', 'under']"))
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search in a stored index: two thirds of the documents, then the rest, added; every seventh deleted."""
    d, path = D.table(spark, sf_dir, "documents"), store.shared_path(spark)
    for part in (d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0")):
        fulltext.add(part, path, "doc_id", "text", "plain")
    fulltext.delete(d.filter("doc_id % 7 = 0"), path, "doc_id", "text", "plain")
    found = fulltext.search(spark, path, "Released under the MIT license", 50, "plain")
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


FT = """, w AS (SELECT fact_id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM facts, params WHERE deleted_at IS NULL AND valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at)),
n AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM w), q AS (SELECT unnest(['purchase', 'user', '7', 'item']) AS term),
h AS (SELECT fact_id, q.term, CAST(len(list_filter(terms, lambda t: t = q.term)) AS DOUBLE) AS tf, CAST(len(terms) AS DOUBLE) AS len FROM w, q WHERE list_contains(terms, q.term)),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
ft AS (SELECT fact_id, row_number() OVER (ORDER BY round(score, 9) DESC, fact_id) AS place FROM (SELECT fact_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h JOIN d USING (term), n GROUP BY fact_id) ORDER BY place LIMIT 60),
"""
RECALL = FT + f"""vs AS (SELECT fact_id, row_number() OVER (ORDER BY round((1 + {COS}) / 2, 9) DESC, fact_id) AS place FROM fact_vectors, params WHERE deleted_at IS NULL AND valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at) AND (project_id = 'p1' OR project_id IS NULL) ORDER BY place LIMIT 60),
fused AS (SELECT fact_id, sum(1.0::DOUBLE / (60 + place)) AS fused, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT *, 'fulltext' AS source FROM ft UNION ALL SELECT *, 'vector' FROM vs) GROUP BY fact_id),
seed AS (SELECT DISTINCT entity_id FROM (SELECT fact_id FROM fused ORDER BY round(fused, 9) DESC, fact_id LIMIT 20) JOIN facts USING (fact_id)),
sib AS (SELECT fact_id, row_number() OVER (ORDER BY recorded_at DESC, fact_id) AS place FROM facts f WHERE deleted_at IS NULL AND valid_to IS NULL AND entity_id IN (SELECT entity_id FROM seed) AND fact_id NOT IN (SELECT fact_id FROM fused) ORDER BY place LIMIT 20),
cand AS (SELECT c.*, f.* EXCLUDE (fact_id) FROM (SELECT * FROM fused UNION ALL SELECT fact_id, 1.0::DOUBLE / (60 + place), 'sibling' FROM sib) c JOIN facts f USING (fact_id), params WHERE deleted_at IS NULL AND valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at) AND (project_id = 'p1' OR project_id IS NULL)),
scored AS (SELECT fact_id, sources, (0.5 * fused / (SELECT max(fused) FROM cand) + 0.2 * importance + 0.1 * confidence + 0.1 * pow(0.5, greatest(0, epoch_us(t_at) - epoch_us(recorded_at)) / 86400000000.0 / 30) + 0.1 * least(1, ln(1 + reference_count) / ln(11)))
  * CASE WHEN sources = 'sibling' THEN 0.5 ELSE 1.0 END * CASE WHEN agent_id = 'a1' THEN 1.15 ELSE 1.0 END * CASE WHEN session_id = 's7' THEN 1.05 ELSE 1.0 END AS blended FROM cand, params)
SELECT fact_id, sources, round(CAST(blended AS DOUBLE), 6) AS score FROM scored ORDER BY round(CAST(blended AS DOUBLE), 9) DESC, fact_id LIMIT 20"""


@query(RECALL)
def recall_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and full-text lists, fused, widened by siblings, filtered, blended, cut to the best."""
    facts = D.facts(spark, sf_dir)
    valid = facts.filter(temporal.visible() & temporal.valid_at(D.at()))
    own = scope.allows({"project_id": "p1"}, "filter", ("project_id",))
    near = retrieval.nearest(D.with_vectors(spark, sf_dir, valid.filter(own)), "fact_id", _probe(spark, sf_dir), 60)
    found = retrieval.bm25(valid, "fact_id", "content", WORDS, 60)
    fused = retrieval.fuse([retrieval.ranked(near, "fact_id", "vector"), retrieval.ranked(found, "fact_id", "fulltext")], "fact_id")
    every = fused.unionByName(retrieval.siblings(fused, facts, 20, 20))
    kept = every.join(valid.filter(own), "fact_id").withColumn("last_used", F.lit(None).cast("timestamp"))
    best = retrieval.blended(kept, D.at(), agent="a1", session="s7").withColumn("s", F.round("blended", 9)).orderBy(F.col("s").desc(), "fact_id").limit(20)
    return best.select("fact_id", "sources", F.round("s", 6).alias("score"))


@query(FT + "x AS (SELECT 1) SELECT fact_id, place AS rank_after, CAST(place AS BIGINT) AS place FROM ft")
def fulltext_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = D.facts(spark, sf_dir).filter(temporal.visible() & temporal.valid_at(D.at()))
    r = retrieval.ranked(retrieval.bm25(valid, "fact_id", "content", WORDS, 60), "fact_id", "fulltext")
    return r.select("fact_id", (F.col("rank") + 1).cast("long").alias("rank_after"), (F.col("rank") + 1).cast("long").alias("place"))


@query(""", l AS (SELECT fact_id, 'a' AS source, row_number() OVER (ORDER BY importance DESC, fact_id) AS place FROM facts QUALIFY place <= 100 UNION ALL SELECT fact_id, 'b', row_number() OVER (ORDER BY confidence DESC, fact_id) AS place FROM facts QUALIFY place <= 100)
SELECT fact_id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS fused, string_agg(source, ',' ORDER BY source) AS sources FROM l GROUP BY fact_id""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = D.facts(spark, sf_dir)
    lists = [retrieval.ranked(facts.orderBy(F.col(c).desc(), "fact_id").limit(100), "fact_id", s, c) for c, s in (("importance", "a"), ("confidence", "b"))]
    return retrieval.fuse(lists, "fact_id").select("fact_id", F.round("fused", 9).alias("fused"), "sources")


@query("""SELECT kind, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, id) AS nth FROM (
SELECT 'fact' AS kind, fact_id AS id, importance AS score FROM facts UNION ALL SELECT 'preference', pref_id, 0.8 * pow(0.5, greatest(0, epoch_us(t_now) - epoch_us(valid_from)) / 86400000000.0 / 30) FROM preferences, params WHERE valid_to IS NULL
UNION ALL SELECT 'observation', obs_id, pow(0.5, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 / 30) FROM observations, params)) WHERE nth <= 10""")
def top_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = lambda c: scoring.recency(temporal.days_since(F.col(c), D.now()))
    a = D.facts(spark, sf_dir).select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.col("importance").alias("score"))
    b = D.preferences(spark, sf_dir).filter("valid_to IS NULL").select(F.lit("preference").alias("kind"), F.col("pref_id").alias("id"), (0.8 * recent("valid_from")).alias("score"))
    c = D.observations(spark, sf_dir).select(F.lit("observation").alias("kind"), F.col("obs_id").alias("id"), recent("recorded_at").alias("score"))
    return retrieval.top_per_kind(a.unionByName(b).unionByName(c), "score", "id", 10).select("kind", "id", F.round("score", 6).alias("score"))


@query("SELECT fact_id, round(pow(0.5, d / 30), 6) AS recency, round(least(1, ln(1 + reference_count) / ln(11)), 6) AS used, round(exp(-d / ((1 + 2 * reference_count) * (1 + 4 * importance))), 6) AS retention, importance < 0.75 AND d >= 30 AND exp(-d / ((1 + 2 * reference_count) * (1 + 4 * importance))) < 0.05 AS prune FROM (SELECT *, greatest(0, epoch_us(t_now) - epoch_us(recorded_at)) / 86400000000.0 AS d FROM facts, params)")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = temporal.days_since(F.col("recorded_at"), D.now())
    n, i = F.col("reference_count"), F.col("importance")
    return D.facts(spark, sf_dir).select("fact_id", F.round(scoring.recency(d), 6).alias("recency"), F.round(scoring.use(n), 6).alias("used"), F.round(scoring.retention(d, n, i), 6).alias("retention"), scoring.should_prune(d, n, i).alias("prune"))


@query("""SELECT mode, count(*) FILTER (WHERE ok) AS admitted FROM (SELECT mode, CASE mode WHEN 'filter' THEN (project_id = 'p1' OR project_id IS NULL) AND (agent_id = 'a1' OR agent_id IS NULL) WHEN 'strict' THEN coalesce(project_id = 'p1' AND agent_id = 'a1', false) ELSE true END AS ok FROM facts, (SELECT unnest(['boost', 'filter', 'strict', 'none']) AS mode)) GROUP BY mode""")
def scope_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, q = D.facts(spark, sf_dir), {"project_id": "p1", "agent_id": "a1"}
    one = facts.agg(*(F.count_if(scope.allows(q, m)).alias(m) for m in ("boost", "filter", "strict", "none")))
    return one.unpivot([], ["boost", "filter", "strict", "none"], "mode", "admitted")


@query("SELECT fact_id, round(CASE WHEN project_id = 'p1' THEN 1.2 ELSE 1.0 END * CASE WHEN user_id = 'u7' THEN 1.1 ELSE 1.0 END, 6) AS boost FROM facts")
def scope_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facts(spark, sf_dir).select("fact_id", F.round(scope.boost({"project_id": "p1", "user_id": "u7"}, "boost"), 6).cast("double").alias("boost"))


@query("SELECT fact_id FROM facts WHERE (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10') AND valid_from <= TIMESTAMP '2024-01-12' AND importance >= 0.5 AND confidence >= 0.6 AND category IN ('click', 'view')")
def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = temporal.overlaps(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return D.facts(spark, sf_dir).filter(inside & (F.col("importance") >= 0.5) & (F.col("confidence") >= 0.6) & F.col("category").isin("click", "view")).select("fact_id")


@query("SELECT fact_id FROM facts WHERE (project_id = 'p1' OR project_id IS NULL) AND user_id = 'u3' AND valid_to IS NULL AND deleted_at IS NULL")
def dedup_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facts(spark, sf_dir).filter(scope.same_bucket("p1", "u3", unscoped_too=True) & F.col("valid_to").isNull() & temporal.visible()).select("fact_id")


@query("SELECT c.chunk_id, d.chunk_id AS near_id FROM chunks c JOIN chunks d ON c.episode_id = d.episode_id AND abs(c.position - d.position) BETWEEN 1 AND 2 WHERE c.role = 'assistant'")
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks within two places, by offsets: an equal join on episode and place, whatever an episode's length."""
    c = D.chunks(spark, sf_dir)
    wanted = c.filter("role = 'assistant'").select("episode_id", "chunk_id", F.explode(F.array(*(F.col("position") + i for i in (-2, -1, 1, 2)))).alias("position"))
    return wanted.join(c.select("episode_id", "position", F.col("chunk_id").alias("near_id")), ["episode_id", "position"]).select("chunk_id", "near_id")


@query("SELECT f.fact_id, coalesce(o.agent_id, f.agent_id) AS origin_agent FROM facts f LEFT JOIN facts o ON o.fact_id = f.supersedes_id")
def origin_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.facts(spark, sf_dir)
    o = f.select(F.col("fact_id").alias("supersedes_id"), F.col("agent_id").alias("origin"))
    return f.join(o, "supersedes_id", "left").select("fact_id", F.coalesce("origin", "agent_id").alias("origin_agent"))


@query("SELECT f.fact_id, CAST(count(DISTINCT s.fact_id) AS BIGINT) AS n_siblings FROM facts f JOIN facts s ON s.entity_id = f.entity_id AND s.fact_id <> f.fact_id AND s.valid_to IS NULL AND s.deleted_at IS NULL WHERE f.importance >= 0.97 GROUP BY f.fact_id")
def sibling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by entity first, so that no pairs are made."""
    f = D.facts(spark, sf_dir)
    own = (F.col("valid_to").isNull() & temporal.visible()).cast("int")
    n = F.sum(own).over(Window.partitionBy("entity_id")) - own
    return f.withColumn("n_siblings", n.cast("long")).filter("importance >= 0.97 AND n_siblings > 0").select("fact_id", "n_siblings")
