"""Recall over all kinds, and the lists and ledgers of each kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scope, temporal, text
from quillstone.operators import graph, recall
from quillstone.plans.recall import COS, WORDS, _probe
from quillstone.plans.registry import query
from quillstone.sources import derive as D
from quillstone.sources import store

ITEM = ["kind", "id", "content", "project_id", "user_id", "agent_id", "session_id", "valid_from", "valid_to", "seen_at", "redacted", "live", "importance", "confidence", "used", "entity_id"]
TYPES = dict(zip(ITEM, ["string", "long", "string", "string", "string", "string", "string", "timestamp", "timestamp", "timestamp", "boolean", "boolean", "double", "double", "long", "long"]))


def _item(df: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    """Rows of one kind in the form of all: what isn't given is null, or not redacted, or live."""
    plain: dict[str, Column] = {"kind": F.lit(kind), "redacted": F.lit(False), "live": F.lit(True)} | {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    return df.select(*(plain.get(c, F.lit(None)).cast(TYPES[c]).alias(c) for c in ITEM))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of memory as one table."""
    scopes = {a: a for a in scope.AXES}
    f, e, i = D.facts(spark, sf_dir), D.episodes(spark, sf_dir).drop("turns", "summary_kind"), F.col
    t = lambda name: D.table(spark, sf_dir, name)
    project = lambda key: F.when(i(key) % 3 != 0, D.named("p", i(key) % 4))
    own = [
        _item(f, "fact", id="fact_id", content="content", valid_from="valid_from", valid_to="valid_to", seen_at="recorded_at", redacted=i("deleted_at").isNotNull(), importance="importance", confidence="confidence", used="reference_count", entity_id="entity_id", **scopes),
        _item(D.chunks(spark, sf_dir).join(e, "episode_id"), "chunk", id="chunk_id", content="text", seen_at="recorded_at", **scopes),
        _item(D.preferences(spark, sf_dir), "preference", id="pref_id", content="key", project_id="project_id", valid_from="valid_from", valid_to="valid_to", seen_at="valid_from", confidence=F.lit(0.9)),
        _item(f.filter("importance >= 0.9"), "insight", id="fact_id", content=F.concat(F.lit("insight "), "content"), project_id="project_id", user_id="user_id", seen_at="recorded_at", live=i("deleted_at").isNull() & i("pruned_at").isNull()),
        _item(D.observations(spark, sf_dir), "observation", id="obs_id", content="content", session_id="session_id", seen_at="recorded_at", live=i("expires_at") > D.at()),
        _item(t("documents"), "knowledge_chunk", id="doc_id", content="text", project_id=project("doc_id"), seen_at=D.since(i("doc_id") * 60), live=i("doc_id") % 9 != 0),
        _item(t("part"), "procedure", id="p_partkey", content="p_name", seen_at=D.since(i("p_partkey") * 60), importance=(i("p_size") % 10) / 10.0),
        _item(t("pages"), "research", id="page_id", content="url", project_id=D.named("p", i("page_id") % 4), seen_at=D.since(i("page_id") * 60)),
        _item(t("pages"), "research_chunk", id="page_id", content="url", project_id=D.named("p", i("page_id") % 4), seen_at=D.since(i("page_id") * 60)),
        _item(t("orders"), "intention", id="o_orderkey", content="o_orderpriority", project_id=project("o_orderkey"), user_id=D.named("u", i("o_orderkey") % 10), seen_at=D.since(i("o_orderkey") * 60), live=i("o_orderkey") % 7 != 0),
    ]
    return reduce(DataFrame.unionByName, own)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk a fact was taken from: chunk_id, fact_id."""
    c, f = D.chunks(spark, sf_dir), D.facts(spark, sf_dir)
    return c.select("chunk_id", F.col("episode_id").alias("entity_id"), (F.col("position") % 3).alias("third")).join(f.select("fact_id", "entity_id", (F.col("fact_id") % 3).alias("third")), ["entity_id", "third"]).select("chunk_id", "fact_id")


def _row(kind: str, source: str, **columns: str) -> str:
    plain = {"kind": f"'{kind}'", "redacted": "false", "live": "true"} | columns
    return f"SELECT {', '.join(plain.get(c, 'CAST(NULL AS ' + TYPES[c].replace('string', 'varchar').replace('long', 'bigint') + ')') + ' AS ' + c for c in ITEM)} FROM {source}"


def _since(key: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_seconds({key} * 60)"


SCOPES = {a: a for a in scope.AXES}
ITEMS_SQL = ", items AS (" + " UNION ALL ".join([
    _row("fact", "facts", id="fact_id", content="content", valid_from="valid_from", valid_to="valid_to", seen_at="recorded_at", redacted="deleted_at IS NOT NULL", importance="importance", confidence="confidence", used="reference_count", entity_id="entity_id", **SCOPES),
    _row("chunk", "chunks JOIN episodes USING (episode_id)", id="chunk_id", content="text", seen_at="recorded_at", **SCOPES),
    _row("preference", "preferences", id="pref_id", content="key", project_id="project_id", valid_from="valid_from", valid_to="valid_to", seen_at="valid_from", confidence="0.9::DOUBLE"),
    _row("insight", "facts WHERE importance >= 0.9", id="fact_id", content="'insight ' || content", project_id="project_id", user_id="user_id", seen_at="recorded_at", live="deleted_at IS NULL AND pruned_at IS NULL"),
    _row("observation", "observations, params", id="obs_id", content="content", session_id="session_id", seen_at="recorded_at", live="expires_at > t_at"),
    _row("knowledge_chunk", "documents", id="doc_id", content="text", project_id="CASE WHEN doc_id % 3 <> 0 THEN 'p' || (doc_id % 4) END", seen_at=_since("doc_id"), live="doc_id % 9 <> 0"),
    _row("procedure", "part", id="p_partkey", content="p_name", seen_at=_since("p_partkey"), importance="(p_size % 10) / 10.0::DOUBLE"),
    _row("research", "pages", id="page_id", content="url", project_id="'p' || (page_id % 4)", seen_at=_since("page_id")),
    _row("research_chunk", "pages", id="page_id", content="url", project_id="'p' || (page_id % 4)", seen_at=_since("page_id")),
    _row("intention", "orders", id="o_orderkey", content="o_orderpriority", project_id="CASE WHEN o_orderkey % 3 <> 0 THEN 'p' || (o_orderkey % 4) END", user_id="'u' || (o_orderkey % 10)", seen_at=_since("o_orderkey"), live="o_orderkey % 7 <> 0"),
]) + ")"
AT = "valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at)"
P1, U7, A1, S7 = "(project_id IS NULL OR project_id = 'p1')", "(user_id IS NULL OR user_id = 'u7')", "(agent_id IS NULL OR agent_id = 'a1')", "(session_id IS NULL OR session_id = 's7')"
ALL_KINDS = ("fact", "chunk", "preference", "insight", "observation", "knowledge_chunk", "procedure", "research", "research_chunk", "intention")
PUSHED = f"NOT redacted AND live AND (kind NOT IN ('fact', 'preference') OR {AT}) AND CASE WHEN kind = 'chunk' THEN true WHEN kind IN ('observation', 'intention') THEN {P1} AND {U7} AND {A1} AND {S7} ELSE {P1} AND {U7} END AND (kind <> 'observation' OR session_id = 's7')"
RECALL_ALL = ITEMS_SQL + f""", near AS (SELECT kind, id, 'vector' AS source, row_number() OVER (PARTITION BY kind ORDER BY round((1 + {COS}) / 2, 9) DESC, id) AS place
  FROM (SELECT i.*, CAST(v.embedding AS DOUBLE[]) AS embedding FROM items i JOIN embeddings v ON i.id % (SELECT count(*) FROM embeddings) = v.vec_id), params WHERE {PUSHED} QUALIFY place <= 60),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS terms FROM items, params WHERE kind IN ('fact', 'chunk', 'knowledge_chunk', 'procedure', 'research_chunk') AND CASE WHEN kind = 'fact' THEN {AT} AND NOT redacted ELSE {PUSHED} END),
n AS (SELECT kind, count(*) AS docs, avg(len(terms)) AS mean FROM w GROUP BY kind), q AS (SELECT unnest(['item', 'purchase', 'ring', 'the', 'user', '7']) AS term),
h AS (SELECT kind, id, q.term, CAST(len(list_filter(terms, lambda t: t = q.term)) AS DOUBLE) AS tf, CAST(len(terms) AS DOUBLE) AS len FROM w, q WHERE list_contains(terms, q.term)),
d AS (SELECT kind, term, count(*) AS df FROM h GROUP BY ALL),
ft AS (SELECT kind, id, 'fulltext' AS source, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, id) AS place FROM (SELECT kind, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h JOIN d USING (kind, term) JOIN n USING (kind) GROUP BY kind, id) QUALIFY place <= 60),
cl AS (SELECT fact_id, chunk_id FROM facts JOIN chunks ON episode_id = entity_id AND position % 3 = fact_id % 3 WHERE valid_to IS NULL AND deleted_at IS NULL),
cd AS (SELECT 'fact' AS kind, fact_id AS id, 'chunk_derived' AS source, row_number() OVER (ORDER BY min(place), fact_id) AS place FROM cl JOIN (SELECT id AS chunk_id, min(place) AS place FROM (SELECT * FROM near UNION ALL SELECT * FROM ft) WHERE kind = 'chunk' GROUP BY 1) USING (chunk_id) GROUP BY fact_id),
fused AS (SELECT kind, id, sum(1.0::DOUBLE / (60 + place)) AS fused, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT * FROM near UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM cd) GROUP BY kind, id),
seed AS (SELECT DISTINCT entity_id FROM (SELECT id FROM fused WHERE kind = 'fact' ORDER BY round(fused, 9) DESC, id LIMIT 20) JOIN facts ON fact_id = id WHERE deleted_at IS NULL),
sib AS (SELECT fact_id, row_number() OVER (ORDER BY recorded_at DESC, fact_id) AS place FROM facts WHERE deleted_at IS NULL AND valid_to IS NULL AND entity_id IN (SELECT entity_id FROM seed) AND fact_id NOT IN (SELECT id FROM fused WHERE kind = 'fact') ORDER BY place LIMIT 20),
nb AS (SELECT DISTINCT b.id + o AS id FROM (SELECT id FROM fused WHERE kind = 'chunk' ORDER BY round(fused, 9) DESC, id LIMIT 10) b, (SELECT unnest([-1, 1]) AS o)),
cand AS (SELECT * FROM fused UNION ALL SELECT 'fact', fact_id, 1.0::DOUBLE / (60 + place), 'sibling' FROM sib
  UNION ALL SELECT 'chunk', id, 0.3 * (SELECT max(fused) FROM fused WHERE kind = 'chunk'), 'neighbour' FROM nb WHERE id IN (SELECT chunk_id FROM chunks) AND id NOT IN (SELECT id FROM fused WHERE kind = 'chunk')),
kept AS (SELECT c.fused, c.sources, i.* FROM cand c JOIN items i USING (kind, id), params WHERE NOT redacted AND (kind NOT IN ('fact', 'preference') OR {AT}) AND ({P1} AND {U7} AND {A1} AND {S7} OR kind = 'intention') AND (kind <> 'fact' OR importance >= 0.1 AND confidence >= 0.5 AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-02'))),
b AS (SELECT kind, id, sources, count(*) OVER (PARTITION BY kind) AS n_before, fused / max(fused) OVER (PARTITION BY kind) AS rrf, importance, confidence, used, agent_id, session_id, pow(0.5, greatest(0, epoch_us(t_now) - epoch_us(seen_at)) / 86400000000.0 / 30) AS rec FROM kept, params),
s AS (SELECT *, CAST(CASE kind WHEN 'fact' THEN (0.5 * rrf + 0.2 * importance + 0.1 * confidence + 0.1 * rec + 0.1 * least(1, ln(1 + used) / ln(11))) * CASE sources WHEN 'sibling' THEN 0.5 WHEN 'chunk_derived' THEN 0.8 ELSE 1.0 END * CASE WHEN agent_id = 'a1' THEN 1.15 ELSE 1.0 END * CASE WHEN session_id = 's7' THEN 1.05 ELSE 1.0 END
  WHEN 'preference' THEN 0.8 * rrf + 0.1 * confidence + 0.1 * rec WHEN 'procedure' THEN 0.7 * rrf + 0.2 * importance + 0.1 * rec ELSE 0.9 * rrf + 0.1 * rec END AS DOUBLE) AS score FROM b)
SELECT kind, id, sources, n_before, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, id) <= 20"""


def request(spark: SparkSession, sf_dir: str, **changes: object) -> recall.Request:
    plain = {"kinds": ALL_KINDS, "scopes": {"project_id": "p1", "user_id": "u7", "agent_id": "a1", "session_id": "s7"}, "min_importance": 0.1, "min_confidence": 0.5, "overlap": (F.lit("2024-01-02").cast("timestamp"), D.now())}
    return recall.Request(_probe(spark, sf_dir), f"{WORDS} the ring", D.now(), D.at(), **(plain | changes))


def state(spark: SparkSession, sf_dir: str, asked: recall.Request) -> recall.State:
    """Items are written once, without vectors, as several stages read them."""
    number = F.split_part("entity", F.lit(":"), F.lit(2)).cast("long")
    named = D.mentions(spark, sf_dir)
    entities = D.with_vectors(spark, sf_dir, named.select("entity").distinct().withColumn("number", number), "number").select("entity", "embedding")
    from_episode = D.episodes(spark, sf_dir).select(F.col("episode_id").alias("entity_id"), "agent_id", "session_id")
    origins = D.facts(spark, sf_dir).select("fact_id", "entity_id").join(from_episode, "entity_id").select("fact_id", "agent_id", "session_id")
    rows = store.cut(items(spark, sf_dir))
    return recall.State(asked, rows, links(spark, sf_dir), vectors=lambda few: D.with_vectors(spark, sf_dir, few, "id"), chunks=D.chunks(spark, sf_dir), mentions=named, entities=entities, origins=origins)


HEAD_SQL = RECALL_ALL[: RECALL_ALL.index(",\ncl AS")].replace("FROM items, params WHERE kind IN ('fact', 'chunk', 'knowledge_chunk', 'procedure', 'research_chunk')", "FROM items, params WHERE kind = 'fact'").replace("v.vec_id), params WHERE NOT", "v.vec_id), params WHERE kind = 'fact' AND NOT")
STEPS = ", ".join(f"r{i} AS MATERIALIZED (SELECT node, sum(x) AS rank FROM (SELECT node, 0.15::DOUBLE AS x FROM seeds UNION ALL SELECT f.dst, 0.85::DOUBLE * r.rank / f.degree FROM r{i - 1} r JOIN flow f ON f.src = r.node) GROUP BY node)" for i in range(1, 7))
RECALL_FULL = HEAD_SQL + f""", linked AS (SELECT entity AS node FROM (SELECT DISTINCT entity FROM mentions) JOIN embeddings ON CAST(split_part(entity, ':', 2) AS INT) % (SELECT count(*) FROM embeddings) = vec_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) DESC, entity LIMIT 5),
best AS (SELECT id FROM (SELECT * FROM near UNION ALL SELECT * FROM ft) GROUP BY id ORDER BY min(place), id LIMIT 10),
seeds AS (SELECT node FROM linked UNION SELECT entity FROM mentions WHERE fact_id IN (SELECT id FROM best)),
ways AS (SELECT entity AS src, 'fact:' || fact_id AS dst FROM mentions UNION ALL SELECT 'fact:' || fact_id, entity FROM mentions), flow AS MATERIALIZED (SELECT a.src, a.dst, d.degree FROM ways a JOIN (SELECT src, count(*) AS degree FROM ways GROUP BY src) d USING (src)),
r0 AS (SELECT node, 0.15::DOUBLE AS rank FROM seeds), {STEPS},
walked AS (SELECT fact_id AS id, row_number() OVER (ORDER BY round(rank, 12) DESC, fact_id) AS place FROM r6 JOIN facts ON node = 'fact:' || fact_id WHERE rank > 0 AND valid_to IS NULL AND deleted_at IS NULL AND fact_id NOT IN (SELECT id FROM near UNION SELECT id FROM ft) ORDER BY place LIMIT 30),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + place)) AS fused, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT id, source, place FROM near UNION ALL SELECT id, source, place FROM ft UNION ALL SELECT id, 'graph', place FROM walked) GROUP BY id),
seed AS (SELECT DISTINCT entity_id FROM (SELECT id FROM fused ORDER BY round(fused, 9) DESC, id LIMIT 20) JOIN facts ON fact_id = id WHERE deleted_at IS NULL),
sib AS (SELECT fact_id, row_number() OVER (ORDER BY recorded_at DESC, fact_id) AS place FROM facts WHERE deleted_at IS NULL AND valid_to IS NULL AND entity_id IN (SELECT entity_id FROM seed) AND fact_id NOT IN (SELECT id FROM fused) ORDER BY place LIMIT 20),
cand AS (SELECT id, fused, sources FROM fused UNION ALL SELECT fact_id, 1.0::DOUBLE / (60 + place), 'sibling' FROM sib),
kept AS (SELECT c.fused, c.sources, i.*, e.agent_id AS origin_agent, e.session_id AS origin_session FROM cand c JOIN items i ON i.kind = 'fact' AND i.id = c.id LEFT JOIN episodes e ON e.episode_id = i.entity_id, params WHERE NOT redacted AND {AT} AND (i.project_id IS NULL OR i.project_id = 'p1')),
b AS (SELECT *, count(*) OVER () AS n_before, fused / max(fused) OVER () AS rrf, pow(0.5, greatest(0, epoch_us(t_now) - epoch_us(seen_at)) / 86400000000.0 / 30) AS rec FROM kept, params),
s AS (SELECT *, CAST((0.5 * rrf + 0.2 * importance + 0.1 * confidence + 0.1 * rec + 0.1 * least(1, ln(1 + used) / ln(11))) * CASE sources WHEN 'sibling' THEN 0.5 WHEN 'graph' THEN 0.5 ELSE 1.0 END
  * CASE WHEN coalesce(origin_agent, agent_id) = 'a1' THEN 1.15 ELSE 1.0 END * CASE WHEN coalesce(origin_session, session_id) = 's7' THEN 1.05 ELSE 1.0 END AS DOUBLE) AS score FROM b),
w20 AS (SELECT id, content, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS nth FROM s QUALIFY nth <= 20),
told AS (SELECT id, nth, row_number() OVER (ORDER BY length(content) % 7 DESC, id) AS place FROM w20 QUALIFY place <= 10)
SELECT id, sources, n_before, round(score, 6) AS score, place, coalesce(place < nth, false) AS promoted, coalesce((SELECT string_agg(DISTINCT entity, ',' ORDER BY entity) FROM mentions m WHERE m.fact_id = s.id), '') AS entities FROM s LEFT JOIN told USING (id) QUALIFY row_number() OVER (ORDER BY place NULLS LAST, round(score, 9) DESC, id) <= 20"""


@query(RECALL_FULL.replace(P1 + " AND " + U7 + " AND " + A1 + " AND " + S7, P1).replace(P1 + " AND " + U7, P1))
def recall_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by all stages: entities linked to the request, the walk's list, origins, a reranker (here by length), and the entities of what stays."""
    asked = request(spark, sf_dir, kinds=("fact",), scopes={"project_id": "p1"}, own={"agent_id": "a1", "session_id": "s7"}, min_importance=None, min_confidence=None, overlap=None)
    by = lambda rows, words: rows.select("id", (F.length("content") % 7).alias("by"))
    found = recall.recall(state(spark, sf_dir, asked), recall.full_stages(by, iterations=6))
    return found.select("id", "sources", "n_before", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"), F.coalesce("promoted", F.lit(False)).alias("promoted"), F.array_join("entities", ",").alias("entities"))


@query(RECALL_ALL)
def recall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request over ten kinds: vector and full-text lists, facts of found chunks, fusion, siblings, neighbours, filters, blends, the best of each kind."""
    found = recall.recall(state(spark, sf_dir, request(spark, sf_dir)))
    return found.select("kind", "id", "sources", "n_before", F.round("score", 6).alias("score"))


@query(RECALL_ALL.replace("FROM s QUALIFY", "FROM s WHERE kind IN ('fact', 'preference', 'insight') QUALIFY").replace("'p1'", "'p2'").replace("SELECT * FROM near UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM cd", "SELECT * FROM near UNION ALL SELECT * FROM ft"))
def recall_default_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds that a request includes unless it says otherwise, by a list of stages without chunks."""
    asked = request(spark, sf_dir, kinds=recall.DEFAULT, scopes={"project_id": "p2", "user_id": "u7", "agent_id": "a1", "session_id": "s7"})
    stages = [s for s in recall.STAGES if s not in (recall.chunk_facts, recall.neighbours)]
    found = recall.recall(state(spark, sf_dir, asked), stages)
    return found.select("kind", "id", "sources", "n_before", F.round("score", 6).alias("score"))


#: Lists of each kind: its rows, an order, and how many.
@query(", ".join(["", "a AS (SELECT episode_id AS id, row_number() OVER (ORDER BY recorded_at DESC, episode_id) AS place FROM episodes WHERE recorded_at >= TIMESTAMP '2024-01-03' QUALIFY place <= 50)", "b AS (SELECT obs_id AS id, row_number() OVER (ORDER BY recorded_at DESC, obs_id) AS place FROM observations WHERE session_id = 's7' QUALIFY place <= 50)", "c AS (SELECT pref_id AS id, row_number() OVER (ORDER BY key, pref_id) AS place FROM preferences WHERE valid_to IS NULL AND project_id = 'p1' QUALIFY place <= 50)", "d AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part QUALIFY place <= 50)", "e AS (SELECT fact_id AS id, row_number() OVER (ORDER BY recorded_at DESC, fact_id) AS place FROM facts WHERE importance >= 0.9 AND deleted_at IS NULL QUALIFY place <= 50)", "f AS (SELECT page_id AS id, row_number() OVER (ORDER BY page_id DESC) AS place FROM pages WHERE page_id % 4 = 1 QUALIFY place <= 50)", "g AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderkey % 7 <> 0 QUALIFY place <= 50)", "h AS (SELECT chunk_id AS id, position AS place FROM chunks WHERE episode_id = 3)"])[0:] + " " + " UNION ALL ".join(f"SELECT '{n}' AS list, id, place FROM {t}" for n, t in zip(("episodes", "observations", "preferences", "procedures", "insights", "research", "intentions", "chunks"), "abcdefgh")))
def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered, limited, scoped lists of each kind; one list's rows stay in one partition, as they are limited first."""
    e, t = D.episodes(spark, sf_dir), lambda name: D.table(spark, sf_dir, name)
    desc = lambda c: F.col(c).desc()
    lists = [
        ("episodes", e.filter("recorded_at >= TIMESTAMP '2024-01-03'"), "episode_id", [desc("recorded_at")]),
        ("observations", D.observations(spark, sf_dir).filter("session_id = 's7'"), "obs_id", [desc("recorded_at")]),
        ("preferences", D.preferences(spark, sf_dir).filter("valid_to IS NULL AND project_id = 'p1'"), "pref_id", [F.col("key")]),
        ("procedures", t("part"), "p_partkey", [F.col("p_name")]),
        ("insights", D.facts(spark, sf_dir).filter("importance >= 0.9 AND deleted_at IS NULL"), "fact_id", [desc("recorded_at")]),
        ("research", t("pages").filter("page_id % 4 = 1"), "page_id", [desc("page_id")]),
        ("intentions", t("orders").filter("o_orderkey % 7 <> 0"), "o_orderkey", [F.col("o_orderdate")]),
    ]
    out = D.chunks(spark, sf_dir).filter("episode_id = 3").select(F.lit("chunks").alias("list"), F.col("chunk_id").alias("id"), F.col("position").cast("long").alias("place"))
    for name, df, key, order in lists:
        few = df.orderBy(*order, key).limit(50)
        out = out.unionByName(few.select(F.lit(name).alias("list"), F.col(key).cast("long").alias("id"), F.row_number().over(Window.orderBy(*order, key)).cast("long").alias("place")))
    return out


LEDGER = "SELECT '{0}' AS sorted_by, fact_id, total FROM (SELECT *, count(*) OVER () AS total FROM facts WHERE project_id = 'p1' AND user_id = 'u3' AND contains(lower(content), 'user') AND deleted_at IS NULL ORDER BY {1} LIMIT 15 OFFSET 5)"


@query(" UNION ALL ".join(LEDGER.format(n, o) for n, o in (("importance", "importance DESC, fact_id"), ("recorded", "recorded_at DESC, fact_id"), ("used", "reference_count DESC, fact_id"))))
def facts_ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the ledger in each of its orders, with the total. The scope is hard: rows without a project or user stay out."""
    rows = D.facts(spark, sf_dir).filter(scope.hard({"project_id": "p1", "user_id": "u3"}) & F.lower("content").contains("user") & temporal.visible())
    total, out = rows.agg(F.count("*").alias("total")), []
    for name, column in (("importance", "importance"), ("recorded", "recorded_at"), ("used", "reference_count")):
        out.append(rows.orderBy(F.col(column).desc(), "fact_id").offset(5).limit(15).select(F.lit(name).alias("sorted_by"), "fact_id"))
    return reduce(DataFrame.unionByName, out).crossJoin(F.broadcast(total))  # one row


DOCS = "SELECT '{0}' AS sorted_by, doc_id, total FROM (SELECT *, count(*) OVER () AS total FROM documents WHERE doc_id % 9 <> 0 AND (doc_id % 3 = 0 OR doc_id % 4 = 1) AND source = 'src0' AND lang = 'en' AND (contains(lower(text), 'the') OR contains(lower(source), 'the')) ORDER BY {1} LIMIT 15 OFFSET 3)"


@query(" UNION ALL ".join(DOCS.format(n, o) for n, o in (("recent", "n_chars DESC, doc_id"), ("created", "doc_id DESC"), ("title", "lower(left(text, 20)), doc_id"))), plain=True)
def documents_ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents of a source and kind, in the scope of a project or of none, that hold a word, a page in each order, with the total."""
    project = F.when(F.col("doc_id") % 3 != 0, D.named("p", F.col("doc_id") % 4))
    found = F.lower("text").contains("the") | F.lower("source").contains("the")
    scoped = D.table(spark, sf_dir, "documents").withColumn("project_id", project).filter(scope.allows({"project_id": "p1"}, "filter", ("project_id",)))
    rows = scoped.filter((F.col("doc_id") % 9 != 0) & (F.col("source") == "src0") & (F.col("lang") == "en") & found).withColumn("title", F.lower(F.left("text", F.lit(20)))).select("doc_id", "n_chars", "title")
    total, out = rows.agg(F.count("*").alias("total")), []
    for name, order in (("recent", [F.col("n_chars").desc(), "doc_id"]), ("created", [F.col("doc_id").desc()]), ("title", ["title", "doc_id"])):
        out.append(rows.orderBy(*order).offset(3).limit(15).select(F.lit(name).alias("sorted_by"), "doc_id"))
    return reduce(DataFrame.unionByName, out).crossJoin(F.broadcast(total))  # one row


@query("SELECT fact_id, coalesce(string_agg(entity, ',' ORDER BY entity), '') AS entities, count(entity) AS n FROM facts LEFT JOIN mentions USING (fact_id) GROUP BY fact_id")
def fact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the entities that they name; an empty list, not null, where there are none."""
    named = D.mentions(spark, sf_dir).groupBy("fact_id").agg(F.array_sort(F.collect_list("entity")).alias("e"))
    all_of = D.facts(spark, sf_dir).select("fact_id").join(named, "fact_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<string>")))
    return all_of.select("fact_id", F.array_join("e", ",").alias("entities"), F.size("e").cast("long").alias("n"))


@query(", top AS (SELECT fact_id FROM facts ORDER BY importance DESC, fact_id LIMIT 50) SELECT entity, count(*) AS facts FROM mentions WHERE entity IN (SELECT entity FROM mentions WHERE fact_id IN (SELECT fact_id FROM top)) GROUP BY 1")
def hydrated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of a request's surviving facts, with how many facts name each."""
    m = D.mentions(spark, sf_dir)
    top = D.facts(spark, sf_dir).orderBy(F.col("importance").desc(), "fact_id").limit(50).select("fact_id")
    return m.join(m.join(top, "fact_id", "left_semi").select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("facts"))


@query("SELECT fact_id, importance FROM facts WHERE fact_id IN (SELECT fact_id FROM mentions WHERE entity = 'user:7') AND deleted_at IS NULL ORDER BY importance DESC, recorded_at DESC, fact_id LIMIT 100")
def facts_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.mentions(spark, sf_dir).filter("entity = 'user:7'").select("fact_id")
    return D.facts(spark, sf_dir).filter(temporal.visible()).join(own, "fact_id", "left_semi").orderBy(F.col("importance").desc(), F.col("recorded_at").desc(), "fact_id").limit(100).select("fact_id", "importance")


@query("SELECT doc_id, position FROM (SELECT conv_id AS doc_id, turn AS position FROM conversations) JOIN episodes ON episode_id = doc_id WHERE recorded_at + INTERVAL 20 DAY > TIMESTAMP '2024-01-22'")
def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose parent hasn't expired."""
    alive = D.episodes(spark, sf_dir).withColumn("expires_at", F.col("recorded_at") + F.expr("INTERVAL 20 DAYS")).filter(temporal.live(F.lit("2024-01-22").cast("timestamp"))).select("episode_id")
    return D.chunks(spark, sf_dir).join(alive, "episode_id", "left_semi").select(F.col("episode_id").alias("doc_id"), "position")


@query("SELECT fact_id, coalesce(e.agent_id, f.agent_id) AS origin_agent, coalesce(e.session_id, f.session_id) AS origin_session FROM facts f LEFT JOIN episodes e ON e.episode_id = f.entity_id")
def origin_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's agent and session are its episode's, else its own."""
    e = D.episodes(spark, sf_dir).select(F.col("episode_id").alias("entity_id"), F.col("agent_id").alias("a"), F.col("session_id").alias("s"))
    return D.facts(spark, sf_dir).join(e, "entity_id", "left").select("fact_id", F.coalesce("a", "agent_id").alias("origin_agent"), F.coalesce("s", "session_id").alias("origin_session"))


@query("SELECT fact_id, entity_id FROM facts f, params WHERE deleted_at IS NULL AND entity_id = 7 AND valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at) AND fact_id NOT IN (SELECT unnest(merged_from) FROM facts, params WHERE valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at)) ORDER BY recorded_at DESC, fact_id LIMIT 100")
def entity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was held of one entity at an instant, the latest first."""
    from quillstone.operators import lifecycle

    return lifecycle.snapshot(D.facts(spark, sf_dir), D.at()).filter("entity_id = 7").orderBy(F.col("recorded_at").desc(), "fact_id").limit(100).select("fact_id", "entity_id")


@query(" UNION ALL ".join(f"SELECT '{n}' AS request, count(*) AS n FROM facts, params WHERE deleted_at IS NULL AND {w}" for n, w in (("instant", "valid_from <= t_at AND (valid_to IS NULL OR valid_to > t_at)"), ("all", "true"), ("now", "valid_from <= t_now AND (valid_to IS NULL OR valid_to > t_now)"))))
def as_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit instant, all if superseded facts are wanted, else now."""
    rows = D.facts(spark, sf_dir).filter(temporal.visible())
    rules = {"instant": temporal.as_of(D.at(), D.now()), "all": temporal.as_of(None, D.now(), True), "now": temporal.as_of(None, D.now())}
    return rows.agg(*(F.count_if(r).alias(n) for n, r in rules.items())).unpivot([], list(rules), "request", "n")


@query("SELECT 'granted' AS answer, count(*) AS n FROM facts WHERE fact_id IN (10, 11, 12, 13, 14, 15) AND (project_id IS NULL OR project_id = 'p1') UNION ALL SELECT 'missing', count(*) FROM facts WHERE fact_id IN (10, 11, 12, 13, 14, 15) AND NOT (project_id IS NULL OR project_id = 'p1')")
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows asked for by id: those of another project are as if they weren't there."""
    asked = D.facts(spark, sf_dir).filter(F.col("fact_id").isin(*range(10, 16)))
    ok = scope.guard({"project_id": "p1"}, ("project_id",))
    return asked.agg(F.count_if(ok).alias("granted"), F.count_if(~ok).alias("missing")).unpivot([], ["granted", "missing"], "answer", "n")


CUT = "CASE WHEN length({c}) > {n} THEN left({c}, {n} - 1) || chr(8230) ELSE {c} END"
LABEL = f"CASE WHEN kind IN ('fact', 'insight', 'observation', 'chunk', 'knowledge_chunk') THEN {CUT.format(c='content', n=80)} WHEN kind IN ('procedure', 'research') THEN content WHEN kind = 'preference' THEN content || ' = ' || {CUT.format(c='value', n=40)} ELSE CAST(id AS VARCHAR) END"


@query(f"{ITEMS_SQL}, told AS (SELECT i.kind, i.id, i.content, CASE WHEN kind = 'preference' THEN repeat('v', CAST(p.pref_id % 60 AS BIGINT)) || (p.pref_id % 10) ELSE '' END AS value FROM items i LEFT JOIN preferences p ON i.kind = 'preference' AND i.id = p.pref_id) SELECT kind, id, {LABEL} AS label FROM told WHERE content IS NOT NULL")
def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short label for each row, by its kind; preferences with their value, cut at forty characters."""
    value = F.when(F.col("kind") == "preference", F.concat(F.repeat(F.lit("v"), (F.col("id") % 60).cast("int")), (F.col("id") % 10).cast("string")))
    return items(spark, sf_dir).filter("content IS NOT NULL").select("kind", "id", text.label(F.col("kind"), F.col("content"), F.col("id"), value).alias("label"))


@query("""SELECT 'node' AS part, node, kind AS other, deg AS degree, total, total > count(*) OVER () AS truncated FROM (SELECT node, kind, deg, count(*) OVER () AS total, row_number() OVER (PARTITION BY kind ORDER BY deg DESC, node) AS nth FROM (SELECT node, left(node, 1) AS kind, count(*) AS deg FROM (SELECT src AS node FROM relates UNION ALL SELECT dst FROM relates) GROUP BY ALL)) WHERE nth <= 40
UNION ALL SELECT * FROM (SELECT DISTINCT 'edge', src, dst, NULL::BIGINT, NULL::BIGINT, false FROM relates WHERE src IN (SELECT node FROM (SELECT src AS node, row_number() OVER (PARTITION BY left(src, 1) ORDER BY count(*) DESC, src) AS nth FROM relates GROUP BY src) WHERE nth <= 40) AND dst IN (SELECT node FROM (SELECT dst AS node, row_number() OVER (ORDER BY count(*) DESC, dst) AS nth FROM relates GROUP BY dst) WHERE nth <= 40) ORDER BY src, dst LIMIT 60)""")
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal share of nodes of each kind by degree, with the number of all, and the edges with both ends among them, sixty at most."""
    r = D.relates(spark, sf_dir)
    kinds = r.select(F.col("src").alias("node")).union(r.select("dst")).distinct().withColumn("kind", F.substring("node", 1, 1))
    nodes, edges = graph.overview(r, kinds, 40, 60)
    none = F.lit(None)
    shown = nodes.select(F.lit("node").alias("part"), "node", F.col("kind").alias("other"), "degree", "total", "truncated")
    return shown.unionByName(edges.select(F.lit("edge").alias("part"), F.col("src").alias("node"), F.col("dst").alias("other"), none.cast("long").alias("degree"), none.cast("long").alias("total"), F.lit(False).alias("truncated")))


WALK = ", ".join(f"r{i} AS MATERIALIZED (SELECT node, sum(x) AS rank FROM (SELECT 'user:7' AS node, 0.15::DOUBLE AS x UNION ALL SELECT f.dst, 0.85::DOUBLE * r.rank / f.degree FROM r{i - 1} r JOIN flow f ON f.src = r.node) GROUP BY node)" for i in range(1, 7))


@query(f""", links AS (SELECT entity AS src, 'fact:' || fact_id AS dst FROM mentions UNION ALL SELECT 'user:' || user_id, 'user:' || (user_id + 1) FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT DISTINCT entity, 'item:' || (CAST(substr(entity, 6) AS INT) + 50) FROM mentions WHERE starts_with(entity, 'item:') AND CAST(substr(entity, 6) AS INT) < 50),
ways AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links), flow AS MATERIALIZED (SELECT a.src, a.dst, d.degree FROM ways a JOIN (SELECT src, count(*) AS degree FROM ways GROUP BY src) d USING (src)), r0 AS (SELECT 'user:7' AS node, 0.15::DOUBLE AS rank), {WALK}
SELECT fact_id, round(rank, 9) AS score FROM r6 JOIN facts ON node = 'fact:' || fact_id WHERE valid_to IS NULL AND deleted_at IS NULL AND fact_id % 5 <> 0 ORDER BY round(rank, 12) DESC, fact_id LIMIT 30""")
def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open facts that a walk from an entity reaches over facts, relations and synonyms, without those already found (here every fifth)."""
    m, f = D.mentions(spark, sf_dir), D.facts(spark, sf_dir)
    user = D.table(spark, sf_dir, "events").select("user_id").distinct()
    relations = user.select(D.named("user:", F.col("user_id")).alias("src"), D.named("user:", F.col("user_id") + 1).alias("dst"))
    number = F.substring("entity", 6, 9).try_cast("int")
    synonyms = m.filter(F.col("entity").startswith("item:") & (number < 50)).select(F.col("entity").alias("src"), D.named("item:", number + 50).alias("dst")).distinct()
    found = graph.walk_facts(m, [relations, synonyms], f, f.filter("fact_id % 5 = 0").select("fact_id"), spark.createDataFrame([("user:7",)], "node string"), 30, iterations=6)
    return found.select("fact_id", F.round("score", 9).alias("score"))
