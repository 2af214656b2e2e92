"""Recall over all kinds of memory: a list of stages, each from candidates to candidates, composed into one plan.

``items`` is one table of all kinds: kind, id, content, embedding, the scope axes, valid_from, valid_to, seen_at, redacted, live, importance, confidence, used,
entity_id. Candidates are rows (kind, id, source, rank) until fusion, then (kind, id, fused, sources). Filters come before each top-k, so lists are exact and
need no over-fetching. items has no vectors where ``vectors`` is given, a function that adds them to the few rows that are compared. Nulls in an axis are shared; a null instant never ends; kinds without items give nothing; ties go to the lesser id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scope, scoring, temporal, vectors
from quillstone.operators import graph, retrieval
from quillstone.sources.store import cut

#: Kinds that a request includes unless it says otherwise; all others are asked for by name.
DEFAULT = ("fact", "preference", "insight")
#: Kinds with a full-text list beside the vector list.
FULLTEXT = ("fact", "chunk", "knowledge_chunk", "procedure", "research_chunk")


@dataclass(frozen=True)
class Request:
    vector: list[float]
    words: str
    now: Column
    at: Column
    kinds: tuple[str, ...] = DEFAULT
    scopes: dict[str, str] = field(default_factory=dict)
    mode: str = "filter"
    min_importance: float | None = None
    min_confidence: float | None = None
    overlap: tuple[Column, Column] | None = None
    entity: int | None = None
    k: int = 20
    own: dict[str, str] | None = None  # agent and session that gain, where they aren't held to by scope

    def axis(self, *names: str) -> Column:
        return scope.allows(self.scopes, self.mode, names)


@dataclass(frozen=True)
class State:
    request: Request
    items: DataFrame
    links: DataFrame  # chunk_id, fact_id
    candidates: DataFrame | None = None
    vectors: Callable[[DataFrame], DataFrame] | None = None
    chunks: DataFrame | None = None  # chunk_id, episode_id, position
    mentions: DataFrame | None = None  # fact_id, entity
    entities: DataFrame | None = None  # entity, embedding
    edges: tuple[DataFrame, ...] = ()  # relations and synonyms: src, dst
    origins: DataFrame | None = None  # fact_id, agent_id, session_id of the episode that a fact came from
    seeds: DataFrame | None = None  # entities that the request names: node


Stage = Callable[[State], State]


def compose(stages: list[Stage]) -> Stage:
    return lambda state: reduce(lambda s, stage: stage(s), stages, state)


def _with(state: State, candidates: DataFrame) -> State:
    return replace(state, candidates=candidates)


def request_vector(spark: SparkSession, words: str, embed: Callable[[Column], Column] = vectors.hashed_words) -> list[float]:
    """A request's text by the same embedder as everything else; one row. Texts without words are near to nothing."""
    return spark.range(1).select(embed(F.lit(words)).alias("v")).first()["v"] or []


def pushed(r: Request) -> Column:
    """What each kind's sources filter before their top-k: redaction, liveness, and, kind by kind, instant and scope. Episode chunks are held to their scope afterwards alone."""
    kind = F.col("kind")
    dated = ~kind.isin("fact", "preference") | temporal.valid_at(r.at)
    two, four = r.axis("project_id", "user_id"), r.axis(*scope.AXES)
    scoped = F.when(kind.isin("chunk"), True).when(kind.isin("observation", "intention"), four).otherwise(two)
    session = ~kind.isin("observation") | F.col("session_id").eqNullSafe(F.lit(r.scopes.get("session_id")))
    project = ~kind.isin("research", "research_chunk") | F.lit(r.scopes.get("project_id") is not None)  # research belongs to projects: a request without one gets none
    return kind.isin(*r.kinds) & ~F.col("redacted") & F.col("live") & dated & scoped & session & project


def vector_lists(state: State) -> State:
    r, raw = state.request, vectors.cosine(F.col("embedding"), F.array(*map(F.lit, state.request.vector)).cast("array<double>"))
    asked = state.items.filter(pushed(r))
    asked = asked if state.vectors is None else state.vectors(asked.select("kind", "id"))
    scored = asked.select("kind", "id", F.round(vectors.index_score(raw), 9).alias("score"))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= 3 * r.k)
    return _with(state, top.select("kind", "id", F.lit("vector").alias("source"), "rank"))


def fulltext_lists(state: State) -> State:
    """BM25 by kind. Facts' full text isn't held to the scope here but afterwards."""
    r = state.request
    rows = state.items.filter(F.col("kind").isin(*FULLTEXT) & F.when(F.col("kind") == "fact", temporal.valid_at(r.at) & ~F.col("redacted") & F.col("kind").isin(*r.kinds)).otherwise(pushed(r)))
    found = retrieval.bm25_by(rows, ["kind"], "id", "content", r.words)
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.round("score", 9).desc(), "id"))).filter(F.col("rank") <= 3 * r.k)
    return _with(state, state.candidates.unionByName(top.select("kind", "id", F.lit("fulltext").alias("source"), "rank")))


def chunk_facts(state: State) -> State:
    """Open facts of the chunks found, at the rank of their best chunk."""
    hits = state.candidates.filter("kind = 'chunk'").groupBy(F.col("id").alias("chunk_id")).agg(F.min("rank").alias("rank"))
    facts = state.items.filter("kind = 'fact' AND NOT redacted AND valid_to IS NULL").select(F.col("id").alias("fact_id"))
    found = state.links.join(hits, "chunk_id").groupBy("fact_id").agg(F.min("rank").alias("rank")).join(facts, "fact_id", "left_semi")
    return _with(state, state.candidates.unionByName(found.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.lit("chunk_derived").alias("source"), "rank")))


def link(state: State, most: int = 5) -> State:
    """The entities nearest to the request are seeds of the walk."""
    raw = vectors.cosine(F.col("embedding"), F.array(*map(F.lit, state.request.vector)).cast("array<double>"))
    best = state.entities.select("entity", F.round(raw, 9).alias("score")).orderBy(F.col("score").desc(), "entity").limit(most)
    return replace(state, seeds=best.select(F.col("entity").alias("node")))


def walk(state: State, seed_facts: int = 10, budget: int = 30, **options: int) -> State:
    """A further list of facts: those that a walk reaches over mentions, relations and synonyms from the request's entities and those of the best facts found directly, and that no list has yet."""
    direct = state.candidates.filter("kind = 'fact' AND source <> 'chunk_derived'").groupBy(F.col("id").alias("fact_id")).agg(F.min("rank").alias("rank"))
    best = direct.orderBy("rank", "fact_id").limit(seed_facts).select("fact_id")
    seeds = state.mentions.join(F.broadcast(best), "fact_id", "left_semi").select(F.col("entity").alias("node"))  # so many facts
    seeds = seeds if state.seeds is None else seeds.unionByName(state.seeds)
    facts = state.items.filter("kind = 'fact' AND NOT redacted").select(F.col("id").alias("fact_id"), "valid_to", F.lit(None).cast("timestamp").alias("deleted_at"))
    found = graph.walk_facts(state.mentions, list(state.edges), facts, state.candidates.filter("kind = 'fact'").select(F.col("id").alias("fact_id")).distinct(), cut(seeds.distinct()), budget, **options)
    placed = found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "fact_id")))  # budget rows
    return _with(state, state.candidates.unionByName(placed.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.lit("graph").alias("source"), "rank")))


def fuse(state: State, k: int = retrieval.RRF_K) -> State:
    """Reciprocal-rank fusion by kind, over places after sorting each list anew."""
    placed = state.candidates.withColumn("place", F.row_number().over(Window.partitionBy("kind", "source").orderBy("rank", "id")))
    return _with(state, placed.groupBy("kind", "id").agg(F.sum(1.0 / (k + F.col("place"))).alias("fused"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")))


def siblings(state: State, budget: int = 20) -> State:
    """Open facts of the best facts' entities."""
    facts = state.items.filter("kind = 'fact' AND NOT redacted").select(F.col("id").alias("fact_id"), "entity_id", "valid_to", F.col("seen_at").alias("recorded_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    fused = state.candidates.filter("kind = 'fact'").select(F.col("id").alias("fact_id"), "fused", "sources")
    new = retrieval.siblings(fused, facts, state.request.k, budget)
    return _with(state, state.candidates.unionByName(new.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), "fused", "sources")))


def neighbours(state: State, seeds: int = 10, share: float = 0.3, radius: int = 1) -> State:
    """Chunks within so many places of the best ones in their episode, at a share of the best score."""
    chunks = state.candidates.filter("kind = 'chunk'")
    best = chunks.orderBy(F.round("fused", 9).desc(), "id").limit(seeds)
    top = chunks.agg(F.max("fused").alias("top"))  # one row
    seat = state.chunks.select(F.col("chunk_id").alias("id"), "episode_id", "position")
    apart = F.explode(F.array(*(F.lit(d) for d in range(-radius, radius + 1) if d)))
    wanted = seat.join(F.broadcast(best.select("id")), "id", "left_semi").select("episode_id", "position", apart.alias("d")).select("episode_id", (F.col("position") + F.col("d")).alias("position")).distinct()
    there = seat.join(F.broadcast(wanted), ["episode_id", "position"], "left_semi").select("id").join(chunks.select("id"), "id", "left_anti")  # seeds times twice the radius at most
    new = there.crossJoin(F.broadcast(top)).select(F.lit("chunk").alias("kind"), "id", (share * F.col("top")).alias("fused"), F.lit("neighbour").alias("sources"))
    return _with(state, state.candidates.unionByName(new))


def origin(state: State) -> State:
    """Agent and session of the episode that a fact came from: origin_agent, origin_session; where it came from none, its own count."""
    own = state.origins.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.col("agent_id").alias("origin_agent"), F.col("session_id").alias("origin_session"))
    return _with(state, state.candidates.join(own, ["kind", "id"], "left"))


def post_filter(state: State) -> State:
    """All rules again on what any source or expansion brought, with the request's minima, window and entity for facts. Candidates get their item's columns."""
    r = state.request
    dated = ~F.col("kind").isin("fact", "preference") | temporal.valid_at(r.at)
    keep = F.col("kind").isin(*r.kinds) & ~F.col("redacted") & dated & (r.axis(*scope.AXES) | (F.col("kind") == "intention"))
    fact = F.lit(True)
    for name, least in (("importance", r.min_importance), ("confidence", r.min_confidence)):
        fact = fact if least is None else fact & (F.col(name) >= least)
    fact = fact if r.overlap is None else fact & temporal.overlaps(*r.overlap)
    fact = fact if r.entity is None else fact & F.col("entity_id").eqNullSafe(F.lit(r.entity))
    return _with(state, state.candidates.join(state.items.drop("embedding", "content"), ["kind", "id"]).filter(keep & ((F.col("kind") != "fact") | fact)))


def blend(state: State) -> State:
    """Each kind's blend of the relative fused score with its own signals; expansions are damped, own agent and session gain."""
    r, kind = state.request, F.col("kind")
    rrf = F.col("fused") / F.max("fused").over(Window.partitionBy("kind"))  # over one request's candidates
    recent = scoring.recency(temporal.days_since(F.col("seen_at"), r.now))
    fact = scoring.fact_blend(rrf, F.col("importance"), F.col("confidence"), recent, scoring.use(F.col("used")))
    damp = F.when(F.col("sources") == "sibling", 0.5).when(F.col("sources") == "chunk_derived", 0.8).when(F.col("sources") == "graph", 0.5).otherwise(1.0)
    came = ["origin_agent", "origin_session"] if "origin_agent" in state.candidates.columns else [None, None]
    agent, session = (F.col(c) if o is None else F.coalesce(o, c) for c, o in zip(("agent_id", "session_id"), came))
    mine = r.scopes if r.own is None else r.own
    own = F.when(agent == mine.get("agent_id"), 1.15).otherwise(1.0) * F.when(session == mine.get("session_id"), 1.05).otherwise(1.0)
    score = F.when(kind == "fact", fact * damp * own).when(kind == "preference", scoring.preference_blend(rrf, F.col("confidence"), recent)).when(kind == "procedure", scoring.procedure_blend(rrf, F.col("importance"), recent)).otherwise(scoring.plain_blend(rrf, recent))
    return _with(state, state.candidates.withColumn("score", score * scope.boost(r.scopes, r.mode)))


def rerank(state: State, by: Callable[[DataFrame, str], DataFrame], window: int = 20, keep: int = 10, context: int = 8000, chars: int = 500) -> State:
    """The best facts by score, once more, by a model: by gets (id, content) and the request's words and gives (id, by); the best so many of those come first in that order, all others follow by score. Where the
    window's texts, cut at so many characters, would fill over two fifths of the context, half of it is asked for."""
    best = state.candidates.filter("kind = 'fact'").orderBy(F.round("score", 9).desc(), "id").limit(window)
    held = cut(best.select("id", "score").join(state.items.filter("kind = 'fact'").select("id", F.substring("content", 1, chars).alias("content")), "id"))
    size = held.agg(F.coalesce(F.sum(F.ceil(F.length("content") / 4)), F.lit(0)).alias("n"))  # one row
    nth = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id"))  # window rows
    large = F.col("n") + -(-len(state.request.words) // 4) > 0.4 * context
    asked = held.withColumn("nth", nth).crossJoin(F.broadcast(size)).filter(~large | (F.col("nth") <= max(1, window // 2))).select("id", "content", "nth")
    after = F.row_number().over(Window.orderBy(F.col("by").desc(), "id"))
    told = by(asked.select("id", "content"), state.request.words).join(asked.select("id", "nth"), "id").select("id", after.alias("place"), "nth").filter(F.col("place") <= keep)
    new = told.select(F.lit("fact").alias("kind"), "id", "place", (F.col("place") < F.col("nth")).alias("promoted"))
    return _with(state, state.candidates.join(F.broadcast(new), ["kind", "id"], "left"))


def top_k(state: State) -> State:
    """The best of each kind, with how many there were before the cut; reranked facts first."""
    n, rows = F.count("*").over(Window.partitionBy("kind")), state.candidates
    order = [F.col("place").asc_nulls_last()] if "place" in rows.columns else []
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(*order, F.round("score", 9).desc(), "id"))
    return _with(state, rows.withColumn("n_before", n).withColumn("nth", nth).filter(F.col("nth") <= state.request.k))


def hydrate(state: State) -> State:
    """Entities of the facts that stay: entities, in order; empty for the rest."""
    few = state.candidates.filter("kind = 'fact'").select(F.col("id").alias("fact_id"))
    named = state.mentions.join(F.broadcast(few), "fact_id", "left_semi").groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set("entity")).alias("entities")).withColumn("kind", F.lit("fact"))  # k facts
    return _with(state, state.candidates.join(F.broadcast(named), ["kind", "id"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))))


STAGES: list[Stage] = [vector_lists, fulltext_lists, chunk_facts, fuse, siblings, neighbours, post_filter, blend, top_k]


def full_stages(by: Callable[[DataFrame, str], DataFrame] | None = None, **walks: int) -> list[Stage]:
    """All stages: with entities linked, a walk, origins and, given a model's order, reranking."""
    order = [] if by is None else [lambda s: rerank(s, by)]
    return [link, vector_lists, fulltext_lists, chunk_facts, lambda s: walk(s, **walks), fuse, siblings, neighbours, origin, post_filter, blend, *order, top_k, hydrate]


def recall(state: State, stages: list[Stage] | None = None) -> DataFrame:
    return compose(STAGES if stages is None else stages)(state).candidates
