"""Ranked retrieval: exact filtered nearest neighbours, BM25, reciprocal-rank fusion, expansion, scoring, top-k. Ties always go to the lesser id."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scoring, temporal, text, vectors

RRF_K = 60


def nearest(rows: DataFrame, key: str, vector: list[float], k: int, where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """rows (key, embedding, ...) with raw and score, the k best. Filters come before the top-k, so no over-fetching is needed."""
    rows = rows if where is None else rows.filter(where)
    scored = rows.withColumn("raw", vectors.cosine(F.col("embedding"), F.array(*map(F.lit, vector)))).withColumn("score", vectors.index_score(F.col("raw")))
    scored = scored if min_score is None else scored.filter(F.col("score") >= min_score)
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def bm25_by(rows: DataFrame, by: list[str], key: str, column: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """by, key and score of rows that hold a term of query; counts and lengths are those of the row's group (by: a few groups). Only the query's terms are exploded."""
    wanted = sorted({t for t in re.split(r"[^\w]+|_", query.lower()) if t})
    every = rows.select(*by, key, text.terms(F.col(column)).alias("every"))
    docs = every.select(*by, key, F.size("every").cast("double").alias("n"), F.filter("every", lambda t: t.isin(wanted)).alias("terms"))  # one pass over a text; what is left is short
    whole = docs.groupBy(*by).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    tf = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.size(F.filter("terms", _is(t))).cast("double").alias("tf")) for t in wanted)))
    hits = docs.select(*by, key, "n", tf.alias("t")).select(*by, key, "n", "t.*").filter("tf > 0")
    df = hits.groupBy(*by, "term").agg(F.count("*").alias("df"))  # as many rows a group as the query has terms
    scored = hits.join(F.broadcast(df), [*by, "term"])
    scored = scored.join(F.broadcast(whole), by) if by else scored.crossJoin(F.broadcast(whole))  # a row a group
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return scored.groupBy(*by, key).agg(F.sum(weight).alias("score"))


def bm25(rows: DataFrame, key: str, column: str, query: str, k: int | None = None) -> DataFrame:
    """key and score of rows that hold a term of query, the k best."""
    out = bm25_by(rows, [], key, column, query)
    return out if k is None else out.orderBy(F.round("score", 9).desc(), key).limit(k)


def _is(term: str):
    return lambda t: t == term


def ranked(hits: DataFrame, key: str, source: str, score: str = "score") -> DataFrame:
    """key, source, rank (from 0). hits is a bounded top-k list."""
    return hits.select(key, F.lit(source).alias("source"), (F.row_number().over(Window.orderBy(F.round(score, 9).desc(), key)) - 1).alias("rank"))


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion over the place in each list after sorting (gaps in ranks vanish): key, fused, sources."""
    placed = reduce(DataFrame.unionByName, lists).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank", key)))
    return placed.groupBy(key).agg(F.sum(1.0 / (k + F.col("place"))).alias("fused"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def siblings(fused: DataFrame, facts: DataFrame, seeds: int, budget: int, k: int = RRF_K) -> DataFrame:
    """Open facts of the best seeds' entities that aren't there yet: fact_id, fused, sources. Both sides of the seed joins are bounded by seeds."""
    best = fused.orderBy(F.round("fused", 9).desc(), "fact_id").limit(seeds)
    entities = best.join(facts.select("fact_id", "entity_id"), "fact_id").select("entity_id").distinct()
    open_ = facts.filter(temporal.visible() & F.col("valid_to").isNull()).join(F.broadcast(entities), "entity_id", "left_semi")
    new = open_.join(fused.select("fact_id"), "fact_id", "left_anti").select("fact_id", "recorded_at").orderBy(F.col("recorded_at").desc(), "fact_id").limit(budget)
    return new.select("fact_id", (1.0 / (k + F.row_number().over(Window.orderBy(F.col("recorded_at").desc(), "fact_id")))).alias("fused"), F.lit("sibling").alias("sources"))


def blended(candidates: DataFrame, now: Column, agent: str | None = None, session: str | None = None) -> DataFrame:
    """Facts with fused and sources, to a blended score: fused is taken relative to the greatest; found only as siblings counts half; own agent and session gain."""
    top = F.max("fused").over(Window.partitionBy(F.lit(1)))  # over one request's candidates
    days = temporal.days_since(F.greatest("recorded_at", F.coalesce("last_used", "recorded_at")), now)
    base = scoring.fact_blend(F.col("fused") / top, F.col("importance"), F.col("confidence"), scoring.recency(days), scoring.use(F.col("reference_count")))
    damp = F.when(F.col("sources") == "sibling", 0.5).otherwise(1.0)
    own = F.when(F.col("agent_id") == agent, 1.15).otherwise(1.0) * F.when(F.col("session_id") == session, 1.05).otherwise(1.0)
    return candidates.withColumn("blended", base * damp * own)


def top_per_kind(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.round(score, 9).desc(), key))).filter(F.col("nth") <= k)


def chunk_facts(hits: DataFrame, links: DataFrame, facts: DataFrame) -> DataFrame:
    """Open facts derived from found chunks: fact_id, rank (of the best chunk), chunk_ids. hits (chunk_id, rank), links (chunk_id, fact_id)."""
    found = links.join(hits, "chunk_id").groupBy("fact_id").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return found.join(facts.filter(temporal.visible() & F.col("valid_to").isNull()).select("fact_id"), "fact_id", "left_semi")


def candidates(lists: list[DataFrame], key: str, expansions: tuple[str, ...] = ("sibling", "graph")) -> DataFrame:
    """Ranked lists (key, source, rank) merged by key: key, found (source and rank of each list), direct (found by more than an expansion)."""
    direct = F.bool_or(~F.col("source").isin(*expansions))
    return reduce(DataFrame.unionByName, lists).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("found"), direct.alias("direct"))


def rerank(hits: DataFrame, key: str, score: Column, window: int = 20, keep: int = 10) -> DataFrame:
    """The first window rows of one request by rank (from 0), in the order of another score, keep at most: key, rank, rank_before, promoted."""
    top = hits.orderBy("rank", key).limit(window).withColumn("by", score)
    after = F.row_number().over(Window.orderBy(F.col("by").desc(), key)) - 1  # a bounded list
    before = F.row_number().over(Window.orderBy("rank", key)) - 1
    return top.select(key, after.alias("rank_after"), before.alias("rank_before")).filter(F.col("rank_after") < keep).withColumn("promoted", F.col("rank_after") < F.col("rank_before"))
