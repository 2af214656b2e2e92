"""The whole batch cycle over committed tables: it stops and goes on between passes, and each pass reads only what has no mark yet.

Each pass is a function of tables to changed tables; they are committed together with the marks that say what was done (sources/journal.py). A cycle that was stopped, or whose driver was lost, is run
again under its name: passes committed under it are passed over, one that wasn't is done anew from the last commit, so the tables are those of one undisturbed run.

Order: summaries, extraction (with deduplication, entities, relations, contradictions), synonyms, sweep, consolidation, promotion, pruning, retirement. Past the deadline the passes after extraction are left
for the next cycle. A batch's facts are held against what was open when the batch began and against the batch's own facts of earlier episodes; a fact that several close is closed once.

Edge cases: null texts give no facts; episodes without chunks are marked and give nothing; null scopes are a bucket of their own; ties go to the lesser id; empty tables stay empty; repeated chunks give repeated
sentences, of which the first stays. Tables need the columns of TABLES; others are left out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scoring, temporal, text, vectors
from quillstone.operators import consolidate, cycle
from quillstone.sources.journal import Journal
from quillstone.sources.store import cut, release

TABLES = {
    "facts": "fact_id long, content string, category string, embedding array<double>, valid_from timestamp, valid_to timestamp, recorded_at timestamp, deleted_at timestamp, pruned_at timestamp, confidence double, importance double, reference_count long, merged_from array<long>, episode_id long, project_id string, user_id string, checked_at timestamp",
    "episodes": "episode_id long, recorded_at timestamp, summary string, summary_kind string, project_id string, user_id string",
    "chunks": "chunk_id long, episode_id long, position long, text string",
    "marks": "key long, step string, at timestamp, attempts long, next_at timestamp",
    "mentions": "fact_id long, entity string",
    "entities": "entity string, embedding array<double>",
    "relations": "src string, dst string, predicate string, confidence double",
    "synonyms": "lo string, hi string, score double",
    "insights": "insight_id long, content string, embedding array<double>, project_id string, user_id string, retired_at timestamp",
    "sources": "insight_id long, fact_id long",
    "events": "kind string, target_id long, step string, at timestamp",
}
SCOPE = ["project_id", "user_id"]
Rows = dict[str, DataFrame]


def sentences(groups: DataFrame) -> DataFrame:
    """The default extractor: a fact for each sentence of a group of chunks (episode_id, group, body): episode_id, group, nth, content, category, confidence, importance. One that gives a row with an
    error (a text) makes its episode fail."""
    parts = F.filter(F.split("body", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    rows = groups.select("episode_id", "group", F.posexplode(parts).alias("nth", "content"))
    return rows.select("episode_id", "group", F.col("nth").cast("long").alias("nth"), "content", F.lit("note").alias("category"), F.lit(0.8).alias("confidence"), F.lit(0.5).alias("importance"), F.lit(None).cast("string").alias("error"))


def capitalised(facts: DataFrame) -> DataFrame:
    """The default finder of entities: words with a capital, in lower case. fact_id, entity."""
    return facts.select("fact_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"\b(\p{Lu}\p{L}+)"), F.lit(1)), F.lower))).alias("entity"))


def side_by_side(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """The default extractor of relations: the first two entities of a fact. src, predicate, dst, confidence."""
    two = cycle.named_together(facts, mentions)
    return two.select("src", F.lit("with").alias("predicate"), "dst", "confidence")


def merge_all(clusters: DataFrame) -> DataFrame:
    """The default judge: each cluster (cluster, fact_id, content, ...) becomes one fact in the words of its first. cluster, fact_id, merged (content)."""
    return clusters.withColumn("merged", F.first("content").over(Window.partitionBy("cluster").orderBy("fact_id"))).select("cluster", "fact_id", "merged")  # clusters have six facts at most


@dataclass(frozen=True)
class Parts:
    """The model's parts, each with a plain default, and the cycle's limits."""

    embed: Callable[[Column], Column] = vectors.hashed_words
    summarise: Callable[[DataFrame, str, str, int], DataFrame] = cycle.first_lines
    extract: Callable[[DataFrame], DataFrame] = sentences
    entities: Callable[[DataFrame], DataFrame] = capitalised
    relate: Callable[[DataFrame, DataFrame], DataFrame] = side_by_side
    decide: Callable[[DataFrame], DataFrame] | None = None
    judge: Callable[[DataFrame], DataFrame] = merge_all
    batch: int = 50
    attempts: int = 5
    group_tokens: int = 4000
    same: float = 0.92
    supersede: float = 0.85
    synonym: float = 0.9
    cluster: float = 0.8
    sweep: int = 50


def plain(name: str, spark) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def shaped(name: str, df: DataFrame) -> DataFrame:
    """A table's own columns and types; what df lacks is null."""
    wanted = [c.strip().split(" ", 1) for c in TABLES[name].split(", ")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with nth (from 0) in order of columns: dealt by ranges, numbered in each, and moved by the counts of the ranges before, one row a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(parts, *order).withColumn("part__", F.spark_partition_id()))
    sizes = held.groupBy("part__").agg(F.count("*").alias("n__"))
    before = sizes.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("before__"))
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1
    return held.withColumn("own__", own).join(F.broadcast(before), "part__").withColumn("nth", F.col("before__") + F.col("own__")).drop("part__", "own__", "before__")


def happened(t: Rows, ids: DataFrame, kind: str, step: str, now: Column) -> DataFrame:
    """The events with one more for each of ids (target_id)."""
    return t["events"].unionByName(shaped("events", ids.select("target_id", F.lit(kind).alias("kind"), F.lit(step).alias("step"), now.alias("at"))))


def open_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("valid_to").isNull() & temporal.visible())


def vector_rows(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("fact_id").alias("id"), "embedding", *SCOPE)


# ---- passes ----


def summaries(t: Rows, now: Column, p: Parts) -> Rows:
    bodies = t["chunks"].filter("text IS NOT NULL").groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("body"))
    todo = bodies.join(t["episodes"].filter("summary_kind = 'provisional'").select("episode_id"), "episode_id", "left_semi")
    return {"episodes": shaped("episodes", cycle.install_summaries(t["episodes"], cycle.summarised(todo, "episode_id", "body", 64, p.summarise)))}


def pending(t: Rows, now: Column, p: Parts) -> DataFrame:
    """The oldest episodes without a mark, or with a failed one that is due again: episode_id and their scope and time, attempts."""
    last = t["marks"].filter("step = 'extraction'").groupBy(F.col("key").alias("episode_id")).agg(F.max("attempts").alias("attempts"), F.max_by("next_at", "attempts").alias("next_at"))
    rows = t["episodes"].join(last, "episode_id", "left")
    due = F.col("attempts").isNull() | (F.col("next_at").isNotNull() & (F.col("next_at") <= now) & (F.col("attempts") < p.attempts))
    return rows.filter(due).orderBy("recorded_at", "episode_id").limit(p.batch).select("episode_id", "recorded_at", *SCOPE, F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))


def groups(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks of an episode packed in order into groups of at most so many tokens: episode_id, group, body. A group that opens within somebody's turn begins with a note of who speaks. One streamed fold an episode."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        episode, group, body, used, speaker, opens, out = None, 0, [], 0, None, None, []

        def close() -> None:
            nonlocal body, used
            if body:
                joined = "\n\n".join(body)
                out.append((episode, group, f"[continued mid-turn; current speaker: {opens}]\n\n{joined}" if opens and not text.SPEAKER_AT.match(joined) else joined))
            body, used = [], 0

        for df in frames:
            for e, words, last in zip(df["episode_id"], df["text"], df["speaker"]):
                if e != episode:
                    close()
                    episode, group, speaker = e, 0, None
                size = -(-len(words) // 4) + (2 if body else 0)
                if body and used + size > budget:
                    close()
                    group += 1
                if not body:
                    opens = speaker
                body.append(words)
                used += size
                speaker = last if isinstance(last, str) else speaker
            yield pd.DataFrame(out, columns=["episode_id", "group", "body"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["episode_id", "group", "body"])

    rows = chunks.filter("text IS NOT NULL AND episode_id IS NOT NULL").select("episode_id", "position", "chunk_id", "text", text.last_speaker(F.col("text")).alias("speaker"))
    ordered = rows.repartition("episode_id").sortWithinPartitions("episode_id", "position", "chunk_id", "text")
    return ordered.select("episode_id", "text", "speaker").mapInPandas(fold, "episode_id long, group long, body string")


def closed(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """facts after pairs (new_id, old_id): old open ones close at the later start of both, by the earliest of those that close them."""
    starts = facts.select(F.col("fact_id").alias("new_id"), F.col("valid_from").alias("new_from"))
    hit = pairs.groupBy("old_id").agg(F.min("new_id").alias("new_id")).join(starts, "new_id").select(F.col("old_id").alias("fact_id"), "new_from")
    out = facts.join(hit, "fact_id", "left")
    due = F.col("new_from").isNotNull() & F.col("valid_to").isNull() & temporal.visible()
    return out.withColumn("valid_to", F.when(due, temporal.closes_at(F.col("valid_from"), F.col("new_from"))).otherwise(F.col("valid_to"))).drop("new_from")


def contradicted(facts: DataFrame, ids: DataFrame, p: Parts, siblings: bool) -> DataFrame:
    """new_id, old_id: what each of ids (fact_id) supersedes among the open facts of its bucket, without facts of its own episode if siblings are left out."""
    now_open = cut(open_facts(facts).select("fact_id", "embedding", *SCOPE, "episode_id").join(ids.withColumn("asks", F.lit(1)), "fact_id", "left"))
    rows = now_open.select(F.col("fact_id").alias("id"), "embedding", *SCOPE, "episode_id", "asks")
    source = F.col("episode_id") if siblings else F.lit(None)
    found = consolidate.supersede_candidates(rows.withColumn("source", source.cast("long")), SCOPE, p.supersede, decide=p.decide, asks="asks", source="source")
    return cut(found.select("new_id", "old_id"))


def extraction(t: Rows, now: Column, p: Parts) -> Rows:
    todo = cut(pending(t, now, p))
    own = t["chunks"].join(F.broadcast(todo.select("episode_id")), "episode_id", "left_semi")  # at most a batch of episodes
    found = cut(p.extract(groups(own, p.group_tokens)))
    failed = found.filter("error IS NOT NULL").select("episode_id").distinct()
    said = found.filter("error IS NULL AND trim(content) <> ''").join(failed, "episode_id", "left_anti").join(todo.drop("attempts"), "episode_id")
    base = t["facts"].agg(F.coalesce(F.max("fact_id"), F.lit(0).cast("long")).alias("base"))
    ordered = numbered(said, ["recorded_at", "episode_id", "group", "nth", "content"]).crossJoin(F.broadcast(base))  # one row
    new = ordered.select((F.col("base") + 1 + F.col("nth")).alias("fact_id"), "content", "category", p.embed(F.col("content")).alias("embedding"), F.col("recorded_at").alias("valid_from"), now.alias("recorded_at"), "confidence", "importance", F.lit(0).alias("reference_count"), "episode_id", *SCOPE, now.alias("checked_at"))
    new = cut(shaped("facts", new))
    kept = consolidate.fresh(vector_rows(new), vector_rows(open_facts(t["facts"])), SCOPE, p.same).select(F.col("id").alias("fact_id"))
    added = cut(new.join(kept, "fact_id", "left_semi").select(*new.columns))
    facts = cut(t["facts"].unionByName(added))
    pairs = contradicted(facts, added.select("fact_id"), p, True)
    named = cut(p.entities(added).filter("entity <> ''").distinct())
    fresh_names = named.select("entity").distinct().join(t["entities"].select("entity"), "entity", "left_anti")
    entities = t["entities"].unionByName(shaped("entities", fresh_names.withColumn("embedding", p.embed(F.col("entity")))))
    related = p.relate(added, named).filter((F.col("confidence") >= 0.6) & (F.col("src") != F.col("dst"))).withColumn("predicate", text.predicate(F.col("predicate")))
    relations = t["relations"].unionByName(shaped("relations", related)).groupBy("src", "dst", "predicate").agg(F.max("confidence").alias("confidence"))
    tried = todo.join(failed.withColumn("failed", F.lit(True)), "episode_id", "left")
    again = F.when(F.col("failed"), scoring.next_retry(F.col("attempts") + 1, now, p.attempts))
    marks = t["marks"].unionByName(shaped("marks", tried.select(F.col("episode_id").alias("key"), F.lit("extraction").alias("step"), now.alias("at"), (F.col("attempts") + 1).alias("attempts"), again.alias("next_at"))))
    events = happened({"events": happened(t, added.select(F.col("fact_id").alias("target_id")), "create", "extraction", now)}, pairs.select(F.col("old_id").alias("target_id")).distinct(), "supersede", "extraction", now)
    return {"facts": shaped("facts", closed(facts, pairs)), "mentions": t["mentions"].unionByName(named.select("fact_id", "entity")), "entities": entities, "relations": shaped("relations", relations), "marks": marks, "events": events}


def synonyms(t: Rows, now: Column, p: Parts) -> Rows:
    """Entities without a mark of their own yet (no synonym pass has seen them) against all."""
    known = t["entities"].withColumn("id", F.xxhash64("entity"))
    seen = t["marks"].filter("step = 'synonyms'").select(F.col("key").alias("id"))
    new = known.select("id").join(seen, "id", "left_anti")
    rows = cut(known.join(new.withColumn("asks", F.lit(1)), "id", "left").select("id", "embedding", F.lit("e").alias("one"), "asks"))
    pairs = consolidate.synonyms(rows, ["one"], p.synonym, asks="asks").withColumn("score", F.round("score", 6))
    name = known.select("id", "entity")
    both = pairs.join(name.select(F.col("id").alias("lo"), F.col("entity").alias("a")), "lo").join(name.select(F.col("id").alias("hi"), F.col("entity").alias("b")), "hi")
    found = both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "score")
    marks = t["marks"].unionByName(shaped("marks", new.select(F.col("id").alias("key"), F.lit("synonyms").alias("step"), now.alias("at"))))
    return {"synonyms": shaped("synonyms", t["synonyms"].unionByName(shaped("synonyms", found)).groupBy("lo", "hi").agg(F.max("score").alias("score"))), "marks": marks}


def sweep(t: Rows, now: Column, p: Parts) -> Rows:
    """Facts that came in by other ways and weren't checked yet, the oldest first, each against all of its bucket; all of them are stamped."""
    ids = cut(cycle.sweep_queue(t["facts"], now, most=p.sweep).select("fact_id"))
    pairs = contradicted(t["facts"], ids, p, False)
    facts = closed(t["facts"], pairs).join(F.broadcast(ids.withColumn("hit", F.lit(1))), "fact_id", "left")  # at most sweep rows
    facts = facts.withColumn("checked_at", F.when(F.col("hit").isNotNull(), now).otherwise(F.col("checked_at")))
    return {"facts": shaped("facts", facts), "events": happened(t, pairs.select(F.col("old_id").alias("target_id")).distinct(), "supersede", "sweep", now)}


def consolidation(t: Rows, now: Column, p: Parts) -> Rows:
    """Clusters of an entity's open facts of one bucket, as the judge says, become one fact each. A fact belongs to the entity of its own with most open facts, so it is judged once."""
    live = open_facts(t["facts"])
    named = t["mentions"].join(live.select("fact_id"), "fact_id", "left_semi")
    size = named.groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 2")
    home = named.join(size, "entity").groupBy("fact_id").agg(F.min_by("entity", F.struct(-F.col("n"), "entity")).alias("entity"))
    rows = cut(live.join(home, "fact_id").select(F.col("fact_id").alias("id"), "embedding", "entity", *SCOPE))
    found = cut(consolidate.clusters(rows, ["entity", *SCOPE], p.cluster).select(F.col("id").alias("fact_id"), "cluster"))
    judged = p.judge(found.join(live, "fact_id").select("cluster", "fact_id", "content", "category", "confidence", "importance"))
    sound = judged.join(found, ["cluster", "fact_id"], "left_semi").filter("length(trim(merged)) BETWEEN 1 AND 500").dropDuplicates(["cluster", "fact_id"])
    members = cut(sound.join(sound.groupBy("cluster").agg(F.count("*").alias("n")).filter("n >= 2").select("cluster"), "cluster", "left_semi"))
    own = members.join(live, "fact_id")
    first = lambda c: F.min_by(c, "fact_id").alias(c)
    merged = own.groupBy("cluster").agg(F.min_by(F.trim("merged"), "fact_id").alias("content"), first("category"), F.min("valid_from").alias("valid_from"), F.max("confidence").alias("confidence"), F.max("importance").alias("importance"), F.sum("reference_count").alias("reference_count"), F.array_sort(F.collect_set("fact_id")).alias("merged_from"), first("project_id"), first("user_id"))
    base = t["facts"].agg(F.coalesce(F.max("fact_id"), F.lit(0).cast("long")).alias("base"))
    made = cut(numbered(merged, ["cluster"]).crossJoin(F.broadcast(base)).withColumn("fact_id", F.col("base") + 1 + F.col("nth")))  # one row
    new = shaped("facts", made.withColumns({"embedding": p.embed(F.col("content")), "recorded_at": now, "checked_at": now}))
    gone = members.select("fact_id").distinct().withColumn("hit", F.lit(1))
    facts = t["facts"].join(gone, "fact_id", "left").withColumn("valid_to", F.when(F.col("hit").isNotNull(), now).otherwise(F.col("valid_to")))
    taken = made.select(F.col("fact_id").alias("new"), F.explode("merged_from").alias("fact_id")).join(t["mentions"], "fact_id").select(F.col("new").alias("fact_id"), "entity").distinct()
    return {"facts": shaped("facts", facts).unionByName(new), "mentions": t["mentions"].unionByName(taken), "events": happened(t, made.select(F.col("fact_id").alias("target_id")), "merge", "consolidation", now)}


def promotion(t: Rows, now: Column, p: Parts) -> Rows:
    """Important open facts that no insight of their bucket says become insights; those that one does say support it. A fact that is a source already isn't asked again."""
    facts = t["facts"].join(t["sources"].select("fact_id"), "fact_id", "left_anti").withColumn("id", F.col("fact_id"))
    known = t["insights"].filter("retired_at IS NULL").select(F.col("insight_id").alias("id"), "embedding", *SCOPE)
    ids = known.withColumn("id", -1 - F.col("id"))  # insights bear the numbers of their first facts, which here are other rows
    new, support = cycle.promote(facts, ids, SCOPE)
    new = cut(new.select(F.col("id").alias("fact_id")))
    made = facts.join(new, "fact_id", "left_semi").select(F.col("fact_id").alias("insight_id"), "content", "embedding", *SCOPE)
    backed = support.select(F.when(F.col("insight_id") < 0, -1 - F.col("insight_id")).otherwise(F.col("insight_id")).alias("insight_id"), "fact_id")
    sources = t["sources"].unionByName(shaped("sources", new.select(F.col("fact_id").alias("insight_id"), "fact_id"))).unionByName(shaped("sources", backed)).distinct()
    return {"insights": t["insights"].unionByName(shaped("insights", made)), "sources": sources, "events": happened(t, new.select(F.col("fact_id").alias("target_id")), "promote", "promotion", now)}


def pruning(t: Rows, now: Column, p: Parts) -> Rows:
    """Open facts of low importance that nobody has used for long are closed and marked as pruned, not deleted: as of a time before now they are still there."""
    gone = cut(consolidate.prunable(t["facts"], now).select("fact_id"))
    out = t["facts"].join(gone.withColumn("hit", F.lit(1)), "fact_id", "left")
    hit = F.col("hit").isNotNull()
    out = out.withColumns({"pruned_at": F.when(hit, now).otherwise(F.col("pruned_at")), "valid_to": F.when(hit, now).otherwise(F.col("valid_to"))})
    return {"facts": shaped("facts", out), "events": happened(t, gone.select(F.col("fact_id").alias("target_id")), "prune", "pruning", now)}


def retirement(t: Rows, now: Column, p: Parts) -> Rows:
    """Insights all of whose sources are closed or deleted."""
    live = t["insights"].filter("retired_at IS NULL").select("insight_id")
    gone = cut(consolidate.retired(live, t["sources"], open_facts(t["facts"]).select("fact_id")))
    out = t["insights"].join(gone.withColumn("hit", F.lit(1)), "insight_id", "left")
    return {"insights": shaped("insights", out.withColumn("retired_at", F.when(F.col("hit").isNotNull(), now).otherwise(F.col("retired_at")))), "events": happened(t, gone.select(F.col("insight_id").alias("target_id")), "retire", "retirement", now)}


PASSES = [("summaries", summaries), ("extraction", extraction), ("synonyms", synonyms), ("sweep", sweep), ("consolidation", consolidation), ("promotion", promotion), ("pruning", pruning), ("retirement", retirement)]


def begin(journal: Journal, tables: Rows) -> None:
    """Commits the first tables, if there are none; what isn't given is empty."""
    if not journal.tables():
        journal.commit({name: shaped(name, tables[name]) if name in tables else plain(name, journal.spark) for name in TABLES}, "", "begin")


def run(journal: Journal, name: str, now: Column, parts: Parts = Parts(), deadline_s: float | None = None, passes: list | None = None, clock: Callable[[], float] = time.monotonic) -> list[str]:
    """Goes on with the cycle of that name: the passes that it did now. A cycle whose passes are all done does nothing."""
    began, done, out = clock(), journal.done(name), []
    for step, work in PASSES if passes is None else passes:
        if step in done:
            continue
        if deadline_s is not None and clock() - began >= deadline_s and step not in ("summaries", "extraction"):
            break
        changed = work(journal.tables(), now, parts)
        release(journal.spark)
        journal.commit(changed, name, step)
        release(journal.spark)
        out.append(step)
    return out
