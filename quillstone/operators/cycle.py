"""The batch cycle: pure passes over tables, composed by a driver, with the model's parts as hooks.

A hook is a function of DataFrames with a plain default, so a cycle runs and is tested without any model. Every pass is safe to repeat. These are passes over tables given as they are; the whole cycle, with
its judge, over committed tables is in resume.py."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import temporal, text
from quillstone.operators import consolidate, lifecycle
from quillstone.sources.store import cut


def first_lines(texts: DataFrame, key: str, column: str, tokens: int) -> DataFrame:
    """The default summariser: as much of a text as fits. key, summary."""
    return texts.select(key, text.fit_tokens(F.col(column), tokens).alias("summary"))


def per_line(chunks: DataFrame) -> DataFrame:
    """The default extractor: a fact for each sentence of a chunk. chunk_id, nth, content."""
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.length(x) > 0)
    return chunks.select("chunk_id", F.posexplode(sentences).alias("nth", "content"))


def named_together(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """The default relation extractor: the first two entities of a fact. src, dst, confidence (of the fact)."""
    two = mentions.groupBy("fact_id").agg(F.slice(F.array_sort(F.collect_set("entity")), 1, 2).alias("e")).filter(F.size("e") == 2)
    return facts.join(two, "fact_id").select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), "confidence")


@dataclass(frozen=True)
class Hooks:
    summarise: Callable[[DataFrame, str, str, int], DataFrame] = first_lines
    extract: Callable[[DataFrame], DataFrame] = per_line
    relate: Callable[[DataFrame, DataFrame], DataFrame] = named_together
    decide: Callable[[DataFrame], DataFrame] | None = None


def summarised(texts: DataFrame, key: str, column: str, tokens: int, hook: Callable = first_lines, rounds: int = 3, share: float = 0.6, context: int = 2000) -> DataFrame:
    """Map and reduce: texts longer than a share of the context are cut into parts of that size, each part is summarised, and the joined summaries go
    round again, at most so many times. key, summary; null texts have none."""
    size = int(4 * share * context)
    todo = texts.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("body"))
    for _ in range(rounds - 1):
        n = F.greatest(F.lit(1), F.ceil(F.length("body") / size)).cast("int")
        parts = todo.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * size + 1, F.lit(size)))).alias("part", "body"), (n > 1).alias("long"))
        single, several = parts.filter("NOT long").select(key, "body"), parts.filter("long").withColumn("row", F.struct(key, "part"))
        shorter = hook(several, "row", "body", max(1, tokens)).select(F.col(f"row.{key}").alias(key), F.col("row.part").alias("part"), "summary")
        joined = shorter.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]), "\n").alias("body"))
        todo = single.unionByName(joined)
    return hook(todo, key, "body", tokens)


def install_summaries(episodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Provisional or missing summaries are replaced; full ones stay. episodes (episode_id, summary, summary_kind), summaries (episode_id, summary)."""
    new = summaries.groupBy("episode_id").agg(F.min("summary").alias("new"))  # of several, one
    out = episodes.join(new, "episode_id", "left")
    hit = F.col("new").isNotNull() & ~F.col("summary_kind").eqNullSafe(F.lit("full"))
    return out.withColumns({"summary": F.when(hit, F.col("new")).otherwise(F.col("summary")), "summary_kind": F.when(hit, "full").otherwise(F.col("summary_kind"))}).drop("new")


def extracted(chunks: DataFrame, episodes: DataFrame, hook: Callable = per_line) -> DataFrame:
    """Facts out of chunks, with their episode's scope, and its time as the start of what they say. chunk_id, nth, content, valid_from, scope axes."""
    own = chunks.select("chunk_id", "episode_id").join(episodes.select("episode_id", "project_id", "user_id", "agent_id", "session_id", F.col("recorded_at").alias("valid_from")), "episode_id")
    return hook(chunks).join(own, "chunk_id")


def relations(found: DataFrame, least: float = 0.6) -> DataFrame:
    """Relations (src, dst, confidence) sure enough and without loops, once a pair: the surest."""
    return found.filter((F.col("confidence") >= least) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def sweep_queue(facts: DataFrame, now: Column, grace_s: int = 60, most: int = 50) -> DataFrame:
    """Open facts not yet checked for what they supersede, older than a grace time, the oldest first."""
    due = F.col("checked_at").isNull() & F.col("valid_to").isNull() & temporal.visible() & (F.unix_micros(F.col("recorded_at")) <= F.unix_micros(now) - grace_s * 1_000_000)
    return facts.filter(due).orderBy("recorded_at", "fact_id").limit(most)


def promote(facts: DataFrame, insights: DataFrame, bucket: list[str], least: float = 0.85, same: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """(new insights, corroborations): important open facts (id, embedding, bucket) that no insight of their bucket, old or newly made, says already; those that one
    does say support it: insight_id, fact_id."""
    important = consolidate.promotable(facts, least).select("id", "embedding", *bucket)
    new = cut(consolidate.fresh(important, insights, bucket, same))
    rest = important.join(new, "id", "left_anti").withColumn("side", F.lit(0))
    known = insights.select("id", "embedding", *bucket).unionByName(important.join(new, "id", "left_semi")).withColumn("side", F.lit(1))
    return new, consolidate.nearest(rest.unionByName(known), bucket, same, 1, sided=True).select(F.col("right_id").alias("insight_id"), F.col("left_id").alias("fact_id"))


def reaped(runs: DataFrame, started: Column) -> DataFrame:
    """Runs (state, began, ended) still marked running from before this start are failed now."""
    stale = (F.col("state") == "running") & (F.col("began") < started)
    return runs.withColumns({"state": F.when(stale, "failed").otherwise(F.col("state")), "ended": F.when(stale, started).otherwise(F.col("ended"))})


def requeued(jobs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Jobs (job_id, done_at, attempts, next_at) to be done again: all, or those in ids (job_id)."""
    rows = jobs.withColumn("hit", F.lit(True)) if ids is None else jobs.join(ids.select("job_id").distinct().withColumn("hit", F.lit(True)), "job_id", "left")
    hit = F.col("hit").isNotNull()
    return rows.withColumns({c: F.when(~hit, F.col(c)) for c in ("done_at", "next_at")} | {"attempts": F.when(hit, 0).otherwise(F.col("attempts"))}).drop("hit")


def bounded_delete(rows: DataFrame, where: Column, order: list[Column | str], most: int) -> DataFrame:
    """rows without the first so many that where holds for, by order (names or Columns; key columns last, so that it is total). Nulls in it are values like others."""
    key = [c for c in rows.columns if c in order]
    go = rows.filter(where).orderBy(*order).limit(most).select(*(F.col(c).alias(f"{c}__") for c in key))  # at most so many
    return rows.join(F.broadcast(go), reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in key)), "left_anti")


def moved_intentions(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Intentions (intention_id, status, due_at, valid_to, completed_at, fired, last_fired_at) after changes (intention_id, change: completed, cancelled or fired), and with pending ones
    expired that are overdue by seven days. A fired one stays pending. Several changes of one count together: each firing, then its end, completed before cancelled."""
    change, named = F.col("change"), F.col("change").isin("completed", "cancelled")
    once = changes.groupBy("intention_id").agg(F.coalesce(F.max(F.when(named, change)), F.max(change)).alias("change"), F.count_if(change == "fired").cast("int").alias("firings"))  # "completed" is the greater name
    out = rows.join(once, "intention_id", "left")
    ends, fires = change.isin("completed", "cancelled"), F.coalesce(F.col("firings"), F.lit(0)) > 0
    expires = change.isNull() & (F.col("status") == "pending") & (F.col("due_at") <= now - F.expr("INTERVAL 7 DAYS"))
    return out.withColumns({
        "completed_at": F.when(change == "completed", now).otherwise(F.col("completed_at")),
        "valid_to": F.when(ends | expires, now).otherwise(F.col("valid_to")),
        "fired": F.col("fired") + F.coalesce(F.col("firings"), F.lit(0)),
        "last_fired_at": F.when(fires, now).otherwise(F.col("last_fired_at")),
        "status": F.when(ends, change).when(expires, "expired").otherwise(F.col("status")),
    }).drop("change", "firings")


@dataclass(frozen=True)
class Tables:
    """What a cycle reads and gives anew. done tells the passes that ran."""

    facts: DataFrame
    episodes: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    relations: DataFrame | None = None
    extracted: DataFrame | None = None
    pruned: DataFrame | None = None
    done: tuple[str, ...] = field(default=())


def summaries_pass(t: Tables, now: Column, hooks: Hooks) -> Tables:
    bodies = t.chunks.filter("text IS NOT NULL").groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("body"))
    todo = bodies.join(t.episodes.filter("summary_kind = 'provisional'").select("episode_id"), "episode_id", "left_semi")
    return replace(t, episodes=install_summaries(t.episodes, summarised(todo, "episode_id", "body", 64, hooks.summarise)))


def extraction_pass(t: Tables, now: Column, hooks: Hooks) -> Tables:
    return replace(t, extracted=extracted(t.chunks, t.episodes, hooks.extract))


def relations_pass(t: Tables, now: Column, hooks: Hooks) -> Tables:
    return replace(t, relations=relations(hooks.relate(t.facts, t.mentions)))


def supersede_pass(t: Tables, now: Column, hooks: Hooks) -> Tables:
    """The newest open fact of an entity and category closes the older ones there, unless a decider, given (new_id, old_id), says otherwise."""
    own = Window.partitionBy("entity_id", "category").orderBy(F.col("valid_from").desc(), F.col("fact_id").desc())
    open_ = t.facts.filter(F.col("valid_to").isNull() & temporal.visible())
    pairs = open_.withColumn("new_id", F.first("fact_id").over(own)).withColumn("new_from", F.first("valid_from").over(own)).filter("fact_id <> new_id").select(F.col("fact_id").alias("old_id"), "new_id", "new_from")
    pairs = pairs if hooks.decide is None else hooks.decide(pairs)
    return replace(t, facts=lifecycle.supersede(t.facts, pairs.select("old_id", "new_from")).drop("applied"))


def prune_pass(t: Tables, now: Column, hooks: Hooks) -> Tables:
    gone = consolidate.prunable(t.facts, now).select("fact_id")
    return replace(t, pruned=gone, facts=lifecycle.soft_delete(t.facts, gone, now).drop("applied"))


PASSES = [("summaries", summaries_pass), ("extraction", extraction_pass), ("relations", relations_pass), ("supersede", supersede_pass), ("prune", prune_pass)]


def run(t: Tables, now: Column, hooks: Hooks = Hooks(), deadline_s: float | None = None, passes: list | None = None, clock: Callable[[], float] = time.monotonic) -> Tables:
    """The passes in order, each pass's tables written to the shared folder. Past the deadline no further pass begins; what is done stays done."""
    began = clock()
    for name, step in PASSES if passes is None else passes:
        if deadline_s is not None and clock() - began >= deadline_s:
            break
        after = step(t, now, hooks)
        changed = {n: cut(df) for n in ("facts", "episodes", "relations", "extracted", "pruned") if (df := getattr(after, n)) is not None and df is not getattr(t, n)}
        t = replace(after, **changed, done=(*t.done, name))
    return t
