"""State as immutable versions: (state, change) to new state. All passes are safe to repeat.

Keys of the state are unique; several changes of one key are folded first, as each pass says, so no row multiplies. Null keys match nothing: rows of the state stay as they are, changes are left
out (upsert: they come in as rows of their own). Empty tables on either side are no special case; columns of the state pass whatever their names, those of the changes that aren't named stay out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scoring, temporal, text


def snapshot(facts: DataFrame, at: Column) -> DataFrame:
    """Facts valid at an instant, without deleted ones and without those that a fact valid then, deleted or not, has taken in (merged_from: an array of ids)."""
    valid = facts.filter(temporal.valid_at(at))
    taken = valid.select(F.explode("merged_from").alias("fact_id"))
    return valid.filter(temporal.visible()).join(taken, "fact_id", "left_anti")


def folded(changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Changes once a key: of each column the last value that isn't null, by order (else by the changes' own columns, so that any order of rows gives the same). Null keys stay rows of their own."""
    others = [c for c in changes.columns if c != key]
    place = F.struct(*(order or sorted(others))) if others else F.lit(0)
    # the last value of each column: null places lose, so a null never takes a value's place
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in others]
    own = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*last) if last else changes.filter(F.col(key).isNotNull()).distinct()
    return own.select(*changes.columns).unionByName(changes.filter(F.col(key).isNull()))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win column by column where they have a value; keys on either side stay. Several new rows of a key count as one (folded)."""
    o, n = old.alias("o"), folded(new, key).alias("n")
    columns = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def supersede(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (old_id, new_from): open facts close at the later of both starts; applied tells which did."""
    p = pairs.groupBy("old_id").agg(F.min("new_from").alias("new_from"))
    hit = F.col("new_from").isNotNull() & F.col("valid_to").isNull() & temporal.visible()
    out = facts.join(p, F.col("fact_id") == F.col("old_id"), "left").withColumn("applied", hit)
    return out.withColumn("valid_to", F.when(hit, temporal.closes_at(F.col("valid_from"), F.col("new_from"))).otherwise(F.col("valid_to"))).drop("old_id", "new_from")


def soft_delete(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """ids (fact_id): deleted now, closed now if open; those already deleted stay as they are."""
    hit = F.col("hit").isNotNull() & F.col("deleted_at").isNull()
    out = facts.join(ids.select("fact_id").distinct().withColumn("hit", F.lit(1)), "fact_id", "left").withColumn("applied", hit)
    return out.withColumns({"deleted_at": F.when(F.col("applied"), now).otherwise(F.col("deleted_at")), "valid_to": F.when(F.col("applied"), F.coalesce("valid_to", now)).otherwise(F.col("valid_to"))}).drop("hit")


def intervals(changes: DataFrame, key: list[str], start: str = "valid_from", tie: str = "pref_id") -> DataFrame:
    """Changes of a key to slowly changing intervals: each closes where the next starts."""
    own = Window.partitionBy(*key).orderBy(start, tie)
    return changes.withColumns({"valid_to": F.lead(start).over(own), "version": F.row_number().over(own)})


def revision(rows: DataFrame, key: str, kind: str, reason: str, leave_out: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """A snapshot row for each row: original_id, original_kind, reason, snapshot (JSON without vectors)."""
    return rows.select(F.col(key).alias("original_id"), F.lit(kind).alias("original_kind"), F.lit(reason).alias("reason"), F.to_json(F.struct(*(c for c in rows.columns if c not in leave_out))).alias("snapshot"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("nth = 1").drop("nth")


def tick(facts: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Facts returned by recall (hits: fact_id, repeats count once) are used once more, now."""
    out = facts.join(hits.select("fact_id").distinct().withColumn("hit", F.lit(1)), "fact_id", "left")
    return out.withColumns({"reference_count": F.col("reference_count") + F.coalesce("hit", F.lit(0)), "last_used": F.when(F.col("hit").isNotNull(), now)}).drop("hit")


def merge(facts: DataFrame, members: DataFrame, now: Column, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """members (group, fact_id): (new facts, one a group; the members, closed now). Only open, visible members count; uses are pooled, the last use is the latest,
    importance is the greatest less a tenth, and the interval starts with the first member. The new fact names what its members are (merged_from) and, given
    mentions (fact_id, entity), all their entities. Repeated members count once; a group without open members gives nothing."""
    own = facts.filter(F.col("valid_to").isNull() & temporal.visible()).join(members.select("group", "fact_id").distinct(), "fact_id")
    last = [F.max("last_used").alias("last_used")] if "last_used" in facts.columns else []
    new = own.groupBy("group").agg(F.sum("reference_count").alias("reference_count"), F.count("*").alias("n"), F.min("valid_from").alias("valid_from"), F.min("confidence").alias("least_confidence"), F.max("confidence").alias("most_confidence"), F.greatest(F.lit(0.0), F.max("importance") - 0.1).alias("importance"), F.array_sort(F.collect_set("fact_id")).alias("merged_from"), *last)
    if mentions is not None:
        named = own.select("group", "fact_id").join(mentions, "fact_id").groupBy("group").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
        new = new.join(named, "group", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    return new, own.withColumn("valid_to", now)


def new_versions(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """state (key, version, value, live) and changes (key, value): live rows with a change retire, and a copy of the next version carries it; of several values the greatest, null if there is no other."""
    n = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("value").alias("to"), F.lit(True).alias("hit"))
    both = state.join(n, key, "left").withColumn("hit", F.col("live") & F.col("hit").isNotNull())
    rows = F.when(F.col("hit"), F.array(F.struct("version", "value", F.lit(False).alias("live")), F.struct((F.col("version") + 1).alias("version"), F.col("to").alias("value"), F.lit(True).alias("live")))).otherwise(F.array(F.struct("version", "value", "live")))
    return both.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets the columns whose flag set_<column> is true, to null too; keys that old lacks are left out. Of several changes of a key and column the greatest value is set, null if there is no other."""
    flag = lambda c: F.coalesce(F.col(f"set_{c}"), F.lit(False))
    sets = [x for c in columns for x in (F.max(F.when(flag(c), F.col(c))).alias(c), F.bool_or(flag(c)).alias(f"set_{c}"))]
    o, n = old.alias("o"), changes.groupBy(key).agg(*sets).alias("n")
    new = [F.when(F.coalesce(F.col(f"n.set_{c}"), F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in columns else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left").select(*new)


def record_failures(jobs: DataFrame, failed: DataFrame, key: str, now: Column, most: int) -> DataFrame:
    """Failed jobs have one attempt more and a new time to try again; null where attempts are used up (dead)."""
    out = jobs.join(failed.select(key).distinct().withColumn("hit", F.lit(1)), key, "left").withColumn("attempts", F.col("attempts") + F.coalesce("hit", F.lit(0)))
    return out.withColumns({"next_at": F.when(F.col("hit").isNotNull(), scoring.next_retry(F.col("attempts"), now, most)).otherwise(F.col("next_at")), "dead": F.col("attempts") >= most}).drop("hit")


def fold_names(rows: DataFrame, name: str, kind: str, order: str) -> DataFrame:
    """One row for names alike but for case and outer blanks: name_norm, name and kind of the first by order, n."""
    return rows.groupBy(text.normal_name(F.col(name)).alias("name_norm")).agg(F.min_by(name, order).alias("name"), F.min_by(kind, order).alias("kind"), F.count("*").alias("n"))
