"""Ingestion with a report by row: every line is accepted, or quarantined with all rules that it breaks; none fails the others.

Rules are Columns, compiled into one pass. A batch of more than ``BATCH`` lines is quarantined as a whole. Quarantined lines keep their text, so they can be mended and go in again.

Edge cases: a null line is malformed; a rule that is null for a row is broken; repeated lines are judged one by one; empty inputs give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 500


def judged(lines: DataFrame, schema: str, rules: dict[str, Column], most: int = BATCH) -> DataFrame:
    """lines (batch, line) with row (the parsed line) and broken (names of rules, in order; malformed lines break that alone)."""
    parsed = F.from_json("line", f"{schema}, malformed__ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed__"})
    rows = lines.select("batch", "line", parsed.alias("row"))
    sizes = lines.groupBy("batch").agg((F.count("*") > most).alias("large"))  # counts alone are dealt by batch
    rows = rows.join(sizes.filter("large").select(F.col("batch").alias("big"), "large"), F.col("batch").eqNullSafe(F.col("big")), "left")
    alone = F.from_json(F.concat(F.lit("["), F.col("line"), F.lit("]")), "array<string>")  # tells what follows a whole object, which a parser of one object passes over
    bad = F.col("row").isNull() | F.col("row.malformed__").isNotNull() | alone.isNull() | (F.size(alone) != 1)
    fields = rows.select("batch", "line", "row", "large", bad.alias("malformed"), "row.*")
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in sorted(rules.items()))))
    large = F.when(F.col("large"), F.array(F.lit("batch_too_large"))).otherwise(F.array().cast("array<string>"))
    return fields.select("batch", "line", F.col("row").dropFields("malformed__").alias("row"), F.concat(large, F.when(F.col("malformed"), F.array(F.lit("malformed"))).otherwise(broken)).alias("broken"))


def ingested(lines: DataFrame, schema: str, rules: dict[str, Column], most: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in their columns, quarantine: batch, line, broken)."""
    rows = judged(lines, schema, rules, most)
    return rows.filter(F.size("broken") == 0).select("row.*"), rows.filter(F.size("broken") > 0).select("batch", "line", "broken")


def report(quarantine: DataFrame) -> DataFrame:
    """How many lines broke each rule: rule, n."""
    return quarantine.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def replayed(quarantine: DataFrame, mend: Column, schema: str, rules: dict[str, Column], size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The quarantine's lines, mended (a Column over line and broken), once more, in batches of about half the size that is let through, by a hash of the line; equal lines aren't told apart, so
    those of one hash that are too many stay in quarantine."""
    n = quarantine.agg(F.greatest(F.lit(1), F.ceil(2 * F.count("*") / size)).alias("batches"))  # one row
    again = quarantine.crossJoin(F.broadcast(n)).select(F.pmod(F.xxhash64("line", F.monotonically_increasing_id()), F.col("batches")).alias("batch"), mend.alias("line"))
    return ingested(again, schema, rules, size)
