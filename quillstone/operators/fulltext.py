"""A stored inverted index: built once, read by term.

Postings lie in rows (term, block): a term's documents in order of id, ``BLOCK`` in a row, with their term counts and lengths, and the block's greatest count and least length, which bound the score of any
of its documents. Rows are dealt and sorted by term, so a filter by term prunes files and row groups. Documents come in segments, one for each ``add``; ``delete`` notes ids and takes their terms' counts back, so
ranks are those of an index of the documents that are there.

``search`` is exact for the top k: what the k-th best document has for one term alone, out of the k best-bounded blocks, is a score that the result can't fall below; a block whose bound, with the bounds
of all other terms, stays below that isn't opened. A document of such a block isn't among the best; all others' blocks are opened.

Edge cases: null and empty texts count as documents of no terms; null ids are left out; repeated ids within a segment are told apart by nothing, so ids are unique; ties go to the lesser id; requests without known terms find
nothing; an empty index finds nothing; a deleted id may be added again in a later segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.english import ANALYZERS, analyzed
from quillstone.sources.store import cut, exists

BLOCK, K1, B = 128, 1.2, 0.75
#: Row groups are small, so that few of them hold a term.
LAYOUT = {"parquet.block.size": 1 << 20, "compression": "zstd"}
POSTINGS = "term string, block int, docs array<long>, counts array<int>, lengths array<int>, most int, shortest int, segment int"


def _terms(docs: DataFrame, key: str, column: str, analyzer: str) -> DataFrame:
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), analyzed(F.col(column), analyzer).alias("terms"))
    return rows.withColumn("length", F.size("terms"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.select("id", "length", F.explode("terms").alias("term")).groupBy("term", "id", "length").agg(F.count("*").cast("int").alias("n"))


def _noted(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    return _noted(spark, path, "sizes", "segment int, docs long, length long")


def _changed(rows: DataFrame, counts: DataFrame, path: str, segment: int, sign: int) -> None:
    """Notes how many documents each term gained or lost, then how many there are in all; the segment counts from then on."""
    held = counts.groupBy("term").agg((sign * F.count("*")).alias("df")).withColumn("segment", F.lit(segment))
    held.repartitionByRange("term").sortWithinPartitions("term").write.mode("append").options(**LAYOUT).parquet(f"{path}/frequencies")
    rows.agg((sign * F.count("*")).alias("docs"), (sign * F.coalesce(F.sum("length"), F.lit(0))).cast("long").alias("length")).select(F.lit(segment).alias("segment"), "docs", "length").write.mode("append").parquet(f"{path}/sizes")


def _next(spark: SparkSession, path: str) -> int:
    return (_sizes(spark, path).agg(F.max("segment")).first()[0] or 0) + 1


def add(docs: DataFrame, path: str, key: str, column: str, analyzer: str = "english", block: int = BLOCK) -> None:
    """Adds documents (key, column) to the index in path, as a segment of its own."""
    spark = docs.sparkSession
    segment, rows = _next(spark, path), cut(_terms(docs, key, column, analyzer))
    counts = cut(_counted(rows))
    # a term's documents are dealt to blocks by ranges of ids that hold about block of them, so a term of very many documents is no single task's
    own = counts.groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    part = F.floor((F.col("id") - F.col("lo")) / ((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("df") / block))).cast("int")
    placed = counts.join(own, "term").select("term", part.alias("part"), F.struct("id", "n", "length").alias("p"))
    blocks = placed.groupBy("term", "part").agg(F.array_sort(F.collect_list("p")).alias("p"))
    cutup = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("p") - 1, F.lit(block)))).withColumn("p", F.slice("p", F.col("at") + 1, block))  # uneven ids: longer ones are cut again
    out = cutup.select("term", F.row_number().over(Window.partitionBy("term").orderBy("part", "at")).alias("block"), F.col("p.id").alias("docs"), F.col("p.n").alias("counts"), F.col("p.length").alias("lengths"), F.array_max("p.n").alias("most"), F.array_min("p.length").alias("shortest"), F.lit(segment).alias("segment"))
    out.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("append").options(**LAYOUT).parquet(f"{path}/postings")
    _changed(rows, counts, path, segment, 1)


def delete(docs: DataFrame, path: str, key: str, column: str, analyzer: str = "english") -> None:
    """Takes documents, given with their texts as they were added, out of the index."""
    spark = docs.sparkSession
    segment, rows = _next(spark, path), cut(_terms(docs, key, column, analyzer))
    rows.select("id", F.lit(segment).alias("until")).write.mode("append").parquet(f"{path}/gone")
    _changed(rows, _counted(rows), path, segment, -1)


def _weight(n, length, idf, mean):
    return idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The blocks of terms; the filter reaches the scan."""
    return _noted(spark, path, "postings", POSTINGS).filter(F.col("term").isin(*terms))


def search(spark: SparkSession, path: str, words: str, k: int, analyzer: str = "english", skip: bool = True) -> DataFrame:
    """id, score: the k best documents by BM25. skip: whether blocks that can't matter are passed over; the result is the same."""
    terms = sorted({*ANALYZERS[analyzer](words)})
    if not terms:
        return spark.createDataFrame([], "id long, score double")
    whole = _sizes(spark, path).agg(F.sum("docs").cast("double").alias("all"), (F.sum("length") / F.sum("docs")).alias("mean"))  # one row
    df = _noted(spark, path, "frequencies", "term string, df long, segment int").filter(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    known = df.crossJoin(F.broadcast(whole)).select("term", F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")  # a row a term of the request
    blocks = postings(spark, path, terms).join(F.broadcast(known), "term").withColumn("bound", _weight(F.col("most"), F.col("shortest"), F.col("idf"), F.col("mean")))
    gone = _noted(spark, path, "gone", "id long, until int")

    def opened(rows: DataFrame) -> DataFrame:
        each = rows.select("term", "idf", "mean", "segment", F.explode(F.arrays_zip("docs", "counts", "lengths")).alias("p"))
        scored = each.select("term", "segment", F.col("p.docs").alias("id"), _weight(F.col("p.counts"), F.col("p.lengths"), F.col("idf"), F.col("mean")).alias("score"))
        dead = gone.select(F.col("id").alias("dead"), "until")
        return scored.join(dead, (F.col("id") == F.col("dead")) & (F.col("segment") < F.col("until")), "left_anti")

    if skip:
        best = blocks.orderBy(F.col("bound").desc(), "term", "block", "segment").limit(k)  # k blocks at most
        floor = opened(best).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc()).limit(k).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        tops = blocks.groupBy("term").agg(F.max("bound").alias("top"))
        others = tops.withColumn("sum", F.sum("top").over(Window.partitionBy(F.lit(1)))).select("term", (F.col("sum") - F.col("top")).alias("others"))  # a row a term of the request
        blocks = blocks.join(F.broadcast(others), "term").crossJoin(F.broadcast(floor)).filter("floor IS NULL OR bound + others >= floor - 1e-9")
    return opened(blocks).groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.round("score", 9).desc(), "id").limit(k)
