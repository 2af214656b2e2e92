"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run`` writes what each
stage returns to the shared folder and reads it back for the next; what the stage before left there is removed then.

All stages: an empty table gives an empty table; other columns pass whatever their names (the last stage adds n_tokens, token_ids and decoded, and replaces columns so named);
texts of any length are taken whole; rows may be equal in any columns, and any column may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import encoded
from quillstone.llm.common import discard, read, shared_table
from quillstone.llm.decontaminate import decontaminate
from quillstone.llm.line_dedup import dedup_lines
from quillstone.llm.quality import keep_quality
from quillstone.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are far from their language go. Null, empty and blank texts fail; a null language is judged by character classes alone; equal rows
    get equal verdicts."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; n_chars follows. A document may be left with an empty text. Null texts become empty; equal rows count
    one by one and lose the same lines."""
    return dedup_lines(docs, min_docs=10)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those of operator 8, and those with a similarity of 0.8 or more on shingles of five words.
    The least doc_id stays, null last, and one of rows that are equal in doc_id and text. Texts without words are one group."""
    return drop_near_duplicates(docs, similar_width=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay; an empty benchmark lets all pass."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, n_tokens, token_ids (binary, little-endian 32 bits) and the text that those ids decode to. Null and empty texts
    have no ids and decode to the empty text."""
    bpe = encoded(F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    made = ["n_tokens", "token_ids", "decoded"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), bpe.alias("bpe"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), *(F.col("bpe")[c].alias(c) for c in made))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The distances of stage 1 and the hashes of stages 3 and 5 have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = shared_table(kept)
        discard(*done, *getattr(kept, "leftovers", []))
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
