"""Cosine on arrays, on two scales: raw (-1 to 1) and index (0 to 1). Thresholds of the one don't fit the other."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of unlike length, and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def index_score(raw: Column) -> Column:
    return (1 + raw) / 2


def hashed_terms(rows: DataFrame, key: str, column: str, dim: int = 256) -> DataFrame:
    """A plain embedder without a model, in sparse form: words hashed to dim buckets, counted, of unit norm. key, bucket, weight."""
    word = F.explode(F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != ""))
    bucket = F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("long") % dim
    counts = rows.select(key, word.alias("word")).groupBy(key, bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    return counts.select(key, "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).alias("weight"))


@lru_cache(maxsize=200_000)
def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def hashed_words(text: Column, dim: int = 256, batch_chars: int = 1 << 20) -> Column:
    """The plain embedder in dense form: a unit array of dim counts of hashed words; null for null texts and texts without words. Texts are worked on in batches of about so many
    characters, as a model's embedder would be."""

    def vector(words: list[str]) -> np.ndarray | None:
        if not words:
            return None
        counts = np.bincount([_bucket(w, dim) for w in words], minlength=dim).astype(float)
        return counts / np.sqrt(counts @ counts)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out, size = [], 0
            for t in texts.to_pylist():
                out.append(vector([w for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w]))
                size += len(t or "")
                if size >= batch_chars:
                    yield pa.array(out, pa.list_(pa.float64()))
                    out, size = [], 0
            if out:
                yield pa.array(out, pa.list_(pa.float64()))

    return run(text)
