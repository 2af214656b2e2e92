"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 1).

Each shard has ``replicas`` points on a ring of 64-bit hashes. A row belongs to the arc that its key's hash falls in; the arc's
owner is its home. No shard takes more than its capacity: what overflows goes on clockwise to the next arc's owner that has room.
With load factor 1 the capacities are the floor or ceiling of rows / shards, so row counts differ by one at most.

Which rows of an arc overflow is decided by counts of (arc, chunk), a chunk being one of ``chunks`` parts of an arc by a second
hash. Their number is bounded by shards * replicas * chunks, whatever the input; the driver places those counts, and a window over each (arc, chunk) numbers the
rows. A key that holds a third of all rows is spread over all chunks of its arc.

Edge cases: null keys and null texts (size 1, crc of nothing) are placed like any others; equal rows are told apart by their place in
the input; an empty table gives no rows; other columns stay with ``assign``, whatever their names, but for columns named like its outputs, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm.common import shared_table

PLACES = T.StructType([T.StructField(n, t, False) for n, t in (("arc", T.IntegerType()), ("chunk", T.IntegerType()), ("first", T.LongType()), ("past", T.LongType()), ("shard", T.IntegerType()), ("base", T.LongType()))])


def ring(shards: int, replicas: int) -> tuple[np.ndarray, list[int]]:
    """The points' places in order, and their shards."""
    points = sorted((xxhash.xxh64_intdigest(f"shard-{s}/{r}") - (1 << 63), s) for s in range(shards) for r in range(replicas))
    return np.array([p for p, _ in points], dtype=np.int64), [s for _, s in points]


def place(counts: dict[tuple[int, int], int], owners: list[int], shards: int, load_factor: float = 1.0) -> list[tuple]:
    """Bounded loads: rows (arc, chunk, first, past, shard, base): the chunk's rows first..past-1 get the shard's slots from base on."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)] if load_factor <= 1 else [int(np.ceil(load_factor * total / shards))] * shards
    used, out = [0] * shards, []
    left = {k: 0 for k in sorted(counts) if counts[k]}
    step = 0
    while left:  # in round r, what is left of an arc asks the r-th next point; each round but the last fills a shard or places all
        for key in list(left):
            shard = owners[(key[0] + step) % len(owners)]
            n = min(counts[key] - left[key], room[shard] - used[shard])
            if n:
                out.append((*key, left[key], left[key] + n, shard, used[shard]))
                used[shard] += n
                left[key] += n
                if left[key] == counts[key]:
                    del left[key]
        step += 1
    return out


def assign(rows: DataFrame, key: str, shards: int, replicas: int = 64, chunks: int = 32, load_factor: float = 1.0) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard)."""
    points, owners = ring(shards, replicas)

    @F.arrow_udf(T.IntegerType())
    def arc(h: pa.Array) -> pa.Array:
        return pa.array((np.searchsorted(points, h.to_numpy(zero_copy_only=False)) % len(points)).astype(np.int32))

    keyed = rows.select(F.struct("*").alias("row"), F.xxhash64(F.lit(0), F.col(key)).alias("place"), F.monotonically_increasing_id().alias("seen"))
    keyed = keyed.withColumns({"arc": arc("place"), "chunk": F.pmod(F.xxhash64("place", "seen"), F.lit(chunks)).cast("int")})
    keyed = shared_table(keyed)  # 'seen' must not change between the two uses
    counts = {(r.arc, r.chunk): r.n for r in keyed.groupBy("arc", "chunk").agg(F.count("*").alias("n")).collect()}  # at most shards * replicas * chunks
    places = rows.sparkSession.createDataFrame(place(counts, owners, shards, load_factor), PLACES)
    numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("arc", "chunk").orderBy("place", "seen")) - 1)
    near = (numbered.arc == places.arc) & (numbered.chunk == places.chunk) & (numbered.nth >= places["first"]) & (numbered.nth < places.past)
    placed = numbered.join(F.broadcast(places), near)  # as many rows as counts and at most one more for each that a shard's limit cuts
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", (places.base + numbered.nth - places["first"]).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, **options: object) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return assign(rows, "doc_id", shards, **options).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
