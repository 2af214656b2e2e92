"""Links between texts of high Jaccard similarity on word shingles, for the pipeline's near-duplicate stage.

MinHash only proposes: ``BANDS`` bands of ``ROWS`` minima each put texts into cells, so a pair of similarity s meets with chance 1 - (1 - s ** ROWS) ** BANDS
(at 0.8 all but 1 in 96,000). Each link is then verified by the exact similarity of the two sets of shingle hashes. A cell is a task's unit, and a spanning
forest of its links comes out, never all pairs; cells of many texts or long ones are cut into parts, each pair of parts a unit of its own.

Edge cases: null, empty and blank texts have no shingles and no links; texts of fewer words than a shingle are one shingle of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import ASCII_LOWER, parallelism, row_key, shared_table

BANDS, ROWS = 16, 3
_R = np.random.default_rng(5)
SEEDS, FACTORS = _R.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64), _R.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH = T.StructType([T.StructField("set_key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h, out = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), None
    width = min(width, len(words))
    for i in range(width):
        part = h[i : len(h) - width + 1 + i]
        out = part.copy() if out is None else ((out ^ (out >> np.uint64(29))) * MIX) + part
    out = out + np.uint64(width)
    return np.unique((out ^ (out >> np.uint64(32))) * MIX)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band of minima."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 20_000):
        np.minimum(least, ((hashes[at : at + 20_000, None] ^ SEEDS) * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], dtype=np.uint64).view(np.int64)


def sketches(text: Column, width: int) -> Column:
    """A key of the set of shingles, its size, and its bands (none for texts without words)."""

    @F.arrow_udf(SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        keys, sizes, out = [], [], []
        for t in texts.cast(pa.binary()):
            s = shingles(t.as_py(), width)
            keys.append(xxhash.xxh64_intdigest(s.tobytes()))
            sizes.append(len(s))
            out.append(bands(s) if len(s) else [])
        return pa.StructArray.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], SKETCH.names)

    return run(text)


def sets(text: Column, width: int) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py(), width).tobytes() for t in texts.cast(pa.binary())], pa.binary())

    return run(text)


class Near:
    """Which of some sets are as near to a given one."""

    def __init__(self, own: list[np.ndarray], least: float):
        self.own, self.least = own, Fraction(str(least))
        self.sizes = np.array([len(s) for s in own])

    def to(self, s: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The indexes of among that are near to s."""
        p, q, n = self.least.numerator, self.least.denominator, self.sizes[among]
        among = among[np.minimum(n, len(s)) * q >= np.maximum(n, len(s)) * p]  # sizes this far apart can't be similar
        if not len(among):
            return among
        n, flat = self.sizes[among], np.concatenate([self.own[i] for i in among])
        hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
        return among[both * q >= (n + len(s) - both) * p]


def forest(own: list[np.ndarray], other: list[np.ndarray] | None, least: float) -> Iterator[tuple[int, int]]:
    """Indexes of a spanning forest of the links among own sets; or each own set's links to other ones, one for those near each other."""
    near = Near(own if other is None else other, least)
    left = np.arange(len(near.own))
    if other is not None:
        for i, s in enumerate(own):
            some = near.to(s, left)
            while len(some):
                yield i, int(some[0])
                some = np.setdiff1d(some[1:], near.to(near.own[some[0]], some[1:]))
        return
    while len(left) > 1:
        edge, left = [int(left[0])], left[1:]
        while edge and len(left):
            seed = edge.pop()
            found = near.to(own[seed], left)
            yield from ((seed, int(x)) for x in found)
            edge += found.tolist()
            left = np.setdiff1d(left, found)


def cell_links(least: float):
    """Streams rows (t, cell, part, block, bits, hashes) in that order to links (a, b) of bits; a run of equal (t, cell, part) is a unit."""

    def links(unit: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        zero, one = [u for u in unit if not u[0]], [u for u in unit if u[0]]
        if one or len(zero) > 1:
            right = one or zero
            for i, j in forest([u[2] for u in zero], [u[2] for u in one] if one else None, least):
                if zero[i][1] != right[j][1]:
                    yield zero[i][1], right[j][1]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, out = None, [], set()
        for batch in batches:
            for t, cell, part, block, bits, hashes in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (t, cell, part) != key:
                    out.update(links(unit))
                    key, unit = (t, cell, part), []
                    if len(out) > 20_000:
                        yield table(out)
                        out = set()
                unit.append((block, bits, np.frombuffer(hashes, dtype=np.uint64)))
        out.update(links(unit))
        yield table(out)

    def table(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return stream


def similar_links(docs: DataFrame, marked: DataFrame, width: int = 5, least: float = 0.8, cell_rows: int = 2048, cell_hashes: int = 2_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) of the fingerprints that join all of docs' texts of similarity least or more, directly or over others; and the tables in the shared folder that they are read from.

    marked: k1, k2 (row_key of doc_id and text), bits and sketch of each row of docs."""
    nodes = marked.filter("sketch.n > 0").groupBy("bits", F.col("sketch.set_key").alias("set_key")).agg(F.min_by(F.struct("k1", "k2", "sketch"), F.struct("k1", "k2")).alias("m"))
    rows = nodes.select("bits", "m.k1", "m.k2", "m.sketch.n", F.posexplode("m.sketch.bands").alias("t", "cell"))
    sizes = rows.groupBy("t", "cell").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"), F.min("bits").alias("lo"), F.max("bits").alias("hi"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    sizes = sizes.filter("lo <> hi")  # rows of one fingerprint are one node already
    # texts that are very near meet in many bands; cells of the same members (a key of 128 bits tells) have the same links, so one of them will do
    once = sizes.groupBy("rows", "hashes", "x1", "x2").agg(F.min(F.struct("t", "cell")).alias("c")).select("c.t", "c.cell", "rows", "hashes")
    met = shared_table(rows.join(once, ["t", "cell"]), compression="zstd")
    keyed = docs.select(*row_key("doc_id", "text"), "text").join(met.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    held = keyed.select("k1", "k2", sets(F.col("text"), width).alias("set"))  # stays where the keys are dealt: neither written nor exchanged again
    parts = F.greatest(F.ceil(F.col("rows") / cell_rows), F.ceil(F.col("hashes") / cell_hashes)).cast("int")
    cut = met.withColumn("p", parts).withColumn("i", F.pmod(F.xxhash64("k1", "k2"), F.col("p")).cast("int"))
    own = cut.select("t", "cell", "p", "i", "bits", "k1", "k2", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("j"))
    units = own.select("t", "cell", (F.least("i", "j") * F.col("p") + F.greatest("i", "j")).alias("part"), (F.col("i") > F.col("j")).cast("int").alias("block"), "bits", "k1", "k2")
    units = units.join(held, ["k1", "k2"]).select("t", "cell", "part", "block", "bits", "set")
    ordered = units.repartition(parallelism(docs.sparkSession), "t", "cell", "part").sortWithinPartitions("t", "cell", "part", "block", "bits")
    return ordered.mapInArrow(cell_links(least), "a long, b long"), [met]
