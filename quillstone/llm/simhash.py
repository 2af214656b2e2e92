"""SimHash near-duplicates by a grid over segment popcounts (operator 8).

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments: a point of a grid with 32 axes. The Manhattan distance of two points is a lower
bound of the Hamming distance of their fingerprints. Points are written in unary (0, 1, 11 a segment), so the Manhattan distance is the number of
bits in which two points differ.

The range join on the grid: the axes are dealt to ``max_bits // 2 + 1`` parts. Of two points within ``max_bits``, at least one part's distance is 1 or 0, so on
that part they share a cell or lie in neighbouring ones. A fingerprint lives in its own cell of each part, and visits the cells one step up on each axis (26 rows on average
with two parts, whatever the number of fingerprints). In a cell, those who live there meet each other and the visitors: pairs within ``max_bits`` by
Manhattan distance are candidates, and their Hamming distance decides. A spanning
forest of the links comes out (at most a link a row), never all pairs. Cells of over ``cell_rows`` rows are cut into parts, and each pair of
parts is a task of its own. Components are found by contracting stars, checkpointed to the shared folder.

Edge cases: null, empty and blank texts have fingerprint zero and link like any others; equal fingerprints are one node,
however many rows share it; null doc_ids don't count for a component's least id; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm import jaccard
from quillstone.llm.common import ASCII_LOWER, discard, parallelism, row_key, shared_table

LOW = int("01" * 32, 2)  # the lower bit of each segment
LINKS = "a long, b long"


def fingerprint(text: bytes | None, width: int) -> int:
    """64 bits; bit i is set if it is in over half the shingles' hashes."""
    words = (text or b"").translate(ASCII_LOWER).split()  # bytes.split() splits at [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, n, h = np.zeros(64, dtype=np.int64), len(words) - width + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 50_000):
        part = words[at : at + 50_000 + width - 1]
        if width == 3:
            hashes = [h(b"%b %b %b" % x, 42) for x in zip(part, part[1:], part[2:])]
        else:
            hashes = [h(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(width)))]
        bits = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, width: int = 3) -> Column:
    """Signed 64-bit fingerprints of texts."""

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts.cast(pa.binary())], dtype=np.uint64).view(np.int64))

    return run(text)


def points(bits: Column) -> Column:
    """The bit counts of the 32 two-bit segments in unary."""
    low, high = bits.bitwiseOR(F.shiftrightunsigned(bits, 1)), bits.bitwiseAND(F.shiftrightunsigned(bits, 1))
    return low.bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(LOW)), 1))


def points_of(bits: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW), np.uint64(1)
    return (bits | bits >> one) & low | (bits & bits >> one & low) << one


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def cells(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(t, cell, visits, bits): nodes (distinct bits) in the cells of each part t of the axes: their own, and as visitors those one step up on an axis."""
    parts, out = max_bits // 2 + 1, []
    for t in range(parts):
        axes = [a for a in range(32) if a * parts // 32 == t]
        own = F.col("point").bitwiseAND(_signed(sum(3 << 2 * a for a in axes)))
        out.append(F.struct(F.lit(t).alias("t"), own.alias("cell"), F.lit(0).alias("visits")))
        for a in axes if max_bits else ():
            count = own.bitwiseAND(_signed(3 << 2 * a))
            up = F.when(count == 0, own.bitwiseOR(_signed(1 << 2 * a))).when(count == _signed(1 << 2 * a), own.bitwiseOR(_signed(2 << 2 * a)))
            out.append(F.when(up.isNotNull(), F.struct(F.lit(t).alias("t"), up.alias("cell"), F.lit(1).alias("visits"))))
    dealt = nodes.select("bits", points(F.col("bits")).alias("point")).select("bits", F.explode(F.array_compact(F.array(*out))).alias("c"))
    return dealt.select("c.*", "bits")


def near(some: np.ndarray, one: int, max_bits: int) -> np.ndarray:
    """Which of some are near: by Manhattan distance first, then exactly."""
    close = np.bitwise_count(points_of(some) ^ points_of(np.array([one], dtype=np.uint64))) <= max_bits
    close[close] = np.bitwise_count(some[close] ^ np.uint64(one)) <= max_bits
    return close


def forest(own: np.ndarray, other: np.ndarray | None, max_bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among own fingerprints, or between own and other ones."""
    if other is None:
        left = own
        while len(left) > 1:
            edge, left = left[:1], left[1:]
            while len(edge) and len(left):
                seed, edge = edge[0], edge[1:]
                close = near(left, seed, max_bits)
                yield from ((int(seed), int(x)) for x in left[close])
                edge, left = np.r_[edge, left[close]], left[~close]
        return
    for x in own:  # one link to those near each other is enough, as others link them
        found = other[near(other, x, max_bits)]
        while len(found):
            yield int(x), int(found[0])
            found = found[~near(found, found[0], max_bits)]


def cell_links(max_bits: int):
    """Streams rows (t, cell, part, block, bits) in that order; a run of equal (t, cell, part) is a task's unit. Block 1 rows are compared with block 0
    rows, and unless part is negative those are compared with each other."""

    def links(part: int, bits: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(bits) == 2:  # most units by far
            a, b = (int(x) for x in bits)
            if not block[0] and (a ^ b).bit_count() <= max_bits:  # no more than the Manhattan test would let through
                yield a, b
            return
        lives, visits = bits[block == 0], bits[block == 1]
        if part >= 0:
            yield from forest(lives, None, max_bits)
        if len(visits) and len(lives):
            yield from forest(visits, lives, max_bits)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("t", "cell", "part", "block", "bits")]
            now = now if carry is None else [np.r_[x, y] for x, y in zip(carry, now)]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in now[:3]])
            starts = np.flatnonzero(np.r_[True, ~same])
            carry = [c[starts[-1] :] for c in now]
            yield from units(now, starts[:-1], starts[1:])
        if carry is not None:
            yield from units(carry, np.array([0]), np.array([len(carry[0])]))

    def units(rows: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = np.flatnonzero(ends - starts > 1)
        part, block, bits, out = rows[2], rows[3], rows[4].view(np.uint64), []
        for a, b in zip(starts[many].tolist(), ends[many].tolist()):
            out.extend(links(int(part[a]), bits[a:b], block[a:b]))
            if len(out) > 20_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        ab = np.array(pairs, dtype=np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, i])) for i in (0, 1)], names=["a", "b"])

    return stream


def near_links(nodes: DataFrame, max_bits: int, cell_rows: int = 4096) -> DataFrame:
    """Links (a, b) that join all of nodes (distinct bits) which are within max_bits of each other, directly or over others within max_bits."""
    rows = cells(nodes, max_bits)
    sizes = rows.groupBy("t", "cell").agg(F.count("*").alias("n"), F.min("visits").alias("visits")).filter("n > 1 AND visits = 0").drop("visits")  # someone lives there
    few = rows.join(sizes.filter(F.col("n") <= cell_rows).select("t", "cell"), ["t", "cell"], "left_semi").select("t", "cell", F.lit(0).alias("part"), F.col("visits").alias("block"), "bits")
    # a large cell is cut into p parts by a hash: part i of those who live there meets itself, parts j > i, and all parts of the visitors, each pair in a task of its own
    p = F.ceil(F.col("n") / (cell_rows / 2)).cast("int")
    cut = rows.join(sizes.filter(F.col("n") > cell_rows), ["t", "cell"]).withColumn("p", p).withColumn("i", F.pmod(F.xxhash64("bits"), F.col("p")).cast("int"))
    each = cut.select("t", "cell", "visits", "p", "i", "bits", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("j"))
    low, high, p = F.least("i", "j"), F.greatest("i", "j"), F.col("p")
    own = each.filter("visits = 0").select("t", "cell", F.when(low == high, low).otherwise(-1 - low * p - high).alias("part"), (F.col("i") > F.col("j")).cast("int").alias("block"), "bits")
    first, second = F.when(F.col("visits") == 0, F.col("i")).otherwise(F.col("j")), F.when(F.col("visits") == 0, F.col("j")).otherwise(F.col("i"))
    met = each.select("t", "cell", (-1 - p * p - first * p - second).alias("part"), F.col("visits").alias("block"), "bits")
    order = ["t", "cell", "part", "block", "bits"]
    units = few.unionByName(own).unionByName(met)
    return units.repartition(parallelism(nodes.sparkSession), "t", "cell", "part").sortWithinPartitions(*order).mapInArrow(cell_links(max_bits), LINKS)


def components(links: DataFrame) -> DataFrame:
    """bits, root of every node with a link, by alternating large and small stars; each round is written to the shared folder, and the one before is removed."""
    spark, edges = links.sparkSession, shared_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = shared_table(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        done, edges = edges, shared_table(small)
        discard(done, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("a").alias("bits"), F.col("b").alias("root"))
            out.shared_path = edges.shared_path
            return out
        before = now


def _labelled(docs: DataFrame, width: int, max_bits: int, similar_width: int | None = None, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, bits) of docs, (bits, least doc_id, head row) of the distinct fingerprints, and (bits, root) of those with links, all in the shared folder. With
    similar_width, texts with that similarity on shingles of so many words are linked as well."""
    sketch = [] if similar_width is None else [jaccard.sketches(F.col("text"), similar_width).alias("sketch")]
    marked = shared_table(docs.select("doc_id", *row_key("doc_id", "text"), fingerprints(F.col("text"), width).alias("bits"), *sketch))
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = shared_table(marked.groupBy("bits").agg(F.min("doc_id").alias("least"), F.min(head).alias("head")))
    links, met = near_links(nodes.select("bits"), max_bits), []
    if similar_width is not None:
        similar, met = jaccard.similar_links(docs, marked, similar_width, similarity)
        links = links.unionByName(similar)
    found = components(links)
    discard(*met)
    return marked, nodes, found


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with their root; those without links are their own."""
    return nodes.join(found, "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def simhash_components(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component) of every document."""
    marked, nodes, found = _labelled(docs, width, max_bits)
    nodes = _rooted(nodes, found)
    lowest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("bits", "root").join(lowest, "root").select("bits", "component_id")
    return marked.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, similar_width: int | None = None, similarity: float = 0.8) -> DataFrame:
    """One document of each component: the least doc_id (null last; among equal ids one text), once if rows are equal in doc_id and text."""
    marked, nodes, found = _labelled(docs, width, max_bits, similar_width, similarity)
    heads = shared_table(_rooted(nodes, found).groupBy("root").agg(F.min("head").alias("h")).select(F.col("h.k1").alias("k1__"), F.col("h.k2").alias("k2__")))
    discard(marked, nodes, found)  # the heads' keys are all that is left in the shared folder
    keyed = docs.select("*", *(k.alias(f"{n}__") for k, n in zip(row_key("doc_id", "text"), ("k1", "k2"))))
    kept = keyed.join(heads, ["k1__", "k2__"], "left_semi")
    return kept.withColumn("nth__", F.row_number().over(Window.partitionBy("k1__", "k2__").orderBy("k1__"))).filter("nth__ = 1").select(*docs.columns)
