"""Line deduplication (operator 3): range-partitioned line hashes, streamed in order of document and position.

Every line's key (stripped, ASCII letters lower-cased) is hashed to 128 bits. The hashes are range-partitioned by hash, then
document, and sorted by hash, document (doc_id, null first, then a hash of doc_id and text), position. A task streams its sorted rows: a key's rows wait until ``min_docs`` documents have
been seen or the key ends, so at most the rows of ``min_docs`` documents are held. A key with very many lines is cut by the
ranges; the first and last key of each task may go on in another, so their rows wait for the sums over tasks of those keys,
of which there are two for each task at most. What comes out is a compressed bitmap of kept lines
for each document that loses any; texts meet it again only where it is applied.

Edge cases: null and empty texts are one empty line, which never counts as repeated; documents that are equal in doc_id and text count
one by one and share a bitmap, so where one of them holds a key's first line, all of them keep it; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import ASCII_LOWER, BLANKS, discard, parallelism, row_key, shared_table

STRIP = BLANKS.encode()
PLACE = ["doc_id", "k1", "k2", "pos"]
LINE = ["h1", "h2", *PLACE]
SEEN_NAMES = [*LINE, "n", "state"]
APPLIED = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
DIGEST = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, k1, k2, text) to a row for each line with a key; opens: the key's first line in its document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            hashes, doc, pos, opens = [], [], [], []
            for d, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                seen: set[bytes] = set()
                for p, line in enumerate((text or b"").split(b"\n")):
                    if key := line.strip(STRIP):
                        h = xxhash.xxh3_128_digest(key.translate(ASCII_LOWER))
                        hashes.append(h)
                        doc.append(d)
                        pos.append(p)
                        opens.append(h not in seen)
                        seen.add(h)
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            rows = np.array(doc, dtype=np.int64)
            keys = [part.column(k).take(pa.array(rows)) for k in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), *keys, pa.array(pos, pa.int32()), pa.array(opens, pa.bool_())], names=[*LINE, "opens"])


def stream_runs(min_docs: int, keep_first: bool):
    """Streams sorted line rows. Gives rows to drop (state 0), rows that wait for other tasks (1) and, for the task's first and last key, a
    row with its documents and its first line (2). With keep_first a key's first line (of all rows that share its document key) is not among the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = head = None
        docs, held = 0, []

        def rows(parts: list, state: int) -> Iterator[pa.RecordBatch]:
            for p in parts:
                if n := p.num_rows:
                    yield pa.RecordBatch.from_arrays([*p.columns[:6], pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, state, np.int32))], names=SEEN_NAMES)

        def summary() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head.columns[:6], pa.array([docs], pa.int64()), pa.array([2], pa.int32())], names=SEEN_NAMES)

        def close(last: bool = False) -> Iterator[pa.RecordBatch]:
            if key is not None and (last or key == first):
                yield from rows(held, 1)
                yield summary()

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, k1, k2, pos, opens = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "k1", "k2", "pos", "opens"))
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            sums, ends = np.add.reduceat(opens.astype(np.int64), starts), np.r_[starts[1:], batch.num_rows]
            for i in dict.fromkeys((0, len(starts) - 1)):
                a, n = int(starts[i]), int(ends[i] - starts[i])
                part = batch.slice(a, n)
                if (h1[a], h2[a]) != key:
                    yield from close()
                    key, head, docs, held = (h1[a], h2[a]), batch.slice(a, 1), 0, []
                    first = first or key
                if keep_first:
                    p1, p2, at = (head.column(c)[0].as_py() for c in ("k1", "k2", "pos"))
                    part = part.filter(pa.array((k1[a : a + n] != p1) | (k2[a : a + n] != p2) | (pos[a : a + n] != at)))
                docs += int(sums[i])
                held.append(part)
                if docs >= min_docs:
                    yield from rows(held, 0)
                    held = []
                if i == 0 and len(starts) > 2:  # whole keys inside the batch
                    often = sums >= min_docs
                    often[[0, -1]] = False
                    mask = np.repeat(often, ends - starts)
                    if keep_first:
                        to = np.repeat(starts, ends - starts)
                        mask &= (k1 != k1[to]) | (k2 != k2[to]) | (pos != pos[to])
                    if mask.any():
                        yield from rows([batch.filter(pa.array(mask))], 0)
        yield from close(last=True)

    return run


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool = False, partitions: int | None = None) -> DataFrame:
    """A row (k1, k2, pos) for every line to drop, as a table of the shared folder. docs: doc_id, k1, k2, text. keep_first: the first line of each key, by document and position, stays."""
    spark = docs.sparkSession
    line = f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, pos int"
    lines = shared_table(docs.select("doc_id", "k1", "k2", "text").mapInArrow(line_rows, f"{line}, opens boolean"))  # ranges are sampled from this, not from the texts
    ranged = lines.repartitionByRange(partitions or parallelism(spark), *LINE[:5]).sortWithinPartitions(*LINE)
    seen = shared_table(ranged.mapInArrow(stream_runs(min_docs, keep_first), f"{line}, n long, state int"))
    discard(lines)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), *PLACE)
    edges = seen.filter("state = 2").withColumn("place", place)
    often = F.broadcast(edges.groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min("place").alias("least")).filter(F.col("docs") >= min_docs))  # two keys a task
    found = seen.filter("state = 0").select("k1", "k2", "pos").unionByName(seen.filter("state = 1").join(often, ["h1", "h2"]).select("k1", "k2", "pos"))
    if keep_first:  # a key that several tasks share has a first line in each; only the very first stays
        found = found.unionByName(edges.join(often, ["h1", "h2"]).filter("place <> least").select("k1", "k2", "pos"))
    out = shared_table(found)
    discard(seen)
    return out


@F.arrow_udf(T.BinaryType())
def bitmap(positions: pa.Array) -> pa.Array:
    """Line numbers to drop, to a compressed bitmap (bit set: the line stays); lines past its end stay."""
    out = []
    for p in positions.to_pylist():
        bits = np.ones((max(p) + 8) // 8 * 8, dtype=np.uint8)
        bits[p] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes()))
    return pa.array(out, pa.binary())


def kept_lines(text: str | None, bits: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if bits is None:
        return text or "", len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8))[: len(lines)].astype(bool)
    keep = np.r_[keep, np.ones(len(lines) - len(keep), dtype=bool)]
    kept = [x for x, k in zip(lines, keep) if k]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def keep_bitmaps(docs: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """k1, k2, keep (compressed bitmap) of each document that loses lines: all that is left in the shared folder."""
    found = dropped_lines(docs, min_docs, keep_first)
    out = shared_table(found.groupBy("k1", "k2").agg(F.collect_set("pos").alias("p")).select("k1", "k2", bitmap("p").alias("keep")))
    discard(found)
    return out


def _with_bitmaps(docs: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    keyed = docs.select("*", *row_key("doc_id", "text"))
    return keyed.join(keep_bitmaps(keyed, min_docs, keep_first), ["k1", "k2"], "left")


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with repeated lines gone from text, and n_chars of the new text. A null text becomes the empty text."""

    @F.arrow_udf(T.StringType())
    def apply(text: pa.Array, keep: pa.Array) -> pa.Array:
        return pa.array([kept_lines(t.as_py(), k.as_py())[0] for t, k in zip(text, keep)], pa.string())

    held = docs.select("doc_id", "text", F.struct("*").alias("row"))
    text = apply("text", "keep")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return _with_bitmaps(held, min_docs, keep_first).select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def line_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    @F.arrow_udf(DIGEST)
    def digest(text: pa.Array, keep: pa.Array) -> pa.Array:
        rows = [(n, d, hashlib.sha256(k.encode()).hexdigest()) for k, n, d in (kept_lines(t.as_py(), b.as_py()) for t, b in zip(text, keep))]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], DIGEST.names)

    return _with_bitmaps(docs.select("doc_id", "text"), min_docs, False).select("doc_id", digest("text", "keep").alias("d")).select("doc_id", "d.*")


ORACLE = """
WITH l AS (SELECT rowid_, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rowid_) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY rowid_, doc_id
"""
