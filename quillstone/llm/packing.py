"""Packing as vector bin packing by the dot-product heuristic (operator 12).

An example is a vector: tokens, segments, loss-bearing tokens; a sequence has a limit for each. One sequence is filled at a time: of the examples in a pool of bounded size, the one
that fits and whose vector has the greatest dot product with what the sequence has left (both as shares of the limits) goes in, until none fits. So a sequence that has few
segments left takes long examples, and one with little loss left takes prompts. Each task packs what it reads, so nothing is shuffled; the pool is refilled after each sequence.

``pack_documents`` may cut: parts of a document that fill a sequence by themselves are sequences at once, its rest goes to the pool, and where more than ``max_padding`` tokens stay
free, an example of the pool is cut to fill them. A sequence that must end short (the last of a task, or one without segments left) is dealt to sequences whose lengths are powers of two,
which need no padding. ``pack_examples`` never cuts: an example beyond a limit has a sequence of its own, marked ``over``.

Edge cases: null and empty texts have their end id alone; null ids pass; repeated rows are packed one by one; texts of any length are cut whole; an empty table gives no rows; extra columns
stay out; null counts are 0, and an example of no tokens takes a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.token_store import encoder, ids_crc32

#: Examples that wait in a task, tokens that may stay free, and sequence ids that a task may give.
POOL, MAX_PADDING, PER_TASK = 2048, 2, 1 << 40
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids array<int>"


class Pool:
    """Examples that wait, as rows of an array of vectors; payloads beside them."""

    def __init__(self, limits: tuple[int, int, int], size: int = POOL):
        self.limits, self.size = np.array(limits, dtype=np.int64), size
        self.vectors, self.items, self.n = np.zeros((size + 1, 3), dtype=np.int64), [None] * (size + 1), 0

    def add(self, vector: tuple[int, int, int], item: object) -> None:
        self.vectors[self.n], self.items[self.n] = vector, item
        self.n += 1

    def take(self, i: int) -> tuple[np.ndarray, object]:
        """Takes out example i; the last one moves to its place."""
        vector, item = self.vectors[i].copy(), self.items[i]
        self.n -= 1
        self.vectors[i], self.items[i], self.items[self.n] = self.vectors[self.n], self.items[self.n], None
        return vector, item

    def best(self, left: np.ndarray) -> int:
        """The example that fits best into what is left; -1 if none fits."""
        waiting = self.vectors[: self.n]
        score = np.where((waiting <= left).all(1), waiting @ (left / (self.limits * self.limits.astype(float))), -1.0)
        i = int(score.argmax()) if self.n else -1
        return i if i >= 0 and score[i] >= 0 else -1

    def fill(self) -> tuple[list[tuple[np.ndarray, object]], np.ndarray]:
        """The examples of one sequence, and what it has left."""
        left, out = self.limits.copy(), []
        while (left[0] > 0 or not out) and (i := self.best(left)) >= 0:
            out.append(self.take(i))
            left -= out[-1][0]
        return out, left


Part = tuple[object, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


def loss_of(start: int, n: int) -> int:
    """A document's ids all bear loss but its first, which nothing precedes."""
    return n - (start == 0)


class DocumentPacker:
    """Takes documents one by one and gives whole sequences of parts."""

    def __init__(self, tokens: int, segments: int, loss: int, max_padding: int = MAX_PADDING, pool: int = POOL):
        if min(tokens, segments) < 1 or loss < 1:
            raise ValueError("limits of one token, segment and loss-bearing token at least")
        self.pool, self.tokens, self.max_padding = Pool((tokens, segments, loss), pool), tokens, max_padding
        self.whole = min(tokens, loss)  # the longest part within the limits, wherever it starts

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[list[Part]]:
        at = 0
        while len(ids) - at >= self.whole:
            yield from self.closed([(doc_id, at, len(ids), ids[at : at + self.whole])])
            at += self.whole
        if at < len(ids):
            self.wait((doc_id, at, len(ids), ids[at:].copy()))
        while self.pool.n >= self.pool.size:
            yield from self.next()

    def wait(self, part: Part) -> None:
        self.pool.add((len(part[3]), 1, loss_of(part[1], len(part[3]))), part)

    def next(self) -> Iterator[list[Part]]:
        found, left = self.pool.fill()
        parts = [p for _, p in found]
        while left[0] > self.max_padding and left[1] and left[2] and self.pool.n:  # cut the longest that waits
            _, (doc_id, start, n, ids) = self.pool.take(int(self.pool.vectors[: self.pool.n, 0].argmax()))
            size = int(min(left[0], left[2]))
            if size < len(ids):
                self.wait((doc_id, start + size, n, ids[size:]))
            parts.append((doc_id, start, n, ids[:size]))
            left -= (len(parts[-1][3]), 1, loss_of(start, len(parts[-1][3])))
        yield from self.closed(parts)

    def closed(self, parts: list[Part]) -> Iterator[list[Part]]:
        """One sequence if it is nearly full or of a power of two, else several of powers of two."""
        size = sum(len(p[3]) for p in parts)
        if size + self.max_padding >= self.tokens:
            yield parts
            return
        for length in (1 << b for b in reversed(range(size.bit_length())) if size >> b & 1):
            out = []
            while length:
                doc_id, start, n, ids = parts.pop(0)
                out.append((doc_id, start, n, ids[:length]))
                if len(ids) > length:
                    parts.insert(0, (doc_id, start + length, n, ids[length:]))
                length -= len(out[-1][3])
            yield out

    def rest(self) -> Iterator[list[Part]]:
        while self.pool.n:
            yield from self.next()


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, tokens: int = 1024, segments: int = 128, loss: int | None = None, max_padding: int = MAX_PADDING) -> DataFrame:
    """A row for each piece of docs (doc_id, text): its place in its document and its sequence, and its token ids. Sequences hold at most so many tokens, segments and
    loss-bearing tokens (no limit of their own: None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc, end, sequence, held, size = DocumentPacker(tokens, segments, loss or tokens, max_padding), encoder(vocabulary), np.array([end_id], dtype=np.uint32), TaskContext.get().partitionId() * PER_TASK, [], 0

        def sequences() -> Iterator[list[Part]]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    yield from packer.add(doc_id.as_py(), np.concatenate([enc.encode(text.as_py()), end]))
            yield from packer.rest()

        for parts in sequences():
            offset = 0
            for doc_id, start, n, ids in parts:
                held.append((doc_id, start, n, ids, sequence, offset))
                offset += len(ids)
            sequence, size = sequence + 1, size + offset
            if size >= 1 << 20:
                yield table(held)
                held, size = [], 0
        if held:
            yield table(held)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(r[3]) for r in rows], dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(np.concatenate([r[3] for r in rows]).view(np.int32)))
        column = lambda i: pa.array([r[i] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([column(0), column(1), pa.array(lengths), column(2), column(4), column(5), lists], names=[c.split()[0] for c in PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def packed_digests(docs: DataFrame, vocabulary: str, **options: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack_documents(docs, vocabulary, **options).select("doc_id", "start", "length", ids_crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_examples(examples: DataFrame, tokens: int, segments: int, loss: int) -> DataFrame:
    """example_id, n_tokens, n_segments, n_loss, sequence_id, offset, over: whole examples under all three limits. Columns as named, but for the last three."""
    names, schema = ["n_tokens", "n_segments", "n_loss"], f"example_id {examples.schema['example_id'].dataType.simpleString()}, n_tokens long, n_segments long, n_loss long, sequence_id long, offset long, over boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, sequence, limits = Pool((tokens, segments, loss)), TaskContext.get().partitionId() * PER_TASK, (tokens, segments, loss)

        def sequences() -> Iterator[tuple[list, bool]]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("example_id").type
                for row in zip(batch.column("example_id"), *(batch.column(c).to_pylist() for c in names)):
                    if any(v > limit for v, limit in zip(row[1:], limits)):
                        yield [(row[1:], row[0])], True
                        continue
                    pool.add(row[1:], row[0])
                    if pool.n >= pool.size:
                        yield pool.fill()[0], False
            while pool.n:
                yield pool.fill()[0], False

        rows, kind = [], None
        for found, over in sequences():
            offset = 0
            for vector, example in found:
                rows.append((example.as_py(), *map(int, vector), sequence, offset, over))
                offset += int(vector[0])
            sequence += 1
            if len(rows) >= 10_000:
                yield table(rows, kind)
                rows = []
        if rows:
            yield table(rows, kind)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, *[pa.int64()] * 5, pa.bool_()))], names=[c.split()[0] for c in schema.split(", ")])

    counts = [F.coalesce(F.col(c).cast("long"), F.lit(1 if c == "n_segments" else 0)).alias(c) for c in names]
    return examples.select("example_id", *counts).mapInArrow(run, schema)


def token_counts(text: Column, vocabulary: str) -> Column:
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len(encoder(vocabulary).encode(t.as_py())) for t in texts], pa.int64())

    return run(text)


def conversation_examples(turns: DataFrame, vocabulary: str) -> DataFrame:
    """example_id (conv_id), n_tokens, n_segments (turns), n_loss (tokens of assistants' turns) of instruction data (conv_id, role, text); a turn ends with an id of its own."""
    n = F.col("n")
    counted = turns.select(F.col("conv_id").alias("example_id"), "role", (token_counts(F.col("text"), vocabulary) + 1).alias("n"))
    return counted.groupBy("example_id").agg(F.sum(n).alias("n_tokens"), F.count("*").alias("n_segments"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("n_loss"))
