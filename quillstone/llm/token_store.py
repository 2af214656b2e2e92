"""Token ids in Parquet list columns (operator 6).

Documents are range-partitioned and sorted by doc_id, encoded in that order, and written as Parquet with a list column of ids, one row a document.
Ids are dictionary-encoded and bit-packed (delta encoding takes over where a dictionary grows too large: format version 2), row groups and pages have set
sizes, and pages carry an index, so readers of some documents or of the metadata alone skip the rest. A file's rows count
their ids from 0 (``at``); a table of one row a file has the ids before it, so no prefix sum runs over all documents in one task.

Edge cases: null and empty texts have the end id alone; null ids come first; rows of one doc_id are in
order of a hash of the text, so that an id with very many rows is cut into several files; an empty table has no rows; extra columns stay out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm.bpe import byte_symbols, slices
from quillstone.llm.common import parallelism, shared_dir

STORE = "file int, doc_id long, at long, n_tokens long, token_ids array<int>"
#: Row groups of 16 MB, pages of 64 kB and at most 512 rows, format version 2.
LAYOUT = {"parquet.block.size": 16 << 20, "parquet.page.size": 64 << 10, "parquet.page.row.count.limit": 512, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "compression": "zstd"}
#: The split pattern of byte-level vocabularies: fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of a byte-level vocabulary as the tokenizers library gives them. The same merges run in tiktoken, which takes half the time; where it
    gives up (runs of millions of blanks), and for vocabularies whose ids don't follow the order of their merges, the library itself encodes."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        tokens = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        made = [vocab[a + b] for a, b in spec["model"]["merges"]]
        self.library = Tokenizer.from_file(path)
        self.fast = Encoding(path, pat_str=WORDS, mergeable_ranks=tokens, special_tokens=special) if made == sorted({*made}) else None
        #: Bytes of text that a token stands for.
        self.size_of = np.zeros(max([*vocab.values(), *special.values()]) + 1, dtype=np.int64)
        for token, i in [*tokens.items(), *((t.encode(), i) for t, i in special.items())]:
            self.size_of[i] = len(token)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, 32 bits each."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text or "", allowed_special="all")
            except ValueError:
                pass
        return np.array(self.library.encode(text or "", add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int, files: int | None = None) -> None:
    """Writes the ids of docs (doc_id, text), in order of doc_id, to path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, enc, end = 0, TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            row = 0
            for texts in slices(batch.column("text")):
                ids = [x for t in texts for x in (enc.encode(t), end)]
                ends = np.cumsum([0, *(len(x) + 1 for x in ids[::2])])
                ids = np.concatenate(ids)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), file, np.int32)), batch.column("doc_id").slice(row, len(texts)), pa.array(at + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), lists], names=["file", "doc_id", "at", "n_tokens", "token_ids"])
                at, row = at + int(ends[-1]), row + len(texts)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash parts rows of one doc_id
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files or parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows.mapInArrow(run, STORE).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, token_ids; columns that aren't used aren't read."""
    rows = spark.read.schema(STORE).parquet(path)
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = per_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "token_ids")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of docs to the shared folder and gives doc_id, start, n_tokens, ids_crc32 from the files."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, vocabulary, path, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", ids_crc32("token_ids").alias("ids_crc32"))
