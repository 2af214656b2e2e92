"""Benchmark decontamination (operator 5): one Aho-Corasick automaton over the windows of the test questions and answers.

Texts are normalised to words joined by single spaces; all windows (``width`` consecutive words of an item, or a whole shorter item)
go into one automaton, and each text runs through it once. Hits are found as places in the normalised text, turned into word
numbers, and mapped to places in the original.

The automaton's size is measured first: items are read a partition at a time and dealt, in order, into blocks of about ``block_chars`` characters of windows. Benchmarks
of one block (the usual case) are done in one scan. Larger ones take a scan a block: the driver holds and broadcasts one block at a time, the
documents that it hits go to the shared folder, and the hits of all blocks are joined by document.

Edge cases: null and empty texts have no words and are clean; items without words have no windows; repeated items count once by
item_id (null: the text "null"); rows equal in doc_id and text get equal results; other columns stay, whatever their names (a column named hits is replaced); empty tables give no rows or clean rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import row_key, shared_table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: ASCII letters to lower case, digits and all non-ASCII bytes stay, the rest separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.BinaryType()), T.StructField("item_ids", T.ArrayType(T.StringType()))])
DIGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
_built: dict[str, tuple] = {}


def normal(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    return [b" %b " % b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def blocks(items: Iterable[tuple[str, str]], width: int, block_chars: int) -> Iterator[dict[bytes, tuple[int, dict[str, None]]]]:
    """Windows (with their number of words and their items) in blocks of bounded size."""
    out, size = {}, 0
    for item, text in items:
        words = normal(text.encode())
        for w in windows(words, width):
            size += len(w)
            out.setdefault(w, (min(width, len(words)), {}))[1][item] = None
            if size > block_chars:  # within an item as well, as its windows don't need each other
                yield out
                out, size = {}, 0
    if out:
        yield out


def name_of(block: bytes) -> str:
    return hashlib.sha256(block).hexdigest()


def automaton(block: bytes, name: str) -> tuple[ahocorasick.Automaton, list]:
    """Built once a worker for each block; name is the block's name_of(), taken once and not with every text."""
    if name not in _built:
        _built.clear()
        found, values = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for w, value in pickle.loads(block).items():
            found.add_word(w.decode("latin-1"), len(values))
            values.append(value)
        found.make_automaton()
        _built[name] = found, values
    return _built[name]


def scan(text: bytes | None, block: bytes, name: str = "") -> tuple[int, np.ndarray | None, set[str]]:
    """The number of words, a mask of hit words (None: none) and the items."""
    found, values = automaton(block, name or name_of(block))
    words = normal(text)
    if not words or not values:
        return len(words), None, set()
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = list(found.iter(line))
    if not hits:
        return len(words), None, set()
    # the space that ends word k is place ends[k]; a hit ends at such a space
    ends = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(ends, [e for e, _ in hits])
    edge, items = np.zeros(len(words) + 1, dtype=np.int64), set()
    spans = np.array([values[v][0] for _, v in hits])
    np.add.at(edge, last + 1 - spans, 1)
    np.add.at(edge, last + 1, -1)
    for v in {v for _, v in hits}:
        items.update(values[v][1])
    return len(words), np.cumsum(edge[:-1]) > 0, items


def hit_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as places (code points, end exclusive) in the original text."""
    out, before = [], False
    for m, hit in zip(WORD.finditer(text.encode().translate(ASCII_KEEP).decode()), mask):
        if hit:
            out[-1:] = [(out[-1][0], m.end())] if before else [*out[-1:], m.span()]
        before = bool(hit)
    return out


ASCII_KEEP = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _blocks(benchmark: DataFrame, width: int, block_chars: int) -> Iterator[bytes]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").filter("text IS NOT NULL").toLocalIterator()  # a partition at a time
    return (pickle.dumps(b) for b in blocks(((r.i, r.text) for r in rows), width, block_chars))


def _scanned(text: Column, block: Broadcast) -> Column:
    name = name_of(block.value)

    @F.arrow_udf(HITS)
    def run(texts: pa.Array) -> pa.Array:
        rows = [scan(t.as_py(), block.value, name) for t in texts.cast(pa.binary())]
        masks = [None if m is None else np.packbits(m).tobytes() for _, m, _ in rows]
        return pa.StructArray.from_arrays([pa.array([n for n, _, _ in rows], pa.int64()), pa.array(masks, pa.binary()), pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string()))], HITS.names)

    return run(text)


@F.arrow_udf(HITS)
def _joined(n: pa.Array, masks: pa.Array, items: pa.Array) -> pa.Array:
    joined = []
    for ms in masks.to_pylist():
        ms = [np.frombuffer(m, dtype=np.uint8) for m in ms or []]
        joined.append(np.bitwise_or.reduce(ms).tobytes() if ms else None)
    return pa.StructArray.from_arrays([n, pa.array(joined, pa.binary()), pa.array([sorted({x for y in i or [] for x in y}) for i in items.to_pylist()], pa.list_(pa.string()))], HITS.names)


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 2_000_000) -> DataFrame:
    """docs with a struct hits: n_words, hit_words (bits by word; null: none), item_ids. A column named hits is replaced."""
    sc, found = docs.sparkSession.sparkContext, _blocks(benchmark, width, block_chars)
    first, second = next(found, pickle.dumps({})), next(found, None)
    if second is None:
        return docs.withColumn("hits", _scanned(F.col("text"), sc.broadcast(first)))
    keyed, parts = docs.select(F.struct("*").alias("row"), "text", *row_key("doc_id", "text")), []
    for plain in chain([first, second], found):
        block = sc.broadcast(plain)
        hit = keyed.select("k1", "k2", _scanned(F.col("text"), block).alias("h")).filter("h.hit_words IS NOT NULL")
        parts.append(shared_table(hit.dropDuplicates(["k1", "k2"])))
        block.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.collect_list("h.hit_words").alias("m"), F.collect_list("h.item_ids").alias("i"))  # a row a block at most
    nothing = sc.broadcast(pickle.dumps({}))  # counts the words of the others
    own = _scanned(F.col("text"), nothing)["n_words"]
    out = keyed.join(hits, ["k1", "k2"], "left").withColumn("hits", _joined(own, "m", "i"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "hits"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The documents without any hit, with their own columns."""
    held = docs.select(F.struct("*").alias("own"), "doc_id", "text")
    return with_hits(held, benchmark, **options).filter("hits.hit_words IS NULL").select("own.*")


@F.arrow_udf(T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("hits", T.StringType())]))
def _placed(texts: pa.Array, masks: pa.Array, n_words: pa.Array) -> pa.Array:
    """How many words are hit, and where their runs stand in the original (start:end in code points, comma-joined)."""
    counts, places = [], []
    for text, mask, n in zip(texts, masks.to_pylist(), n_words.to_pylist()):
        counts.append(0 if mask is None else int.from_bytes(mask, "big").bit_count())
        hit = () if mask is None else np.unpackbits(np.frombuffer(mask, dtype=np.uint8))[:n]
        places.append(",".join(f"{a}:{b}" for a, b in hit_spans(text.as_py(), hit)) if len(hit) else "")
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(places, pa.string())], ["n_hit", "hits"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (runs of hit words in the original text, start:end in code points) of every document."""
    h = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    h = h.select("doc_id", "hits.*", _placed(F.when(F.col("hits.hit_words").isNotNull(), F.col("text")), "hits.hit_words", "hits.n_words").alias("p"))  # clean texts stay in the JVM
    return h.select("doc_id", "n_words", "p.n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("p.n_hit") > 0).alias("contaminated"), "p.hits")
