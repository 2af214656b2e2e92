"""Byte-pair encoding and decoding on contiguous rank arrays (operator 2).

A word is a row of parts, at first its bytes. ``ids`` holds the parts' tokens between their boundaries, ``ranks[i]`` the merge rank of parts i and i+1. The least
rank (leftmost on ties) is looked for again and again; its boundary is deleted, which closes both rows up, and the ranks on both sides are looked up anew.
The short words that a slice of documents brings and the cache lacks are worked on together, as rows of one array, each row with its own least rank.
Words of over ``SHORT`` symbols take a heap with the same order of merges instead, as scanning would cost the square of the length.
Decoding starts from the ids alone: a vectorised look-up of the tokens' strings, joined by document.

Edge cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole; the
vocabulary's special strings in a text become their ids; ids that the vocabulary lacks raise ValueError when decoded. Rows pass through one by one,
so repeated rows, clashing extra columns and empty tables need no care. Documents are worked on in slices of ``SLICE`` characters (at least one document), so a
worker holds little beside its input, and its cache is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 48
#: Words in a worker's cache: this many in use, and as many of the generation before.
CACHE_WORDS = 200_000
#: Documents are gathered up to so many characters and then encoded, decoded and handed on together.
SLICE = 1 << 21
NONE = np.int32(2**31 - 1)
#: The vocabulary's split pattern: fixed value.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters from here on are classed by the vocabulary's own library, whose Unicode tables may be newer or older than Python's.
OWN_TABLES = regex.compile(r"[԰-\U0010FFFF\x1c-\x1f]")
BREAKS = re.compile("[^\\S\x1c-\x1f]+")
IDS = T.StructType([T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Cache:
    """A bounded cache of encoded words. A full one becomes the generation before, from which words that come again are taken back."""

    def __init__(self, words: int = CACHE_WORDS):
        self.words, self.now, self.before = words, {}, {}

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self.now) >= self.words:
            self.before = dict(self.now)
            self.now.clear()  # in place, as callers hold its lookup
        self.now[word] = ids
        return ids

    def get(self, word: str) -> bytes | None:
        if (ids := self.now.get(word)) is None and (ids := self.before.get(word)) is not None:
            self.keep(word, ids)
        return ids


def gathered(parts: list[str], per_text: list[int], ids_of: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts that are cut into parts, one after the other, and where each text's begin and end. ids_of gets each distinct part once."""
    coded = pa.array(parts, pa.string()).dictionary_encode()
    known, at = ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    ids, ends = np.frombuffer(b"".join(known), dtype="<u4"), np.r_[0, np.cumsum(sizes[at])]
    moved = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], sizes[at])
    moved += np.arange(len(moved))
    return ids[moved], ends[np.r_[0, np.cumsum(per_text)].astype(np.int64)]


class Pairs:
    """Merge ranks by pair of tokens, in an open hash table for rows of pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, tokens: int):
        if tokens >= 1 << 16:
            raise ValueError(f"vocabularies of up to {1 << 16} tokens, not {tokens}")
        bits = max(4, (4 * len(left)).bit_length())
        self.tokens, self.shift, self.none = np.uint32(tokens), np.uint32(32 - bits), np.uint32(2**32 - 1)
        self.keys, self.ranks = np.full(1 << bits, self.none), np.full(1 << bits, NONE)
        key, left_over = self.key(left, right), np.arange(len(left))
        at = self.place(key)
        while len(left_over):
            free = np.zeros(len(left_over), dtype=bool)
            free[np.unique(at[left_over], return_index=True)[1]] = True
            free &= self.keys[at[left_over]] == self.none
            now, left_over = left_over[free], left_over[~free]
            self.keys[at[now]], self.ranks[at[now]] = key[now], now
            at[left_over] = (at[left_over] + 1) % len(self.keys)

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint32) * self.tokens + right.astype(np.uint32)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(2654435761)) >> self.shift

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE for pairs that don't merge."""
        key = self.key(left, right)
        at = self.place(key)
        out, todo = np.full(len(key), NONE), np.arange(len(key))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != self.none)]
            at[todo] = (at[todo] + 1) % len(self.keys)
        return out


class Merges:
    """The merges of a byte-level vocabulary; end: what marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str = ""):
        symbols = byte_symbols()
        if missing := [s for s in symbols if s not in vocab or s + end not in vocab]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:3]}")
        self.inner, self.final = (np.array([vocab[s + e] for s in symbols], dtype=np.int32) for e in ("", end))
        left, right, self.made = (np.array(x, dtype=np.int32) for x in ([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], [vocab[a + b] for a, b in merges]))
        self.pairs = Pairs(left, right, max(vocab.values()) + 1)
        self.left, self.right = left, right
        self.of_bytes = self.pairs.get(np.repeat(self.inner, 256), np.tile(self.inner, 256)).reshape(256, 256)

    @cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        """Of single pairs; long words alone need it."""
        return {p: i for i, p in enumerate(zip(self.left.tolist(), self.right.tolist()))}

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 32 bits) of words of at least one byte."""
        size, out = np.fromiter(map(len, words), np.int64, len(words)), [b""] * len(words)
        for low, high in ((0, 8), (8, 12), (12, 20), (20, SHORT)):
            some = np.flatnonzero((low < size) & (size <= high))
            for at in range(0, len(some), 20_000):
                self.rows(words, some[at : at + 20_000], size, high, out)
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = np.array(self.long_word(words[i]), dtype="<u4").tobytes()
        return out

    def rows(self, words: list[bytes], row: np.ndarray, size: np.ndarray, width: int, out: list[bytes]) -> None:
        """Words number row, of up to width bytes, into out. Places past a word's end hold -1 and rank NONE."""
        n, some = size[row], np.arange(len(row))
        there = np.arange(width) < n[:, None]
        text = np.zeros(there.shape, dtype=np.uint8)
        text[there] = np.frombuffer(b"".join([words[i] for i in row.tolist()]), dtype=np.uint8)
        ids = np.where(there, self.inner[text], np.int32(-1))
        ids[some, n - 1] = self.final[text[some, n - 1]]
        ranks = np.where(there[:, 1:], self.of_bytes[text[:, :-1], text[:, 1:]], NONE)
        some = some[n > 1]
        ranks[some, n[some] - 2] = self.pairs.get(ids[some, n[some] - 2], ids[some, n[some] - 1])
        while len(row):
            least = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), dtype=np.int64)
            rank = ranks[np.arange(len(row)), least] if ranks.shape[1] else np.full(len(row), NONE)
            if (done := rank == NONE).any():
                count = (ids[done] >= 0).sum(1).tolist()
                for i, n_ids, own in zip(row[done].tolist(), count, ids[done].astype("<u4")):
                    out[i] = own[:n_ids].tobytes()
                row, ids, ranks, least, rank = (x[~done] for x in (row, ids, ranks, least, rank))
            if not len(row):
                return
            some, new = np.arange(len(row)), self.made[rank]
            ids[some, least] = new
            ids, ranks = _closed_up(ids, least + 1), _closed_up(ranks, least)  # the boundary between the two parts goes
            left = np.flatnonzero(least > 0)
            ranks[left, least[left] - 1] = self.pairs.get(ids[left, least[left] - 1], new[left])
            right = np.flatnonzero(least < ranks.shape[1])
            after = ids[right, least[right] + 1]
            ranks[right, least[right]] = np.where(after >= 0, self.pairs.get(new[right], after), NONE)

    def long_word(self, word: bytes) -> list[int]:
        """The same merges in the same order by a heap of (rank, place), for words of any length."""
        part = self.inner[np.frombuffer(word, dtype=np.uint8)]
        part[-1] = self.final[word[-1]]
        n, first = len(part), self.pairs.get(part[:-1], part[1:]).tolist()
        part, after, before = part.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j], after[i] = int(self.made[least]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank_of.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return [p for p in part if p >= 0]


def _closed_up(rows: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """rows without one place each."""
    stay = np.ones(rows.shape, dtype=bool)
    stay[np.arange(len(rows)), gone] = False
    return rows[stay].reshape(len(rows), -1)


class Codec:
    """Encodes with a vocabulary file of byte-level symbols and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, vocab = path, model["vocab"]
        self.merges = Merges(vocab, model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache, self.library = Cache(), None
        strings: list[str | None] = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in {**vocab, **self.special}.items():
            strings[i] = token
        self.strings = pa.array(strings, pa.string())

    def pretokens(self, piece: str) -> list[str]:
        if piece.isascii() and piece.isalpha():
            return [piece]
        if OWN_TABLES.search(piece):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            text = self.library.normalizer.normalize_str(piece)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [piece] if piece.isalpha() else WORDS.findall(piece)

    def pieces(self, text: str) -> list[str]:
        """Runs without white space; special strings have a line end before them."""
        out = []
        for i, part in enumerate(self.split.split(text) if self.split and "<|" in text else [text]):
            if i % 2:
                out.append("\n" + part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            out += [p for p in BREAKS.split(part) if p] if SEPARATORS.search(part) else part.split()
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        out = [*map(self.cache.get, pieces)]
        missing = {i: [p] if p[0] == "\n" else self.pretokens(p) for i, p in enumerate(pieces) if out[i] is None}
        words = [*{w for own in missing.values() for w in own}]
        found = dict(zip(words, self.merges.words([w.encode() for w in words])))
        found |= {"\n" + s: i.to_bytes(4, "little") for s, i in self.special.items()}
        for i, own in missing.items():
            out[i] = found[own[0]] if len(own) == 1 else b"".join(map(found.__getitem__, own))
            if len(pieces[i]) <= SHORT:
                self.cache.keep(pieces[i], out[i])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Whole texts to their ids (little-endian, 32 bits each)."""
        parts = [self.pieces(t) if t else [] for t in texts]
        ids, ends = gathered([p for own in parts for p in own], [*map(len, parts)], self.ids_of)
        return [ids[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def decode(self, ids: list[bytes]) -> pa.Array:
        """The texts of some documents' ids: this vocabulary has no decoder, so the tokens' strings are joined by spaces."""
        flat, ends = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)])
        if len(flat) and int(flat.max()) >= len(self.strings):
            raise ValueError(f"no token {int(flat.max())}")
        words = self.strings.take(pa.array(flat))
        if words.null_count:
            raise ValueError("ids without a token")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")


#: Separators that Python's split() takes for white space and the vocabulary doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(texts: Iterable, size: int = SLICE) -> Iterator[list[str | None]]:
    """Arrow strings in lists of about so many characters."""
    out, n = [], 0
    for t in texts:
        out.append(t.as_py())
        n += len(out[-1] or "")
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def encoded(text: Column, path: str) -> Column:
    """A struct of token_ids (binary, little-endian 32 bits), n_tokens and decoded (from those ids)."""

    @F.arrow_udf(IDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for ids in map(codec(path).encode, slices(texts)):
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), codec(path).decode(ids)], IDS.names)

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of binary token ids; null for null."""

    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        return pc.if_else(rows.is_valid(), codec(path).decode([x or b"" for x in rows.to_pylist()]), None)

    return run(ids)


def digests(text: Column, path: str) -> Column:
    """What encoded() gives, as counts and hashes, so that the ids needn't leave the worker."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    @F.arrow_udf(DIGEST)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for ids in map(codec(path).encode, slices(texts)):
                plain = codec(path).decode(ids).cast(pa.binary())
                yield pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(x.as_buffer()) for x in plain], pa.string())], DIGEST.names)

    return run(text)


def bpe_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("d")).select("doc_id", "d.*")
