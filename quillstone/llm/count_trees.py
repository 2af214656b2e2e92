"""Edit-aware token counts (operator 10): a segment tree of pre-token counts per document.

A leaf is a run of pre-tokens that begins where one always does: at the text's start, at the last blank or line end before a visible character, or, within
long runs, at a sign of prose after a letter. Two trees of sums run over the leaves: code points, and tokens. An edit finds
its leaves by descending the first tree; they are joined with a neighbour where the edited run no longer meets it at such a
place (boundary context), split anew, encoded, and their sums updated up to the root. All other leaves keep their counts. Between edits a document's tree is
kept as the counts of its leaves (``count_trees``), from which ``recounted`` goes on without encoding the text again.

Edge cases: null and empty texts have no leaves and no tokens, and may be edited (inserted into); edits past the end or with
start > end raise ValueError; edits are applied one after the other, each on the text that the one before left; doubled blanks, special strings and unusual white space
only lengthen the leaf they stand in; a run of letters alone is one leaf of any length. An empty table gives no rows; repeated rows and extra columns pass one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.token_store import encoder

#: Leaves of over so many bytes are split before signs of prose as well; where an edit needs more leaves than it touched, it may lengthen one up to this.
LONG = 256
EDIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
TREE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("leaves", T.BinaryType())])
EDITED = T.StructType([T.StructField("n_edits", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_tokens_after", T.LongType()), T.StructField("n_encoded_chars", T.LongType()), T.StructField("edited_sha256", T.StringType())])


def _of(*bytes_: int) -> np.ndarray:
    return np.isin(np.arange(256), bytes_)


#: Bytes: white space that opens a leaf; what may follow it (no white space, no byte that may begin wider white space or a special string).
BLANK, VISIBLE = _of(9, 10, 13, 32), ~_of(*range(9, 14), *range(28, 33), ord("<"), 0xC2, 0xE1, 0xE2, 0xE3)
#: ASCII letters and the signs before which a pre-token of letters ends; lead bytes of ideographs, and their full stops and commas as three bytes.
LETTER, SIGN = _of(*range(65, 91), *range(97, 123)), _of(*b",.;:!?()")
IDEOGRAPH, WIDE_SIGNS = _of(*range(0xE5, 0xE9)), ("\u3001", "\u3002", "\uff0c", "\uff01", "\uff1f")


def starts_of(text: bytes) -> np.ndarray:
    """Where leaves begin, as places in the bytes of a text; the first is 0, the last the text's end."""
    b = np.frombuffer(text, dtype=np.uint8)
    out = np.r_[0, np.flatnonzero(BLANK[b[:-1]] & VISIBLE[b[1:]]), len(b)]
    if len(b) > LONG and (np.diff(out) > LONG).any():
        more = np.flatnonzero(LETTER[b[:-1]] & SIGN[b[1:]]) + 1
        for sign in WIDE_SIGNS:
            x, y, z = sign.encode()
            more = np.r_[more, p := np.flatnonzero((b[3:-2] == x) & (b[4:-1] == y) & (b[5:] == z) & IDEOGRAPH[b[:-5]]) + 3]
        long = np.diff(out)[np.searchsorted(out, more, side="right") - 1] > LONG
        out = np.r_[out, more[long]]
    return np.unique(out)


def parted(before: bytes, leaf: bytes) -> bool:
    """Whether a pre-token begins with leaf after the bytes before, whatever else stands around."""
    if len(leaf) > 1 and BLANK[leaf[0]] and VISIBLE[leaf[1]]:
        return True
    if not before or not leaf:
        return False
    return bool(LETTER[before[-1]] and SIGN[leaf[0]] or len(before) >= 3 and IDEOGRAPH[before[-3]] and leaf.startswith(tuple(s.encode() for s in WIDE_SIGNS)))


def counted(text: str, vocabulary: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's bytes, where its leaves begin, and their tokens: the text is encoded once, and its tokens are dealt to the leaves by their bytes."""
    data, own = text.encode(), encoder(vocabulary)
    starts, ends = starts_of(data), np.r_[0, np.cumsum(own.size_of[own.encode(text)])]
    at = np.searchsorted(ends, starts)
    if not np.array_equal(ends[at], starts):
        raise AssertionError("a token reaches over a leaf's end")
    return data, starts, np.diff(at)


class Sums:
    """A segment tree of sums in an array: node i has children 2i and 2i+1."""

    def __init__(self, values: np.ndarray):
        self.size = max(1, 1 << (len(values) - 1).bit_length()) if len(values) else 1
        tree = np.zeros(2 * self.size, dtype=np.int64)
        tree[self.size : self.size + len(values)] = values
        level = self.size
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
            level //= 2
        self.tree: list[int] = tree.tolist()

    def set(self, i: int, value: int) -> None:
        i += self.size
        change = value - self.tree[i]
        while i and change:
            self.tree[i] += change
            i //= 2

    def leaves(self) -> np.ndarray:
        return np.array(self.tree[self.size :], dtype=np.int64)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds place at, and at's place in it."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= (left := self.tree[i]):
                at -= left
                i += 1
        return i - self.size, at


class CountTree:
    def __init__(self, text: str, vocabulary: str, counts: np.ndarray | None = None):
        """counts: of the leaves, if they are kept from before."""
        self.vocabulary, self.encoded = vocabulary, 0
        if counts is None:
            self.encoded = len(text)
            self.lay(*counted(text, vocabulary))
        else:
            self.lay(data := text.encode(), starts_of(data), counts)

    def lay(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> None:
        chars = np.r_[0, np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)][starts]
        self.chars, self.tokens = Sums(np.diff(chars)), Sums(counts)
        places = starts.tolist()
        self.leaves = [data[a:b] for a, b in zip(places, places[1:])] + [b""] * (self.chars.size - len(places) + 1)

    @property
    def n_tokens(self) -> int:
        return self.tokens.tree[1]

    def counts(self) -> np.ndarray:
        """Of the leaves that aren't empty, in order."""
        return self.tokens.leaves()[self.chars.leaves() > 0]

    def text(self) -> str:
        return b"".join(self.leaves).decode()

    def edit(self, start: int, end: int, text: str) -> None:
        """Replaces the code points start..end-1."""
        n = self.chars.tree[1]
        if not 0 <= start <= end <= n:
            raise ValueError(f"edit {start}..{end} of {n} code points")
        if not n:
            self.encoded += len(text)
            return self.lay(*counted(text, self.vocabulary))
        sizes, base = self.chars.tree, self.chars.size
        first, a = self.chars.find(min(start, n - 1))
        low = min(start, n - 1) - a
        last, high = first, low + sizes[base + first]
        if high < end:
            last, b = self.chars.find(end - 1)
            high = end - 1 - b + sizes[base + last]
        run = (self.leaves[first].decode()[: start - low] + text + self.leaves[last].decode()[end - high + sizes[base + last] :]).encode()
        while low:
            before = first - 1 if self.leaves[first - 1] else self.chars.find(low - 1)[0]
            if run and parted(self.leaves[before], run):
                break
            first, run, low = before, self.leaves[before] + run, low - sizes[base + before]
        while high < n:
            after = last + 1 if self.leaves[last + 1] else self.chars.find(high)[0]
            if run and parted(run, self.leaves[after]):
                break
            last, run, high = after, run + self.leaves[after], high + sizes[base + after]
        self.encoded += high - low - (end - start) + len(text)
        if len(run) <= LONG and OPENS.search(run, 1) is None:
            places, sums = [0, len(run)], [len(encoder(self.vocabulary).encode(run.decode()))]
        else:
            places, sums = (x.tolist() for x in counted(run.decode(), self.vocabulary)[1:])
        room = last - first + 1
        if len(sums) > room:
            if places[-1] - places[room - 1] > LONG:  # no place for them: lay the tree anew, from the counts
                old = self.tokens.leaves()
                leaves = [*self.leaves[:first], *(run[x:y] for x, y in zip(places, places[1:])), *self.leaves[last + 1 :]]
                lengths, new = np.fromiter(map(len, leaves), np.int64, len(leaves)), np.r_[old[:first], sums, old[last + 1 :]].astype(np.int64)
                return self.lay(b"".join(leaves), np.r_[0, np.cumsum(lengths[lengths > 0])], new[lengths > 0])
            places, sums = [*places[:room], len(run)], [*sums[: room - 1], sum(sums[room - 1 :])]
        for i in range(first, last + 1):
            k = i - first
            leaf = run[places[k] : places[k + 1]] if k < len(sums) else b""
            if leaf or self.leaves[i]:
                self.leaves[i] = leaf
                self.chars.set(i, len(leaf.decode()))
                self.tokens.set(i, sums[k] if leaf else 0)


#: Where a leaf opens within a short run.
OPENS = re.compile(rb"[\t\n\r ](?=[^\t-\r\x1c- <\xc2\xe1\xe2\xe3])")


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(kept: bytes) -> np.ndarray:
    return np.frombuffer(kept, dtype=f"<u{kept[0]}", offset=1).astype(np.int64)


def _struct(rows: list[tuple], kind: T.StructType, types: list[pa.DataType]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], kind.names)


def count_trees(text: Column, vocabulary: str) -> Column:
    """A struct of n_tokens and the leaves' counts (packed), from which a later edit goes on."""

    @F.arrow_udf(TREE)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            counts = counted(t.as_py() or "", vocabulary)[2]
            rows.append((int(counts.sum()), packed(counts)))
        return _struct(rows, TREE, [pa.int64(), pa.binary()])

    return run(text)


def recounted(text: Column, edits: Column, vocabulary: str, leaves: Column | None = None) -> Column:
    """A struct of n_edits, n_tokens (before), n_tokens_after, n_encoded_chars (by the edits alone), edited_sha256. leaves: counts kept by count_trees(), else
    (also where they are null) they are counted here."""

    @F.arrow_udf(EDITED)
    def run(texts: pa.Array, edits: pa.Array, leaves: pa.Array) -> pa.Array:
        rows = []
        for t, todo, kept in zip(texts, edits, leaves):
            t, todo, kept = t.as_py() or "", todo.as_py() or [], kept.as_py()
            counts = None if kept is None else unpacked(kept)
            if counts is not None and not todo:
                n = int(counts.sum())
                rows.append((0, n, n, 0, hashlib.sha256(t.encode()).hexdigest()))
                continue
            tree = CountTree(t, vocabulary, counts)
            before, tree.encoded = tree.n_tokens, 0
            for e in todo:
                tree.edit(e["start"], e["end"], e["text"] or "")
            rows.append((len(todo), before, tree.n_tokens, tree.encoded, hashlib.sha256(tree.text().encode()).hexdigest()))
        return _struct(rows, EDITED, [pa.int64()] * 4 + [pa.string()])

    return run(text, edits, F.lit(None).cast("binary") if leaves is None else leaves)


#: The edits that masking makes: mail addresses, runs of digits, and runs of exclamation marks.
MASKS = [(re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), "<mail>"), (re.compile("[0-9]{2,}"), "0"), (re.compile("!{2,}"), "!")]


def mask_edits(text: str) -> Iterable[tuple[int, int, str]]:
    """Masking as edits, from the last to the first, so that each leaves the places of the rest."""
    found, taken = [], -1
    for a, b, mask in sorted((*m.span(), mask) for pattern, mask in MASKS if ("!!" if mask == "!" else "@" if mask == "<mail>" else "") in text for m in pattern.finditer(text)):
        if a >= taken:
            found.append((a, b, mask))
            taken = b
    return reversed(found)


@F.arrow_udf(EDIT)
def masking(texts: pa.Array) -> pa.Array:
    rows = [[{"start": a, "end": b, "text": m} for a, b, m in mask_edits(t.as_py() or "")] for t in texts]
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))


def masked_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and recounted() of every document under the masking edits, from the trees that count_trees() keeps."""
    kept = docs.select("doc_id", "text", masking("text").alias("edits"), count_trees(F.col("text"), vocabulary).alias("tree"))
    return kept.select("doc_id", recounted(F.col("text"), F.col("edits"), vocabulary, F.col("tree.leaves")).alias("r")).select("doc_id", "r.*")
