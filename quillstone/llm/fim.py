"""Fill-in-middle transformation by a wavelet matrix over character classes (operator 13).

A text is a run of units: blanks and the word after them, or the blanks at its end. Each character has one of four classes: within a word, blank, last of a word, last of
the text's blanks. A wavelet matrix over the classes answers how many characters of a class stand before a place (rank); the ranks of the two last classes add up to the number of
units that end before it, and bisection on that sum finds where a unit ends. So both cuts are found in the matrix, and no list of units is made.

The four numbers that choose cuts and form are groups of the SHA-256 of seed and doc_id, so a document's form hangs on nothing but its id, its seed and its text.

Edge cases: null and empty texts are plain; texts that hold a mark (``<P>``, ``<S>``, ``<M>``) are plain, as they couldn't be rebuilt; texts of blanks alone are one unit; a null doc_id
counts as no digits; rows with equal doc_id and text get equal results; texts of any length are cut whole; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
INNER, BLANK, WORD_END, TEXT_END = range(4)
FIM = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)].view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: int) -> int:
        """Ones before place i."""
        word = i >> 6
        return int(self.before[word]) + (int(self.words[word]) & (1 << (i & 63)) - 1).bit_count()


class WaveletMatrix:
    """Symbols of so many bits, the highest first; each level holds its bit of all symbols, and sorts those with 0 before those with 1 for the next."""

    def __init__(self, symbols: np.ndarray, n_bits: int = 2):
        self.size, self.levels = len(symbols), []
        for shift in reversed(range(n_bits)):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones), len(symbols) - int(ones.sum())))
            if shift:
                symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol stands before place i."""
        a = 0
        for shift, bits, zeros in self.levels:
            if symbol >> shift & 1:
                a, i = zeros + bits.rank(a), zeros + bits.rank(i)
            else:
                a, i = a - bits.rank(a), i - bits.rank(i)
        return i - a


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blank = (codes == 32) | (codes >= 9) & (codes <= 13)
    out = np.where(blank, BLANK, INNER).astype(np.uint8)
    out[:-1][~blank[:-1] & blank[1:]] = WORD_END
    if len(out):
        out[-1] = TEXT_END if blank[-1] else WORD_END
    return out


class Units:
    """The units of a text by ranks."""

    def __init__(self, text: str):
        self.matrix = WaveletMatrix(classes(text))
        self.count = self.ended(self.matrix.size)

    def ended(self, i: int) -> int:
        """Units that end before place i or at it."""
        return self.matrix.rank(WORD_END, i) + self.matrix.rank(TEXT_END, i)

    def end(self, k: int) -> int:
        """Where the first k units end."""
        return bisect_left(range(self.matrix.size + 1), k, key=self.ended)


def transformed(doc_id: int | None, text: str, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    units = Units(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    if not text or h3 % 100 >= fim_percent or any(m in text for m in MARKS):
        return units.count, "plain", None, None, text
    a, b = (units.end(k) for k in sorted((h1 % (units.count + 1), h2 % (units.count + 1))))
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return units.count, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return units.count, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def fill_in_middle(doc_id: Column, text: Column, **options: int) -> Column:
    """A struct of n, form, prefix_chars, middle_chars, output."""

    @F.arrow_udf(FIM)
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [transformed(i.as_py(), t.as_py() or "", **options) for i, t in zip(ids, texts)]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], FIM.names)

    return run(doc_id.cast("long"), text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each mark is there once, as its text holds none."""
    head, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    first, second = (lambda mark: F.substring(F.split_part(head, F.lit(mark), F.lit(1)), 4, 2**31 - 1)), (lambda mark: F.split_part(head, F.lit(mark), F.lit(2)))
    spm, psm = F.concat(second(PREFIX), middle, first(PREFIX)), F.concat(first(SUFFIX), middle, second(SUFFIX))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def fim_documents(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document."""
    return docs.select("doc_id", fill_in_middle(F.col("doc_id"), F.col("text"), **options).alias("f")).select("doc_id", "f.*")


def fim_digests(docs: DataFrame, **options: int) -> DataFrame:
    """The same with output_sha256 and the hash of the text that is rebuilt from the output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return fim_documents(docs, **options).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
             CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
