"""Splitting texts into chunks of a token budget: at paragraphs, else sentences, else blanks, else anywhere; each chunk but the first begins with the tail of the one before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SEPARATORS = (r"(?<=\n\n)", r"(?<=[.!?])(?=\s)", r"(?<=\s)(?=\S)")
ROWS = "doc_id long, position int, text string, token_count int, overlap_chars int"


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def pieces(text: str, budget: int, level: int = 0) -> Iterator[str]:
    """Parts of at most budget tokens that join to the text."""
    if tokens(text) <= budget:
        yield text
    elif level == len(SEPARATORS):
        for i in range(0, len(text), budget * 4):
            yield text[i : i + budget * 4]
    else:
        for part in re.split(SEPARATORS[level], text):
            yield from pieces(part, budget, level + 1)


def tail(text: str, overlap: int) -> str:
    """The last overlap tokens, from a sentence's start if there is one, else from a blank."""
    end = text[-overlap * 4 :] if overlap else ""
    cut = re.search(r"(?<=[.!?])\s", end) or re.search(r"\s", end)
    return end[cut.end() :] if cut and len(end) < len(text) else end if len(end) < len(text) else ""


def split(text: str, budget: int = 256, overlap: int = 32) -> Iterator[tuple[str, int]]:
    """Chunks with the number of their first code points that repeat the one before."""
    body, lead = "", ""
    for piece in pieces(text, max(1, budget - overlap)):
        if body and tokens(lead + body + piece) > budget:
            yield lead + body, len(lead)
            lead, body = tail(lead + body, overlap), ""
        body += piece
    if body:
        yield lead + body, len(lead)


def chunked(docs: DataFrame, budget: int = 256, overlap: int = 32) -> DataFrame:
    """A row for each chunk of docs (doc_id, text). Null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(d, i, t, tokens(t), n) for d, text in zip(df["doc_id"], df["text"]) if text for i, (t, n) in enumerate(split(text, budget, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "text", "token_count", "overlap_chars"])

    return docs.select("doc_id", "text").mapInPandas(run, ROWS)
