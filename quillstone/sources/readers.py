"""Readers of attachments: a chain by MIME type, first match wins. Types come from the bytes where they tell, else from what was stated. A row whose bytes no reader takes, or that one fails on, has a status and a reason;
no bytes fail a job.

Statuses: done; unsupported (no reader for the type, or binary bytes under a text type); skipped (a reader is known, but switched off); failed (the reader gave an error). Null contents are failed, empty ones done with an empty text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.sources.store import decoded, looks_binary

#: What files of a type begin with, in hexadecimal digits: fixed values.
MAGIC = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "504B0304": "application/zip", "1F8B": "application/gzip", "4F676753": "audio/ogg", "494433": "audio/mpeg"}
#: Types of text beside text/*: fixed values.
TEXT_LIKE = ["application/json", "application/xml", "application/csv", "application/x-ndjson", "application/yaml", "application/x-yaml", "application/xhtml+xml"]
OUTCOME = "status string, text string, detail string"


@dataclass(frozen=True)
class Reader:
    """takes: of a type, whether this reader reads it; read: of type and content, (status, text, detail)."""

    takes: Callable[[Column], Column]
    read: Callable[[Column, Column], Column]


def outcome(status: str | Column, body: Column, detail: str | Column) -> Column:
    plain = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(plain(status).alias("status"), body.alias("text"), plain(detail).alias("detail"))


def mime_of(content: Column, stated: Column) -> Column:
    """The type: by the first bytes, else as stated (without parameters, in lower case), else text/html or application/json by how the text begins, else text/plain."""
    head, told = F.hex(F.substring(content, 1, 8)), F.nullif(F.trim(F.lower(F.substring_index(stated, ";", 1))), F.lit(""))
    found = F.lit(None).cast("string")
    for digits, kind in reversed(MAGIC.items()):
        found = F.when(head.startswith(digits), kind).otherwise(found)
    start = F.ltrim(decoded(F.substring(content, 1, 512)))
    looks = F.when(start.rlike(r"(?i)^<(!doctype html|html)\b"), "text/html").when(start.rlike(r"^[{\[]"), "application/json").otherwise("text/plain")
    return F.coalesce(found, told, looks)


def disabled(prefix: str, why: str) -> Reader:
    """A type that is known, whose reader isn't switched on."""
    return Reader(lambda kind: kind.startswith(prefix), lambda kind, content: outcome("skipped", F.lit(""), why))


def _text(most_bytes: int) -> Reader:
    def takes(kind: Column) -> Column:
        return kind.startswith("text/") | kind.isin(*TEXT_LIKE)

    def read(kind: Column, content: Column) -> Column:
        body = decoded(F.substring(content, 1, most_bytes))
        json = kind.isin("application/json")
        shown = F.when(kind.isin("text/html", "application/xhtml+xml"), text.html_text(body)).otherwise(body)
        note = F.when(F.octet_length(content) > most_bytes, F.concat(F.lit("first "), F.lit(most_bytes).cast("string"), F.lit(" bytes"))).when(json & F.try_parse_json(body).isNull(), "not well-formed").otherwise(kind)
        return F.when(looks_binary(body), outcome("unsupported", F.lit(""), "binary content")).otherwise(outcome("done", shown, note))

    return Reader(takes, read)


def chain(most_bytes: int = 4 << 20) -> list[Reader]:
    """Text in its forms; images, sound and PDF are known but need a model or a library that isn't here: put readers of them before these."""
    return [_text(most_bytes), disabled("image/", "no reader of images"), disabled("audio/", "no reader of sound"), disabled("application/pdf", "no reader of PDF")]


def extracted(files: DataFrame, readers: list[Reader] | None = None) -> DataFrame:
    """files (content, mime, ...) with their other columns, mime (as found), status, text, detail."""
    kind, content = F.col("mime"), F.col("content")
    typed = files.withColumn("mime", mime_of(content, F.col("mime")))
    found = outcome("unsupported", F.lit(""), kind)
    for reader in reversed(chain() if readers is None else readers):
        found = F.when(reader.takes(kind), reader.read(kind, content)).otherwise(found)
    found = F.when(content.isNull(), outcome("failed", F.lit(""), "no content")).otherwise(found)
    return typed.withColumn("outcome__", found.cast(f"struct<{OUTCOME.replace(' ', ':').replace(',:', ',')}>")).select(*(c for c in typed.columns if c not in ("content", "status", "text", "detail")), "outcome__.*")
