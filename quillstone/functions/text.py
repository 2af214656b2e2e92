"""Text functions. Lengths are in code points."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Named entities: fixed values.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def fit_tokens(text: Column, budget: int) -> Column:
    """The longest prefix of so many approximate tokens, back to a blank if it is cut."""
    head = F.substring(text, 1, budget * 4)
    return F.when(F.length(text) <= budget * 4, text).otherwise(F.regexp_replace(head, r"\s\S*\z", ""))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def predicate(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


@F.pandas_udf(T.StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Compatibility-decomposed (NFKD), without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"))


def slug(text: Column, longest: int = 72) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, accents dropped, cut at a hyphen."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(without_marks(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(plain) <= longest, plain).otherwise(F.regexp_replace(F.substring(plain, 1, longest), "(?<=.)-[^-]*$", ""))


def path_segment(text: Column) -> Column:
    """Safe in paths, one character for one; a changed one, "." and "..", and the empty text get eight digits of their hash, and no dots in front."""
    safe = F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")
    dots = safe.rlike(r"^\.{0,2}$")
    stem = F.when(dots, "x").otherwise(F.regexp_replace(safe, r"^\.+", ""))
    return F.when((safe == text) & ~dots, text).otherwise(F.concat(stem, F.lit("-"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8)))


def clip(text: Column, n: int) -> Column:
    """At most n code points, back to a blank if cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(F.substring(text, 1, n), r"\s+\S*\z", ""))


def _character(code: Column) -> Column:
    """The character of a code point; null where there is none."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def entities(text: Column) -> Column:
    """Named (the common ones) and numeric entities decoded; others stay. Each is decoded once, so "&amp;lt;" gives "&lt;"."""

    def one(part: Column) -> Column:  # what follows an ampersand
        body = F.regexp_extract(part, r"^(#[xX]?[0-9A-Fa-f]{1,8}|[A-Za-z]+);", 1)
        rest = F.substring(part, F.length(body) + 2, F.length(part))
        decimal, hexadecimal = body.rlike("^#[0-9]+$"), body.rlike("^#[xX][0-9A-Fa-f]+$")
        code = F.when(decimal, F.substring(body, F.lit(2), F.length(body)).try_cast("long")).when(hexadecimal, F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("long"))
        named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
        char = F.coalesce(F.try_element_at(named, F.lower(body)), _character(code))
        return F.when((body != "") & char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), one), ""))).otherwise(text)


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; entities decoded; blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(entities(out), r"[\s\u00a0]+", " "))


def terms(text: Column) -> Column:
    """The analyzer of full-text search: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def label(kind: Column, content: Column, key: Column, value: Column | None = None) -> Column:
    """A short label for a row of any kind; value: a preference's. Without a name, entities fall to their id; null contents and values count as empty."""
    body, plain = F.coalesce(content, F.lit("")), key.cast("string")
    said = F.lit("") if value is None else F.coalesce(value, F.lit(""))
    return F.when(kind.isin("fact", "insight", "observation", "chunk", "knowledge_chunk", "episode"), truncate(body, 80)).when(kind == "entity", F.coalesce(content, plain)).when(kind == "procedure", body).when(kind.isin("research", "knowledge_document"), F.coalesce(content, truncate(said, 80))).when(kind == "preference", F.concat(body, F.lit(" = "), truncate(said, 40))).otherwise(plain)


def primary_kind(labels: Column, stated: Column, known: tuple[str, ...]) -> Column:
    """A stated kind, else the first known label in lower case, else unknown. labels: array of strings."""
    found = F.filter(labels, lambda x: x.isin(*known))
    return F.when(F.coalesce(stated, F.lit("")) != "", stated).otherwise(F.coalesce(F.lower(F.try_element_at(found, F.lit(1))), F.lit("unknown")))


def speaks(text: Column) -> Column:
    """Whether a text opens with a turn label."""
    return F.regexp_like(text, F.lit(SPEAKER.replace("(?md)^", "(?d)\\A")))


def scope_key(*parts: str) -> Column:
    return F.concat_ws("|", *(F.when(F.col(p).isNotNull(), F.concat(F.lit(f"{p}="), F.col(p))) for p in parts))


#: Labels that open a turn of a transcript: fixed value.
SPEAKER = r"(?md)^(USER(?:\([^)\n]{1,64}\))?|ASSISTANT|TOOL|SYSTEM TRIGGER[^:\n]*):"
#: The same at a text's start, for Python.
SPEAKER_AT = re.compile(SPEAKER.replace("(?md)^", ""))


def last_speaker(text: Column) -> Column:
    """The last turn label in a transcript; null if it has none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1)), F.lit(-1))


def attributed_user(participants: Column, subject: Column, stated: Column, user: Column) -> Column:
    """Whom a fact belongs to. participants: array of (label, user_id) of the episode; stated: whether the fact names a subject at all.

    Without participants or a stated subject, and for unknown labels, the episode's user; for a null subject and for a participant without user, nobody."""
    match = F.filter(participants, lambda p: normal_name(p["label"]) == normal_name(subject))
    return F.when(F.coalesce(F.size(participants), F.lit(0)) <= 0, user).when(~stated, user).when(subject.isNull(), None).when(F.size(match) > 0, F.try_element_at(match, F.lit(1))["user_id"]).otherwise(user)


def display(df: DataFrame, leave_out: tuple[str, ...] = (), cut: tuple[str, ...] = ("content", "text", "summary"), n: int = 200) -> DataFrame:
    """Rows for an inspector: long texts cut, arrays and structs as placeholders."""

    def shown(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.concat(F.lit("["), F.size(f.name).cast("string"), F.lit(" items]"))
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            return F.when(F.col(f.name).isNotNull(), "[object]")
        return truncate(F.col(f.name), n) if f.name in cut else F.col(f.name)

    return df.select(*(shown(f).alias(f.name) for f in df.schema if f.name not in leave_out))


@F.pandas_udf(T.StringType())
def answer_json(answers: pd.Series) -> pd.Series:
    """The first JSON object or array in a model's answer, without its thinking and code fences; null if there is none."""
    read = json.JSONDecoder().raw_decode

    def one(answer: str | None) -> str | None:
        body = re.split("(?i)<think>", re.sub("(?is)<think>.*?</think>", "", answer or ""))[0]
        fenced = re.search(r"(?is)```(?:json)?\s*(.*?)```", body)
        body = fenced[1] if fenced else body
        start = re.search(r"[{\[]", body)
        try:
            return json.dumps(read(body, start.start())[0], separators=(",", ":"), ensure_ascii=False) if start else None
        except ValueError:
            return None

    return answers.map(one)
