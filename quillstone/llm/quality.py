"""Quality rules by distribution divergence (operator 9), in DataFrame functions only.

Base rules look at a text's number of words and at words in repeated 8-word windows. The verdict compares two histograms of a text with
those of its language: character classes, and the language's common words (with all others as one bin). References are the mean histograms
over all documents of the language that pass the base rules and have at least ``min_words`` words. The measure is the Jensen-Shannon distance (base 2, 0 to 1). Guards: a histogram is
judged only from ``min_words`` words on, word histograms only in languages with a list here and from ``min_common`` common words per language in the reference on.

Edge cases: null, empty and blank texts have no words and fail the base rules; null and unknown languages share one reference of character classes
and none of words; an empty table gives no rows; other columns pass through ``keep_quality`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BLANKS, shared_table

#: Common words by language: fixed values.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this", "are", "from", "at"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: What is stripped from a word before it is looked for among the common ones.
SIGNS = ".,;:!?\"'()[]{}*#$%&|<>«»„“”…-"
OTHER = "other"
#: Character classes by pattern: capitals, digits, punctuation of prose, symbols. Beside them: blanks, bytes beyond one a character, and the rest.
CLASSES = [r"\p{Lu}", "[0-9]", "[.,;:!?'\"()-]", "[#*$%&|<>]"]


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of shares, each of sum 1."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2))))


def _place_in(words: list[str]):
    """Of a word, in lower case and without signs around it, among words; 0 for others."""
    return lambda w: F.array_position(F.array(*map(F.lit, words)), F.btrim(F.lower(w), F.lit(SIGNS)))


def _equal(k: int):
    return lambda x: x == k


def _histograms(docs: DataFrame) -> DataFrame:
    """Adds text__, words__, n_words, word_chars, n_symbols, lang__, classes__ (shares), known__ (common words met), common__ (shares; null where there is no list)."""
    df = docs.withColumns({"text__": F.coalesce("text", F.lit("")), "lang__": F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(OTHER)})
    spaced = F.col("text__")
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    df = df.withColumn("words__", F.array_remove(F.split(spaced, " "), ""))
    found = F.lit(None).cast("array<bigint>")
    for lang, common in COMMON.items():
        found = F.when(F.col("lang__") == lang, F.filter(F.transform("words__", _place_in(common)), lambda i: i > 0)).otherwise(found)
    df = df.withColumns({"n_words": F.size("words__").cast("long"), "word_chars": F.length(F.array_join("words__", "")).cast("long"), "chars__": F.length("text__"), "found__": found})
    df = df.withColumns({f"class{i}__": F.col("chars__") - F.length(F.regexp_replace("text__", p, "")) for i, p in enumerate(CLASSES)})
    rare = [F.col(f"class{i}__") for i in range(len(CLASSES))]
    wide = F.octet_length("text__") - F.col("chars__")
    counts = [*rare, F.col("chars__") - F.col("word_chars"), wide, F.greatest(F.lit(0), F.col("word_chars") - sum(rare[1:], rare[0]) - wide)]
    df = df.withColumns({"counts__": F.array(*(c.cast("double") for c in counts)), "known__": F.size("found__")})
    n = F.greatest(F.lit(1), F.col("n_words")).cast("double")
    shares = [F.size(F.filter("found__", _equal(k))) / n for k in range(1, len(COMMON["en"]) + 1)]
    df = df.withColumns({"classes__": F.transform("counts__", lambda c: c / F.greatest(F.lit(1.0), _sum(F.col("counts__")))), "common__": F.when(F.col("found__").isNotNull(), F.array(*shares, (n - F.col("known__")) / n))})
    return df.withColumn("n_symbols", F.col("class3__").cast("long")).drop("chars__", "found__", "counts__", *(f"class{i}__" for i in range(len(CLASSES))))


def references(figures: DataFrame, min_words: int, min_common: int) -> DataFrame:
    """lang__, class_reference__, word_reference__ (null under min_common common words): a row for each language listed and one for all others.
    Only documents that pass the base rules count, so that repeated junk doesn't shape them."""
    mean = lambda c, n: F.array(*(F.avg(F.col(c)[i]) for i in range(n)))
    words = mean("common__", len(COMMON["en"]) + 1)
    sound = figures.filter((F.col("n_words") >= min_words) & ~F.expr(BASE_FAILED))
    return sound.groupBy("lang__").agg(mean("classes__", len(CLASSES) + 3).alias("class_reference__"), F.when(F.sum("known__") >= min_common, words).alias("word_reference__"))


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words and n_dup_lines."""
    lines = F.filter(F.split("text__", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({"lines__": lines, "hashes__": F.transform("words__", lambda w: F.xxhash64(w))})
    for now, step, before in (("two__", 1, "hashes__"), ("four__", 2, "two__"), ("eight__", 4, "four__")):  # hashes of 2, 4 and 8 words from each place on
        df = df.withColumn(now, F.expr(f"zip_with({before}, slice({before}, {step + 1}, size({before})), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("windows__", F.when(F.col("n_words") >= 8, F.slice("eight__", 1, F.col("n_words").cast("int") - 7)))
    again = F.size(F.array_distinct("windows__")) < F.size("windows__")
    df = df.withColumn("sorted__", F.when(again, F.sort_array(F.expr("transform(windows__, (h, i) -> struct(h, i))"))))
    df = df.withColumn("places__", F.expr("sort_array(array_distinct(flatten(zip_with(sorted__, slice(sorted__, 2, size(sorted__)), (x, y) -> if(x.h = y.h, array(x.i, y.i), array())))))"))
    covered = F.expr("aggregate(zip_with(places__, slice(places__, 2, size(places__)), (a, b) -> least(8, coalesce(b - a, 8))), 0L, (s, x) -> s + x)")
    df = df.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "n_dup_lines": (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long")})
    return df.drop("lines__", "hashes__", "two__", "four__", "eight__", "windows__", "sorted__", "places__")


def _judged(df: DataFrame, refs: DataFrame, min_words: int = 50, max_class: float = 0.3, max_word: float = 0.36, both: tuple[float, float, float] = (0.12, 0.16, 1.5)) -> DataFrame:
    """Adds base_failed, class_distance, word_distance, kept. A text is far from its language if a distance passes its limit, or each its lower limit in ``both``: that of classes, and that of words,
    to which the third number over the root of the text's words is added, as histograms of few words stray further by chance."""
    df = df.join(F.broadcast(refs), "lang__", "left")  # at most five rows
    long = F.col("n_words") >= min_words
    df = df.withColumns({"class_distance": F.when(long, js_distance(F.col("classes__"), F.col("class_reference__"))), "word_distance": F.when(long, js_distance(F.col("common__"), F.col("word_reference__")))})
    df = df.withColumn("base_failed", F.expr(BASE_FAILED))
    by_class, by_word = (F.coalesce(c, F.lit(0.0)) for c in ("class_distance", "word_distance"))
    stray = F.lit(both[2]) / F.sqrt(F.greatest(F.lit(1), F.col("n_words")))
    far = (by_class > max_class) | (by_word > max_word) | (by_class > both[0]) & (by_word > both[1] + stray)
    return df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~far))


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ["base_failed", "kept", "class_distance", "word_distance"]


def quality_rows(docs: DataFrame, min_words: int = 50, min_common: int = 50, **limits: float) -> DataFrame:
    """doc_id, FIGURES and VERDICT of every document. Texts are worked on once; their figures and histograms go to the shared folder."""
    rows = shared_table(_repeats(_histograms(docs.select("doc_id", "text", "lang"))).select("doc_id", "lang__", *FIGURES, "classes__", "common__", "known__"))
    return _judged(rows, references(rows, min_words, min_common), min_words, **limits).select("doc_id", *FIGURES, *VERDICT)


def keep_quality(docs: DataFrame, min_words: int = 50, min_common: int = 50, **limits: float) -> DataFrame:
    """The documents that are kept, with their own columns. Texts are worked on once: the documents go to the shared folder beside their figures and histograms, and are read from there when the
    references are known. What is left there is named in ``leftovers`` of the result; it can be discarded when that is written."""
    held = _repeats(_histograms(docs.select(F.struct(*docs.columns).alias("own__"), "text", "lang")))
    rows = shared_table(held.select("own__", "lang__", "n_words", "n_repeat_words", "classes__", "common__", "known__"), compression="zstd")  # texts, for one reading
    out = _judged(rows, references(rows, min_words, min_common), min_words, **limits).filter("kept").select("own__.*")
    out.leftovers = [rows]
    return out
