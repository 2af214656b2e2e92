"""The stored index against brute-force BM25, with its layout, and the analyzer by known stems."""

import math
import random
from collections import Counter

import pytest

from quillstone.functions import english
from quillstone.operators import fulltext


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("communism", "commun"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("généreux", "généreux"), ("x86", "x86")])
def test_stems(word, want):
    assert english.stem(word) == want


def test_stop_words_go():
    assert english.english("The hopping of the CATS, and 2 dogs_run") == ["hop", "cat", "2", "dog", "run"] and english.english(None) == []


def brute(docs, words, k, analyzer):
    terms = {i: english.ANALYZERS[analyzer](t) for i, t in docs.items()}
    mean = sum(map(len, terms.values())) / max(1, len(terms))
    scores = Counter()
    for w in {*english.ANALYZERS[analyzer](words)}:
        df = sum(w in t for t in terms.values())
        for i, t in terms.items():
            if n := t.count(w):
                scores[i] += math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return sorted(((i, s) for i, s in scores.items()), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("analyzer", ["english", "plain"])
def test_index_is_brute_force(spark, tmp_path, analyzer):
    r, path = random.Random(1), str(tmp_path / "index")
    vocabulary = ["running", "runs", "the", "cats", "cat", "hope", "hopes", "zebra"] + [f"w{i}" for i in range(30)]
    docs = {i: " ".join(r.choices(vocabulary, [9, 5, 30, 4, 4, 2, 2, 0.1] + [1] * 30, k=r.randrange(1, 40))) for i in range(0, 900, 3)} | {5000: None, 5001: ""}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(None, "cat", 1)], "id long, body string, term int")
    fulltext.add(df.filter("id < 600 OR id IS NULL"), path, "id", "body", analyzer, block=16)
    fulltext.add(df.filter("id >= 600"), path, "id", "body", analyzer, block=16)
    requests = ["running cats", "zebra", "the hope of the zebra runs", "unknown", "w3 w4 cat", "..."]

    def holds(now):
        for words in requests:
            for k in (3, 40):
                want = brute(now, words, k, analyzer)
                for skip in (True, False):
                    got = [(x.id, x.score) for x in fulltext.search(spark, path, words, k, analyzer, skip).collect()]
                    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])

    holds(docs)
    gone = {i: t for i, t in docs.items() if i % 4 == 0}
    fulltext.delete(df.filter("id % 4 = 0"), path, "id", "body", analyzer)
    rest = {i: t for i, t in docs.items() if i % 4}
    back = {i: f"zebra again {i}" for i in list(gone)[:5]}
    fulltext.add(spark.createDataFrame([*back.items()], "id long, body string"), path, "id", "body", analyzer)
    holds(rest | back)


def test_rare_terms_read_few_row_groups(spark, tmp_path):
    """Row groups are apart by term: one term's blocks lie in few of them. Blocks that can't matter aren't opened."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "index")
    docs = spark.range(4000).selectExpr("id", "concat_ws(' ', transform(sequence(1, 12), i -> concat('t', CAST(pmod(xxhash64(id, i), 3000) AS STRING))), if(id % 2 = 0, 'common', 'other')) AS body")
    layout = dict(fulltext.LAYOUT)
    fulltext.LAYOUT["parquet.block.size"] = 4096
    try:
        fulltext.add(docs, path, "id", "body", "plain")
    finally:
        fulltext.LAYOUT.update(layout)
    groups = hits = 0
    for f in glob.glob(f"{path}/postings/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            groups, hits = groups + 1, hits + (s.min <= "t1234" <= s.max)
    assert groups >= 4 and hits <= max(1, groups // 4)
    assert "PushedFilters: [In(term, [t1234,t99])]" in fulltext.postings(spark, path, ["t1234", "t99"])._jdf.queryExecution().executedPlan().toString()


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, body string")
    assert fulltext.search(spark, str(tmp_path / "none"), "cat", 5).isEmpty()
    fulltext.add(docs, str(tmp_path / "x"), "id", "body")
    assert fulltext.search(spark, str(tmp_path / "x"), "cat", 5).isEmpty()
