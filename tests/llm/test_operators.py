"""The corpus operators against brute force, libraries and planted cases, and on null, empty, repeated and clashing rows."""

import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import bpe, count_trees, decontaminate, licenses, line_dedup, pii, quality, sharding, simhash, token_store
from quillstone.llm.common import shared_dir
from quillstone.llm.queries import BYTE_VOCABULARY, ORACLES, QUERIES, WORD_VOCABULARY

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "a", "Σίσυφος İstanbul ﬁ", "x" * 3000, "don't  stop\t<|endoftext|> now\x1c", "naïve café\n\n naïve", "한국어 텍스트 1234", "same line\nsame line", "same line\nsame line"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", "s", 1) for i, t in enumerate(ODD)] + [(None, "no id", "xx", None, None), (None, None, None, None, None), (3, "\n\n", "en", "s", 1)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


def table(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


CLASH = ("k1", "k2", "arc", "kept", "hits", "bits", "n_words", "shard", "text__", "seen", "nth", "row", "own", "bpe", "n_tokens", "keep", "t", "cell")


#: Queries over documents; the one over conversations has its own cases in test_structure.
OF_DOCUMENTS = sorted(QUERIES.keys() - {"op11_repair"})


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_odd_and_empty_tables(spark, odd, empty, name, tmp_path):
    """Clashing columns and an empty benchmark change no value; rows equal in doc_id and text get equal values, but for their slots and places."""
    values = {}
    for kind, df, items in (("odd", odd, 2), ("odd", odd, 0), ("empty", empty, 2)):
        for extra in (False, True):
            path = str(tmp_path / f"{kind}{extra}{items}")
            df.withColumns({c: F.lit(1) for c in CLASH} if extra else {}).write.parquet(f"{path}/documents.parquet")
            spark.createDataFrame([(1, "no id"), (2, None), (3, "")][: 3 * bool(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
            out = QUERIES[name](spark, path).toPandas()
            if name == "op12_packing":  # pieces and sequences go by the order of rows
                out = out.groupby(["doc_id", "doc_tokens"], dropna=False, as_index=False).length.sum()
            elif name != "op4_licenses":
                assert len(out) == (len(ODD) + 3 if kind == "odd" else 0)
            key = [c for c in out if c not in ("slot", "start", "shard")]
            now = sorted(map(str, out[key].itertuples(index=False)))
            assert values.setdefault((kind, items if name == "op5_decontamination" else 0), now) == now


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, empty, stage, tmp_path):
    run, words = dict(corpus_pipeline.STAGES)[stage], " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, "no id"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    longer = odd.unionByName(spark.createDataFrame([(50, words, "en", "s", 1), (50, words, "en", "s", 1), (51, "lorem ipsum dolor\n" * 3 + words * 2000, None, "s", 1)], COLUMNS))  # some survive each stage
    got = {}
    for extra in (False, True):
        df = longer.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)} if extra else {})
        out = run(spark, df, str(tmp_path))
        assert out.columns[: len(df.columns)] == df.columns if stage != "bpe_encoding" else out.columns[-1] == "decoded"
        rows = out.toPandas()
        if extra and stage != "bpe_encoding":
            assert all((rows[c] == i).all() for i, c in enumerate(CLASH))
        got[extra] = Counter((repr(r.doc_id), r.text) for r in rows.itertuples())
        assert run(spark, df.limit(0), str(tmp_path)).count() == 0
    assert got[False] == got[True] and got[False]
    empty_items = str(tmp_path / "none")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty_items}/benchmark.parquet")
    assert run(spark, empty, empty_items).count() == 0


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_very_long_text(spark, name, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 9))) for _ in range(5000)]
    text = "\n".join(" ".join(r.choices(words, k=20)) for _ in range(40_000)) + " x@y.zz Released under the MIT License."
    assert len(text) > 4_000_000
    spark.createDataFrame([(1, text, "en", "s", 1), (2, "x" * 1_000_000 + "  " * 500_000, "en", "s", 1), (3, "short", "en", "s", 1)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(text.split()[-40:-20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == (1 if name == "op4_licenses" else 3)
    if name == "op2_bpe":
        ids = library(WORD_VOCABULARY).encode(text, add_special_tokens=False).ids
        assert got[1].ids_sha256 == hashlib.sha256(le(ids)).hexdigest()
    elif name == "op5_decontamination":
        assert got[1].n_hit >= 20 and not got[2].contaminated
    elif name == "op7_pii":
        assert got[1].n_email == 1


def test_shards(spark, docs):
    got = table(QUERIES["op1_sharding"](spark, SF))
    sizes = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert len(sizes) == 16 and sizes["size"].max() - sizes["size"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["size"] - 1).all() and (sizes["nunique"] == sizes["size"]).all()
    assert list(got["size"]) == [len(t.encode()) + 1 for t in docs.text] and list(got.text_crc32) == [zlib.crc32(t.encode()) for t in docs.text]


def test_hot_key_and_movement(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    sizes = sharding.assign(hot, "k", 8).groupBy("shard").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    a, b = (sharding.assign(ids, "k", n, load_factor=1.25).toPandas().set_index("k").shard.sort_index() for n in (16, 17))
    assert a.value_counts().max() <= np.ceil(1.25 * 20_000 / 16)
    assert (a != b).mean() < 0.1  # one in 17 is the least; modulo would move nearly all


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_placement_is_the_sequential_ring(factor):
    """Row by row in the same order: a row goes to the first owner with room, clockwise from its arc."""
    r = np.random.default_rng(1)
    counts = {(int(a), int(c)): int(r.integers(0, 40)) for a in range(64) for c in range(4)}
    counts[5, 2] = 900  # a hot arc
    owners, shards = r.integers(0, 8, 64).tolist(), 8
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)] if factor == 1 else [int(np.ceil(factor * total / shards))] * shards
    used, want = [0] * shards, {}
    left = {k: list(range(n)) for k, n in sorted(counts.items())}
    for step in range(len(owners)):
        for (arc, chunk), rows in left.items():
            shard = owners[(arc + step) % len(owners)]
            while rows and used[shard] < room[shard]:
                want[arc, chunk, rows.pop(0)] = (shard, used[shard])
                used[shard] += 1
    got = {(arc, chunk, i): (shard, base + i - first) for arc, chunk, first, past, shard, base in sharding.place(counts, owners, shards, factor) for i in range(first, past)}
    assert got == want and len(got) == total


def test_sharding_keeps_clashing_columns(spark):
    df = spark.range(50).select(F.col("id").alias("k"), *(F.lit(f"own {c}").alias(c) for c in ("seen", "nth", "arc", "chunk", "place", "row", "first", "base")))
    got = sharding.assign(df, "k", 4).toPandas()
    assert all((got[c] == f"own {c}").all() for c in df.columns[1:]) and len(got) == 50


@pytest.mark.parametrize("text", [t or "" for t in ODD] + ["hello's WORLD <|startoftext|>x", "".join(map(chr, range(1, 0x250))), "abcdeth" * 30])
def test_bpe_is_the_library(text):
    lib, own = library(WORD_VOCABULARY), bpe.codec(WORD_VOCABULARY)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(["", text, None]) == [b"", le(ids), b""]
    assert own.decode([le(ids), b""]).to_pylist() == [lib.decode(ids, skip_special_tokens=False), ""]


def test_ids_without_a_token():
    with pytest.raises(ValueError):
        bpe.codec(WORD_VOCABULARY).decode([le([10**6])])


def test_bpe_query(spark, docs):
    lib = library(WORD_VOCABULARY)
    for row, text in zip(table(QUERIES["op2_bpe"](spark, SF)).itertuples(), docs.text):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_decoding_takes_the_ids(spark):
    docs = spark.createDataFrame([(le([7, 300, 7]),), (b"",), (None,)], "ids binary")
    got = [r.t for r in docs.select(bpe.decoded(F.col("ids"), WORD_VOCABULARY).alias("t")).collect()]
    lib = library(WORD_VOCABULARY)
    assert got == [lib.decode([7, 300, 7], skip_special_tokens=False), "", None]


def test_long_words_merge_alike():
    merges, r = bpe.codec(WORD_VOCABULARY).merges, random.Random(1)
    words = [bytes(r.choices(b"abcdethin\xc3\xa9", k=r.randint(1, 48))) for _ in range(3000)]
    assert [le(merges.long_word(w)) for w in words] == merges.words(words)


def test_lines_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got, want = table(QUERIES["op3_line_dedup"](spark, "/root/testdata/sf0.01")), con.execute(ORACLES["op3_line_dedup"]).df().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def test_hot_lines_over_many_tasks(spark):
    texts = [f"hot line\nown {i}\n HOT line " + ("\nrare" if i < 9 else "") + ("\nten" if i < 10 else "") for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    from quillstone.llm.common import row_key

    keyed = df.select("*", *row_key("doc_id", "text"))
    for partitions in (1, 3, 40):
        assert line_dedup.dropped_lines(keyed, 10, partitions=partitions).count() == 1200 + 10
        assert line_dedup.dropped_lines(keyed, 10, keep_first=True, partitions=partitions).count() == 1200 + 10 - 2
    kept = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS))
    assert {r.text for r in kept.filter("doc_id < 9").collect()} == {f"own {i}\nrare" for i in range(9)}


def test_licenses(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "Licensed under the Apache License, Version 1.1."), (3, "Released under the MIT License. "), (4, "my licence to kill"), (5, None)]
    got = {r.doc_id: (r.license, r.confirmed, r.start) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Apache-2.0", True, 0), 2: (None, False, 0), 3: ("MIT", True, 0), 4: (None, False, 0)}


def test_planted_licenses(spark):
    """Every wording in every layout among prose, brute force: the plain words of a wording are in the text or not."""
    r, rows, want = random.Random(6), [], {}
    fill = lambda t: t.replace("*", "Jane Doe and the Example Corp")
    layouts = [lambda t: t, lambda t: textwrap.fill(t, 80), lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 60)), lambda t: "\n".join("# " + x for x in textwrap.wrap(t.upper(), 72))]
    all_of = [(name, fill(t)) for name, ts in licenses.TEMPLATES.items() for t in ts]
    prose = lambda n: "\n".join(" ".join(f"w{r.randrange(999)}" for _ in range(12)) for _ in range(n))
    for i in range(240):
        some = r.sample(all_of, r.choice([0, 1, 1, 2]))
        rows.append((i, "\n".join([prose(3), *(x for _, t in some for x in (r.choice(layouts)(t), "", prose(r.choice([0, 1, 400])))), prose(2)])))
        want[i] = {n for n, _ in some}
    rows += [(1000 + k, " ".join(w for j, w in enumerate(t.split()) if j != len(t.split()) // 2)) for k, (_, t) in enumerate(all_of) if len(t.split()) > 8]  # a word is missing
    for i, text in rows:
        plain = f" {' '.join(licenses.words_of(text))} "
        inside = {name for name, t in all_of if f" {' '.join(licenses.words_of(t))} " in plain}
        assert i >= 1000 or want[i] <= inside
        want[i] = inside
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("confirmed").toPandas()
    found = got.groupby("doc_id").license.agg(set).to_dict()
    assert {i: found.get(i, set()) for i in want} == want


#: Texts as they stand in the wild, written apart from the operator's wordings, and what they are.
WILD = [
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy", {"GPL-3.0"}),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", {"Apache-2.0"}),
    ("/*\n * zlib.h\n *\n *  This software is provided 'as-is', without any express or implied\n *  warranty.  In no event will the authors be held liable for any damages\n *  arising from the use of this software.\n *\n *  Permission is granted to anyone to use this software for any purpose,\n *  including commercial applications, and to alter it and redistribute it\n *  freely, subject to the following restrictions:\n */", {"Zlib"}),
    ("// This program is free software; you can redistribute it and/or modify\n// it under the terms of version 2 of the GNU General Public License as\n// published by the Free Software Foundation.", {"GPL-2.0-only"}),
    ("Copyright (c) 2004, A. N. Other\n\nPermission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", {"ISC"}),
    ("This is not released under the MIT License. All rights reserved.", set()),
    ("It was never licensed under the MIT License.\nThe old code, however, was\nreleased under the MIT License.", {"MIT"}),
    ("GNU General Public License, version 4 doesn't exist; see the free software list.", set()),
]


@pytest.mark.parametrize("text, want", WILD)
def test_licenses_in_the_wild(spark, text, want):
    ranker = licenses.Ranker(licenses.TEMPLATES)
    assert {name for start, _, block in licenses.blocks(text) for name, *_, sure in ranker.licenses(block, 0, licenses.Line(text), start) if sure} == want


def test_long_blocks_and_gaps_follow_the_same_rules():
    """Neither a block's length nor that of a line or a list of names changes an answer."""
    ranker, r = licenses.Ranker(licenses.TEMPLATES), random.Random(1)
    mit = licenses.TEMPLATES["MIT"][-1].split()
    for times in (1, 80):
        words = mit * times
        r.shuffle(words)
        assert not ranker.licenses(" ".join(words), 1)[0][4]
        one_less = " ".join(mit[:40] + mit[41:])
        assert [x[0] for x in ranker.licenses(" ".join([one_less, *(f"w{i}" for i in range(90 * times))]), 1) if x[4]] == ["MIT"]
    bsd = licenses.TEMPLATES["BSD-3-Clause"][-1].replace("*", " ".join(f"Name{i}" for i in range(3000)))
    for text in (bsd, bsd + " " + " ".join(f"w{i}" for i in range(600)), "x " * 9000 + bsd + " y" * 9000):
        assert {x[0] for start, _, block in licenses.blocks(text) for x in ranker.licenses(block, 0, licenses.Line(text), start) if x[4]} == {"BSD-3-Clause"}


def test_difference_is_the_cheapest_alignment():
    def brute(words, wanted):
        best = None
        for a in range(len(words) + 1):
            for b in range(a, len(words) + 1):
                row = [*range(len(wanted) + 1)]
                for w in words[a:b]:
                    new = [row[0] + 1]
                    for j, t in enumerate(wanted):
                        new.append(min(new[j] + 1, row[j + 1] + 1, row[j] if w == t else 10**6))
                    row = new
                best = row[-1] if best is None else min(best, row[-1])
        return best

    r = random.Random(9)
    for _ in range(30):
        wanted, words = r.choices("abcd", k=6), r.choices("abcd", k=r.randrange(9))
        assert licenses.Template("x", " ".join(wanted), 3).difference(words) == brute(words, wanted)


def test_number_parts_of_any_length():
    """Leading zeros don't count; longer parts than Python reads as numbers fail no text."""
    assert pii.base_spans("1.2.3." + "0" * 5000) == [(0, 1, 5006)] and pii.base_spans("1.2.3." + "7" * 5000) == []


def test_intermediates_go(spark, tmp_path):
    """What a stage leaves in the shared folder, beside its output, is keys of what stays and bitmaps of what goes."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    tables = lambda: {x for x in os.listdir(base) if x.startswith("quillstone-")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, most in (("line_dedup", 1), ("simhash_near_dedup", 1)):
        before = tables()
        dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).write.parquet(f"{tmp_path}/{stage}")
        assert len(tables() - before) == most
    before = tables()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(tables() - before) == 3  # beside those, the text that the last stage reads


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(texts, items):
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    for text in texts:
        w, hit, ids = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= {*range(k, k + n)}
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_decontamination(spark, docs, block):
    bench = pd.concat([pd.read_parquet(f"{SF}/benchmark.parquet"), pd.DataFrame({"item_id": [900, 901, 901], "text": ["Of the", "é 9", None]})])
    df = decontaminate.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(bench), block_chars=block)
    rows = table(df)
    got = rows[["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]]
    assert [*map(tuple, got.itertuples(index=False))] == [*contamination(docs.text, bench.itertuples(index=False))]
    for text, n, hits in zip(docs.text, rows.n_hit, rows.hits):  # the places hold the words that are hit, and no others
        spans = [tuple(map(int, h.split(":"))) for h in hits.split(",") if h]
        assert spans == sorted(spans) and sum(len(WORD.findall(text[a:b].translate(LOWER))) for a, b in spans) == n


def test_hits_map_to_the_original(spark):
    text, item = "Zu — A,b C! é9 d.", [("1", "a B c É9")]
    block = __import__("pickle").dumps(next(decontaminate.blocks(item, 10, 99)))
    assert decontaminate.scan(text.encode(), block)[1] is None  # É isn't lower-cased
    block = __import__("pickle").dumps(next(decontaminate.blocks([("1", "a B c é9")], 10, 99)))
    n, mask, items = decontaminate.scan(text.encode(), block)
    assert (n, items) == (7, {"1"})  # zu, the dash (no ASCII sign), a, b, c, é9, d
    assert [text[a:b] for a, b in decontaminate.hit_spans(text, mask)] == ["A,b C! é9"]


def test_token_files(spark, docs, odd):
    lib = library(BYTE_VOCABULARY)
    at = 0
    for row, text in zip(table(QUERIES["op6_token_output"](spark, SF)).itertuples(), docs.text):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(le(ids)))
        at += len(ids)
    path = shared_dir(spark)
    token_store.write_tokens(odd, BYTE_VOCABULARY, path, 2, files=3)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted([*range(len(ODD)), None, None, 3], key=lambda x: -1 if x is None else x)
    want = Counter((i, *lib.encode(t or "", add_special_tokens=False).ids, 2) for i, t in [*enumerate(ODD), (None, "no id"), (None, None), (3, "\n\n")])
    assert Counter((g.doc_id, *g.token_ids) for g in got) == want
    hot = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_store.write_tokens(hot, BYTE_VOCABULARY, path := shared_dir(spark), 2, files=4)
    files = spark.read.parquet(path).groupBy("file").count().collect()
    assert len(files) >= 3  # one doc_id is cut into several files
    ends = [(r.start, r.start + r.n_tokens) for r in token_store.read_tokens(spark, path).orderBy("start").collect()]
    assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])]


def test_token_layout(spark):
    """Dictionary pages for ids, delta for the counts, small row groups and pages with indexes; a read of a few documents skips the other row groups."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**6))
    token_store.write_tokens(docs, BYTE_VOCABULARY, path := shared_dir(spark), 2, files=1)
    (file,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
    meta = pq.ParquetFile(f"{path}/{file}").metadata
    assert meta.num_row_groups > 1 and all(meta.row_group(g).total_byte_size < 64 << 20 for g in range(meta.num_row_groups))
    columns = {meta.row_group(0).column(c).path_in_schema.split(".")[0]: meta.row_group(0).column(c) for c in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in columns["token_ids"].encodings and "DELTA_BINARY_PACKED" in columns["at"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    some = token_store.read_tokens(spark, path).filter("doc_id = 1000005")
    assert some.count() == 1
    scan = spark.read.schema(token_store.STORE).parquet(path).filter("doc_id = 1000005").select("token_ids")
    assert len(scan.collect()) == 1 and "GreaterThan" not in (plan := scan._jdf.queryExecution().executedPlan().toString()) and "EqualTo(doc_id,1000005)" in plan
    stats = [meta.row_group(g).column(1).statistics for g in range(meta.num_row_groups)]
    assert sum(x.min <= 1000005 <= x.max for x in stats) == 1  # sorted by doc_id: one row group holds it


def base_by_rules(text):
    def luhn(n):
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, n[::-1]))) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))


def test_personal_data(spark, docs):
    got = table(QUERIES["op7_pii"](spark, SF))
    for row, text in zip(got.itertuples(), docs.text):
        base = base_by_rules(text)
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert {*named} <= {*row.spans.split(",")} | {""} and [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choices("12.9 -+@a.b()", k=30))
        assert pii.base_spans(text) == base_by_rules(text)


def test_tagger_finds_other_forms(spark):
    """Trained on even documents, held against texts of odd ones that no even document has, spans in other forms, with other digits."""
    frame = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    even = {*frame.text[frame.doc_id % 2 == 0]}
    tagger = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0"))
    r, texts, want = np.random.default_rng(5), [], []
    for text in sorted({*frame.text[frame.doc_id % 2 == 1]} - even):
        for a, kind, b in pii.base_spans(text):
            start = max(0, a - 60)
            part = text[start : b + 60]
            spans = [(x, k, y) for x, k, y in pii.base_spans(part) if (x, k, y) == (a - start, kind, b - start)]
            others = [s for s in pii.base_spans(part) if s not in spans]
            if spans and not others:
                plain = part if kind == 2 else pii.other_digits(part, spans, r)  # a card keeps its checksum
                new, moved = pii.rewritten(plain, spans, int(r.integers(100)))
                texts.append(new)
                want.append({*moved})
    base = [pii.base_spans(t) for t in texts]
    got = [{*more} for more in pii.added_spans(tagger, texts, base)]
    for kind in range(4):
        hits = sum(s in g for g, w in zip(got, want) for s in w if s[1] == kind)
        asked, found = (sum(s[1] == kind for x in y for s in x) for y in (want, got))
        assert asked >= 20 and hits >= 0.9 * asked and hits >= 0.9 * found, (pii.KINDS[kind], hits, asked, found)


def test_marginals_are_the_sums_over_paths():
    r, t = np.random.default_rng(1), pii.Tagger()
    ids = r.integers(0, 128, (1, 4))
    u, trans = t.emit(ids)[0][:, 0], t.p["T"]
    paths = {p: np.exp(sum(u[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in product(range(pii.TAGS), repeat=4)}
    total, best = sum(paths.values()), max(paths, key=paths.get)
    tags, sure = t.decode(ids)
    assert tuple(tags[0]) == best
    assert np.allclose(sure[0], [sum(v for p, v in paths.items() if p[i] == best[i]) / total for i in range(4)])


@pytest.mark.parametrize("per_kind", [3, 10**6])
def test_sample_has_the_least_hashes_of_each_kind(spark, per_kind):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    snippets = {(kind, text[max(0, a - 40) : b + 40]) for (text,) in docs.select("text").collect() for a, kind, b in pii.base_spans(text)}
    got = [t for t, spans in pii.labelled(docs, per_kind) if spans]
    keyed = spark.createDataFrame(sorted(snippets), "kind int, snippet string").withColumn("h", F.xxhash64("snippet")).collect()
    want = [r.snippet for k in range(4) for r in sorted((r for r in keyed if r.kind == k), key=lambda r: (r.h, r.snippet))[:per_kind]]
    assert Counter(got) == Counter(want)


def test_gradient():
    r = np.random.default_rng(0)
    t, ids, tags = pii.Tagger(), r.integers(0, 128, (2, 6)), r.integers(0, pii.TAGS, (2, 6))

    def loss():
        u, _ = t.emit(ids)
        trans, total = t.p["T"], 0.0
        for b in range(2):
            alpha = u[0, b]
            for k in range(1, 6):
                alpha = u[k, b] + np.log(np.exp(alpha[:, None] + trans).sum(0))
            total += np.log(np.exp(alpha).sum()) - sum(u[k, b, tags[b, k]] for k in range(6)) - sum(trans[tags[b, k], tags[b, k + 1]] for k in range(5))
        return total / 2

    grad = t.step(ids, tags)
    for name, p in t.p.items():
        at = tuple(r.integers(0, n) for n in p.shape) if name != "E" else (int(ids[0, 2]), 1)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6


def fingerprint(text):
    words = [w for w in BLANK.split((text or "").translate(LOWER)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(bits, near=3):
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(bits)):
        for j in range(i):
            if (int(bits[i]) ^ int(bits[j])).bit_count() <= near:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def test_simhash_query(spark, docs):
    got = table(QUERIES["op8_simhash"](spark, SF))
    bits = [fingerprint(t) for t in docs.text]
    assert list(got.fingerprint) == [f"{b:016x}" for b in bits]
    assert list(got.component_id) == [docs.doc_id[r] for r in roots(bits)]


@pytest.mark.parametrize("cell", [4096, 8])
def test_planted_fingerprints(spark, cell):
    r = random.Random(cell)
    bits = [r.getrandbits(64) for _ in range(60)]
    for b in bits[:12]:
        for _ in range(25):
            for _ in range(r.randint(1, 3)):
                b ^= 1 << r.randrange(64)
            bits.append(b)
    bits = sorted({*bits, 0, (1 << 64) - 1, 7, 1 << 63})
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    nodes = spark.createDataFrame([(b,) for b in signed], "bits long")
    for near in (0, 1, 2, 3, 5):  # one to three parts of the axes
        links = simhash.near_links(nodes, near, cell_rows=cell)
        assert links.filter(f"bit_count(a ^ b) > {near}").isEmpty()
        got = {x.bits: x.root for x in simhash.components(links).collect()}
        want = roots(bits, near)
        groups = defaultdict(set)
        for b, w in zip(signed, want):
            groups[w].add(got.get(b, b))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_points_and_cells(spark):
    """Manhattan distance of segment counts by bits of unary points; of near pairs one lives in or visits a cell where the other lives; copies are bounded."""
    r = np.random.default_rng(4)
    bits = r.integers(0, 2**64, 200, dtype=np.uint64)
    near = bits ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for _ in bits], dtype=np.uint64)
    counts = lambda x: np.array([[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x])
    assert (np.bitwise_count(simhash.points_of(bits) ^ simhash.points_of(near)) == abs(counts(bits) - counts(near)).sum(1)).all()
    rows = pd.DataFrame({"bits": np.r_[bits, near].view(np.int64)}).drop_duplicates()
    nodes = spark.createDataFrame(rows)
    same = nodes.select("bits", simhash.points(F.col("bits")).alias("p")).toPandas()
    assert (same.p.to_numpy().view(np.uint64) == simhash.points_of(same.bits.to_numpy().view(np.uint64))).all()
    cells = simhash.cells(nodes, 3).toPandas()
    assert len(cells) <= 34 * len(rows)
    at = {b: {(t, c): v for t, c, v in zip(g.t, g.cell, g.visits)} for b, g in cells.groupby("bits")}
    for a, b in zip(bits.view(np.int64), near.view(np.int64)):
        assert any(v + at[b].get(cell, 2) <= 1 for cell, v in at[a].items())


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (2, "A b c D"), (2, "A b c D"), (None, "x y z w"), (None, "x y z w"), (5, "p q r s"), (5, "t u v w")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "a b c d"), (None, "x y z w"), (5, "p q r s"), (5, "t u v w")])


@pytest.mark.parametrize("partitions", [1, 5])
def test_first_lines_stay(spark, partitions):
    """Brute force: a key's first line by (doc_id, null first) stays in all rows equal to the first; repeated rows included."""
    r = random.Random(partitions)
    rows = [(r.choice([None, *range(12)]), "\n".join(r.choices("abcdef", k=r.randint(1, 6)))) for _ in range(60)]
    rows += rows[:15] + [(2, "x"), (2, "x"), (1, "x")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], COLUMNS).repartition(partitions)
    for min_docs in (2, 8):
        texts = Counter(rows)
        place = lambda d: (d[0] is not None, d[0] or 0)
        docs_of, first = defaultdict(int), {}
        for (d, t), n in texts.items():
            for k in {*t.split("\n")}:
                docs_of[k] += n
                if k not in first or place((d,)) < place((first[k],)):
                    first[k] = d
        got = Counter((x.doc_id, x.text) for x in line_dedup.dedup_lines(df, min_docs, keep_first=True).collect())
        left = defaultdict(set)  # the documents where a repeated key is left
        for d, t in got:
            for k in {*t.split("\n")} - {""}:
                left[k].add(d)
        assert sum(got.values()) == len(rows)
        for k, n in docs_of.items():
            if n >= min_docs:
                assert left[k] == {first[k]}
                assert max(t.split("\n").count(k) for d, t in got) == 1
            else:
                assert sum(c * t.split("\n").count(k) for (d, t), c in got.items()) == sum(c * t.split("\n").count(k) for (d, t), c in texts.items())


def test_several_blocks_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (1, "a b c d", 5, 6, 7), (2, "p q r", 1, 1, 1), (3, None, 0, 0, 0), (None, "x y", 2, 2, 2)], "doc_id long, text string, k1 int, k2 int, hits int")
    items = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "x y")], "item_id long, text string")
    for block in (2, 10**6):
        got = decontaminate.with_hits(docs, items, block_chars=block)
        assert {(r.doc_id, r.k1, r.k2, r.hits.n_words, tuple(r.hits.item_ids)) for r in got.collect()} == {(1, 5, 6, 4, ("1", "2")), (2, 1, 1, 3, ()), (3, 0, 0, 0, ()), (None, 2, 2, 2, ("3",))}
        assert got.count() == 5
        assert [(r.doc_id, r.k1, r.hits) for r in decontaminate.decontaminate(docs, items, block_chars=block).orderBy("doc_id").collect()] == [(2, 1, 1), (3, 0, 0)]


def figures(text):
    words = [w for w in BLANK.split(text or "") if w]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    hit = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if BLANK.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len({*lines}), len(hit)


def test_quality(spark, odd, docs):
    got = table(QUERIES["op9_quality"](spark, SF))
    assert [*map(tuple, got[quality.FIGURES].itertuples(index=False))] == [*map(figures, docs.text)]
    failed = (got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words)
    assert (got.base_failed == failed).all() and not got.kept[failed].any()
    odd_rows = quality.quality_rows(odd.filter("doc_id IS NOT NULL")).toPandas()
    assert sorted(map(tuple, odd_rows[quality.FIGURES].values)) == sorted(map(figures, [*ODD, "\n\n"]))


def test_quality_keeps_prose_and_drops_junk(spark):
    """Limits were set on the labels of even documents; these are the odd ones."""
    sf = "/root/testdata/sf0.1"
    rows = table(QUERIES["op9_quality"](spark, sf)).merge(pd.read_parquet(f"{sf}/labels.parquet"))
    rows = rows[~rows.base_failed & (rows.n_words >= 50) & (rows.doc_id % 2 == 1)]
    assert len(rows) > 1000 and rows[rows.quality == 1].kept.mean() > 0.995 and rows[rows.quality == 0].kept.mean() < 0.05


def test_quality_verdict_by_hand(spark):
    """Distances and verdicts against plain Python over all documents."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = table(QUERIES["op9_quality"](spark, "/root/testdata/sf0.01"))
    docs = docs.sort_values("doc_id", ignore_index=True)

    def shares(text, lang):
        words = [w for w in BLANK.split(text) if w]
        classes = [sum(bool(regex.match(p, c)) for c in text) for p in quality.CLASSES]
        wide, blank = len(text.encode()) - len(text), len(text) - sum(map(len, words))
        classes += [blank, wide, max(0, sum(map(len, words)) - sum(classes) - wide)]
        common = quality.COMMON.get(lang)
        found = Counter(w.lower().strip(quality.SIGNS) for w in words) if common else None
        known = [found[c] for c in common] if common else None
        return np.array(classes) / max(1, sum(classes)), known and np.array([*known, len(words) - sum(known)]) / max(1, len(words)), known and sum(known)

    made = [shares(t, lang) for t, lang in zip(docs.text, docs.lang)]
    base = got.base_failed.to_numpy()
    use = ~base & (got.n_words.to_numpy() >= 50)

    def js(p, q):
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        return np.sqrt(max(0, (part(p) + part(q)) / 2))

    for lang in quality.COMMON:
        rows = [i for i in range(len(docs)) if docs.lang[i] == lang]
        sound = [i for i in rows if use[i]]
        if not sound:
            continue
        c = np.mean([made[i][0] for i in sound], axis=0)
        w = np.mean([made[i][1] for i in sound], axis=0) if sum(made[i][2] for i in sound) >= 50 else None
        for i in rows:
            if got.n_words[i] >= 50:
                a, b = js(made[i][0], c), 0 if w is None else js(made[i][1], w)
                assert abs(a - got.class_distance[i]) < 1e-6 and (w is None or abs(b - got.word_distance[i]) < 1e-6)
                far = a > 0.3 or b > 0.36 or a > 0.12 and b > 0.16 + 1.5 / np.sqrt(got.n_words[i])
                assert got.kept[i] == (not base[i] and not far)


def test_js_distance(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(quality.js_distance(a(1.0, 0.0), a(0.0, 1.0)).alias("far"), quality.js_distance(a(0.5, 0.5), a(0.5, 0.5)).alias("same")).first()
    assert abs(r.far - 1) < 1e-9 and r.same == 0


def test_count_trees_follow_edits(docs):
    lib, r = library(BYTE_VOCABULARY), random.Random(5)
    bits = [" ", "  ", "\n", "a", "É", ". ", "9", "!", " x", "\n\n", "", "word", "\t", "'s", " \n", "<|", "endoftext|>", "<|endoftext|>", "\x1c", "　", "\x85", "你好", "。", ",", "\r\n", "天地玄黄，宇宙洪荒。" * 9]
    for k, text in enumerate([*docs.text[:25].str[:500], *(t or "" for t in ODD), "def f():\n    return  1\n\n\n        if x:\n            pass\n" * 20, "word,word." * 60]):
        tree, now = count_trees.CountTree(text, BYTE_VOCABULARY), text
        if k % 2:  # from kept counts
            tree = count_trees.CountTree(text, BYTE_VOCABULARY, count_trees.unpacked(count_trees.packed(tree.counts())))
        for _ in range(12):
            a = r.randint(0, len(now))
            b, new = min(len(now), a + r.choice([0, 0, 1, 2, 5, 20, 200])), "".join(r.choices(bits, k=r.choice([0, 1, 2, 3, 40])))
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert tree.text() == now and tree.n_tokens == tree.counts().sum() == len(lib.encode(now, add_special_tokens=False).ids)


@pytest.mark.parametrize("odd", ["", "  ", "\n\n    ", " \n", "<|endoftext|>", "\t\t"])
def test_uneven_texts_have_small_leaves(odd):
    words = " ".join(f"w{i}" for i in range(8000))
    text = words + odd + words
    tree = count_trees.CountTree(text, BYTE_VOCABULARY)
    before, tree.encoded = tree.n_tokens, 0
    for k in range(200):
        tree.edit(400 * k, 400 * k + 1, "!")
    assert tree.encoded < 200 * 40 and before == len(library(BYTE_VOCABULARY).encode(text).ids)
    assert tree.n_tokens == len(library(BYTE_VOCABULARY).encode(tree.text()).ids)


def test_edits_touch_little(spark, docs):
    got = table(QUERIES["op10_token_counts"](spark, SF))
    lib = library(BYTE_VOCABULARY)
    for row, text in zip(got.itertuples(), docs.text):
        now = text
        for a, b, m in count_trees.mask_edits(text):
            now = now[:a] + m + now[b:]
        assert row.n_tokens == len(lib.encode(text, add_special_tokens=False).ids) and row.n_tokens_after == len(lib.encode(now, add_special_tokens=False).ids)
        assert row.edited_sha256 == hashlib.sha256(now.encode()).hexdigest() and row.n_encoded_chars <= 60 * max(1, row.n_edits)
    kept = spark.createDataFrame([("ab cd 12 34",)], "text string").withColumn("t", count_trees.count_trees(F.col("text"), BYTE_VOCABULARY))
    again = kept.select(count_trees.recounted(F.col("text"), count_trees.masking("text"), BYTE_VOCABULARY, F.col("t.leaves")).alias("r")).first().r
    assert again.n_edits == 2 and again.n_tokens == len(lib.encode("ab cd 12 34").ids) and again.n_tokens_after == len(lib.encode("ab cd 0 0").ids)


def five(text):
    w = [x for x in BLANK.split(text.translate(LOWER)) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_roots(texts):
    """Components of the stage: fingerprints within three bits, or a Jaccard similarity of 0.8 or more on five words, over all pairs."""
    bits, sets = [fingerprint(t) for t in texts], [five(t) for t in texts]
    root, holders = list(range(len(bits))), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(i, j):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                join(i, j)
        shared = Counter(j for x in sets[i] for j in holders[x] if j < i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                join(i, j)
    return [find(i) for i in range(len(bits))]


def test_pipeline(spark):
    docs, sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs.toPandas(), stage(spark, docs, sf)
        got = after.toPandas()
        if name != "bpe_encoding":
            assert got.columns.tolist() == docs.columns
        if name == "quality_rules":
            kept = quality.quality_rows(docs).filter("kept").toPandas()
            assert {*got.doc_id} == {*kept.doc_id} and len(got) == len(kept)
        elif name == "line_dedup":
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            seen = Counter(k for t in before.text for k in {key(x) for x in t.split("\n")} if k)
            want = {d: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for d, t in zip(before.doc_id, before.text)}
            assert dict(zip(got.doc_id, got.text)) == want and (got.n_chars == got.text.str.len()).all()
        elif name == "simhash_near_dedup":
            b = before.sort_values("doc_id", ignore_index=True)
            assert {*got.doc_id} == {b.doc_id[r] for r in near_roots(b.text)}
        elif name == "benchmark_decontamination":
            bench = pd.read_parquet(f"{sf}/benchmark.parquet")
            clean = [d for d, c in zip(before.doc_id, contamination(before.text, bench.itertuples(index=False))) if not c[-1]]
            assert {*got.doc_id} == {*clean}
        else:
            lib = library(WORD_VOCABULARY)
            for t, ids, dec in zip(got.text[:200], got.token_ids, got.decoded):
                want = lib.encode(t, add_special_tokens=False).ids
                assert bytes(ids) == le(want) and dec == lib.decode(want, skip_special_tokens=False)
            assert len(got) == len(before)
        docs = spark.createDataFrame(got) if name != "bpe_encoding" else docs


def test_near_duplicate_stage_finds_similar_texts(spark):
    r, texts = random.Random(8), []
    for n in [60, 100, 300, 900] * 10:
        own = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(own))
        for edits in (1, 2, n // 60, n // 45, n // 35, n // 12):  # similarities on both sides of 0.8
            copy = own[:]
            for k in r.sample(range(n), edits):
                copy[k] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))
    bits = [fingerprint(t) for t in texts]
    links = [(j, i) for i in range(len(texts)) for j in range(max(0, i - 7), i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (bits[i] ^ bits[j]).bit_count() <= 3]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert sum((bits[a] ^ bits[b]).bit_count() > 3 for a, b in links) > 50  # what three bits alone leave in
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS), "")
    assert {x.doc_id for x in got.collect()} == {*root} and len({*root}) > 60


@pytest.mark.parametrize("rows", [2048, 3])
def test_similar_links_over_parts(spark, rows):
    from quillstone.llm import jaccard
    from quillstone.llm.common import row_key

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(0, 200, 8)] + ["a b", "A  b", "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = df.select("doc_id", *row_key("doc_id", "text"), F.col("doc_id").alias("bits"), jaccard.sketches(F.col("text"), 5).alias("sketch"))
    links, _ = jaccard.similar_links(df, marked, cell_rows=rows)
    got = {x.bits: x.root for x in simhash.components(links).collect()}
    assert {got.get(i, i) for i in range(25)} == {0} and got[26] == 25 and 27 not in got and 28 not in got


@pytest.mark.parametrize("form", ["(at)", " at ", " @ "])
def test_mails_without_sign_have_windows(spark, form):
    words = "we meet at noon and write to nobody else about the plan of the house by the river " * 3
    for local in ("anna.berg", "a" * 90):
        mail = f"{local}{form}post.example.org"
        text = words + mail + " " + words
        a, covered = len(words), set()
        for s, first, last in pii.window_starts(text):
            covered |= {*range(s + (0 if first else 16), s + (64 if last else 48))}
        assert {*range(a, a + len(mail))} <= covered
    assert pii.window_starts(words) == []
    text = words + f"anna.berg{form}post.example.org" + " " + words
    a, b = len(words), len(words) + len(f"anna.berg{form}post.example.org")

    class Sure:
        def decode(self, ids):
            tags = np.zeros(ids.shape, dtype=np.int64)
            for row, out in zip(ids, tags):
                at = text.find("".join(map(chr, row)).rstrip("\0"))
                out[[k for k in range(pii.WINDOW) if a <= at + k < b]] = 2
                if a <= at + pii.WINDOW and at <= a:
                    out[a - at : a - at + 1] = 1
            return tags, np.ones(ids.shape)

    assert pii.added_spans(Sure(), [text], [[]]) == [[(a, 0, b)]]
    seen = spark.createDataFrame([(text,)], "text string").filter(F.col("text").rlike(pii.SIGN)).count()
    assert seen == 1
