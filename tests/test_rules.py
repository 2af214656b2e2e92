"""Closed-form values and invariants of the rules."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import scope, scoring, temporal, text, vectors
from quillstone.operators import chunking, consolidate, cycle, graph, lifecycle
from quillstone.sources import derive as D
from quillstone.sources import store

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scores(spark):
    r = one(spark, rec=scoring.recency(F.lit(30.0)), use=scoring.use(F.lit(10)), none=scoring.use(F.lit(0)), ret=scoring.retention(F.lit(10.0), F.lit(2), F.lit(0.5)), blend=scoring.fact_blend(*[F.lit(1.0)] * 5), pref=scoring.preference_blend(*[F.lit(1.0)] * 3), plain=scoring.plain_blend(F.lit(1.0), F.lit(0.0)), imp=scoring.derived_importance(F.lit(3.0), F.lit(1.0), F.lit(1.0)))
    assert r.rec == 0.5 and abs(r.use - 1) < 1e-12 and r.none == 0
    assert abs(r.ret - math.exp(-10 / 15)) < 1e-12 and abs(r.blend - 1) < 1e-12 and abs(r.pref - 1) < 1e-12 and abs(r.plain - 0.9) < 1e-12 and r.imp == 1.0


def test_cosine_guards(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    r = one(spark, same=vectors.cosine(a(3, 4), a(3, 4)), off=vectors.cosine(a(1, 0), a(0, 1)), zero=vectors.cosine(a(0, 0), a(1, 0)), unlike=vectors.cosine(a(1), a(1, 0)), idx=vectors.index_score(F.lit(-1.0)))
    assert abs(r.same - 1) < 1e-12 and (r.off, r.zero, r.unlike, r.idx) == (0, 0, 0, 0)


def test_scope_table(spark):
    want = {"boost": (1, 1, 1), "none": (1, 1, 1), "filter": (1, 1, 0), "strict": (0, 1, 0)}
    df = spark.createDataFrame([(None,), ("p1",), ("p2",)], "project_id string")
    for mode in want:
        got = [r.ok for r in df.select(scope.axis_allows(F.col("project_id"), "p1", mode).alias("ok")).collect()]
        assert got == [bool(x) for x in want[mode]]
    for unscoped, project in product((False, True), (None, "p1")):
        n = df.withColumn("user_id", F.lit("u")).filter(scope.same_bucket(project, "u", unscoped)).count()
        assert n == (1 if project is None or not unscoped else 2)


def test_intervals(spark):
    prefs = D.preferences(spark, SF)
    at = F.lit("2024-01-15").cast("timestamp")
    assert prefs.filter(temporal.valid_at(at)).groupBy("key").count().filter("count > 1").isEmpty()
    assert prefs.filter(~temporal.well_formed()).isEmpty()


def test_repeats_are_harmless(spark):
    f = D.facts(spark, SF)
    ids = f.filter("fact_id % 6 = 0")
    once = lifecycle.soft_delete(f, ids, D.now())
    again = lifecycle.soft_delete(once.drop("applied"), ids, D.now())
    assert again.filter("applied").isEmpty()
    assert once.select("fact_id", "valid_to", "deleted_at").exceptAll(again.select("fact_id", "valid_to", "deleted_at")).isEmpty()


def test_text(spark):
    r = one(spark, t=text.truncate(F.lit("abcdef"), 4), s=text.slug(F.lit(" Hello, World! ")), c=text.clip(F.lit("one two three"), 9), h=text.html_text(F.lit("<p>a&amp;b<script>x</script> c</p>")), p=text.path_segment(F.lit("ok")), k=text.fit_tokens(F.lit("aaaa bbbb cccc"), 2))
    assert (r.t, r.s, r.c, r.h, r.p, r.k) == ("abc…", "hello-world", "one two", "a&b c", "ok", "aaaa")


def test_rank_falls_with_distance(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert ranks["b"] > ranks["c"] > ranks["d"] > 0
    assert {r.node: r.root for r in graph.components(edges).collect()} == dict.fromkeys("abcd", "a")
    facts = spark.createDataFrame([(x,) for x in "abcd"], "fact_id string")
    assert {r.fact_id: r.step for r in graph.chain(facts, edges, spark.createDataFrame([("b",)], "node string")).collect()} == {"a": 1, "b": 0, "c": -1, "d": -2}


def test_long_chains_and_cycles_end(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 41)] + [(100, 101), (101, 100)], "src long, dst long")
    facts = spark.range(200).withColumnRenamed("id", "fact_id")
    start = lambda n: spark.createDataFrame([(n,)], "node long")
    assert {r.fact_id: r.step for r in graph.chain(facts, links, start(20)).collect()} == {i: i - 20 for i in range(41)}
    assert {r.fact_id for r in graph.chain(facts, links, start(100)).collect()} == {100, 101}
    assert graph.chain(facts, links, start(150)).count() == 1


def vectors_of(seed, n, dim=6, near=0.5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 6), dim))
    v = centres[r.integers(0, len(centres), n)] + near * r.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute_pairs(rows, least):
    """(id, other) to cosine of all pairs of a bucket, both ways round."""
    out = {}
    for i, v, p in rows:
        for j, w, q in rows:
            if i != j and p == q and np.linalg.norm(v) > 0 and np.linalg.norm(w) > 0 and (s := round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)) >= least:
                out[i, j] = s
    return out


def bucket_rows(seed, n=120):
    rows = [(i, v.tolist(), None if i % 3 == 0 else f"p{i % 3}") for i, v in enumerate(vectors_of(seed, n))]
    return rows + [(n, [0.0] * 6, None), (n + 1, rows[0][1], None), (n + 2, rows[0][1], "alone")]


VECTORS = "id long, embedding array<double>, project_id string"


@pytest.mark.parametrize("block", [2048, 7])
def test_near_pairs_are_all_pairs(spark, block):
    rows = bucket_rows(1)
    df = spark.createDataFrame(rows, VECTORS)
    for least in (0.9, 0.5, -0.2):
        want = brute_pairs(rows, least)
        got = consolidate.near(df, ["project_id"], least, consolidate._all, consolidate.PAIR, block=block).collect()
        assert {(r.left_id, r.right_id): r.score for r in got} == pytest.approx(want) and len(got) == len(want)
    best = {}
    for (i, j), s in brute_pairs(rows, 0.3).items():
        best.setdefault(i, []).append((-s, j))
    got = consolidate.nearest(df, ["project_id"], 0.3, 4, block=block).collect()
    assert {(r.left_id, r.right_id) for r in got} == {(i, j) for i, others in best.items() for _, j in sorted(others)[:4]}
    sided = consolidate.nearest(df.withColumn("side", (F.col("id") % 2).cast("int")), ["project_id"], 0.3, 1000, sided=True, block=block).collect()
    assert {(r.left_id, r.right_id) for r in sided} == {(i, j) for i, j in brute_pairs(rows, 0.3) if i % 2 == 0 and j % 2 == 1}
    assert consolidate.near(df.limit(0), ["project_id"], 0.5, consolidate._all, consolidate.PAIR).isEmpty()


@pytest.mark.parametrize("block", [2048, 7])
def test_clusters_are_the_greedy_pass(spark, block):
    for seed, most in ((2, 6), (3, 3)):
        rows = bucket_rows(seed)
        near, free, want = brute_pairs(rows, 0.8), {r[0] for r in rows}, {}
        for i in sorted(free):
            if i in free and (others := sorted((-near[i, j], j) for j in free if (i, j) in near)[: most - 1]):
                for j in (i, *(j for _, j in others)):
                    free.remove(j)
                    want[j] = i
        got = {r.id: r.cluster for r in consolidate.clusters(spark.createDataFrame(rows, VECTORS), ["project_id"], 0.8, most, block=block).collect()}
        assert got == want and len(want) > 30


def test_fresh_facts_are_the_ordered_pass(spark):
    rows = bucket_rows(4)
    new, live = [r for r in rows if r[0] % 4], [r for r in rows if r[0] % 4 == 0]
    near, kept = brute_pairs(rows, 0.85), []
    for i, _, _ in new:
        if not any((i, j) in near for j in [*kept, *(x[0] for x in live)]):
            kept.append(i)
    frame = lambda x: spark.createDataFrame(x, VECTORS)
    assert sorted(r.id for r in consolidate.fresh(frame(new), frame(live), ["project_id"], 0.85).collect()) == kept
    assert 5 < len(kept) < len(new)


def test_promotion_and_siblings(spark):
    v = [[1.0, 0.0], [0.99, 0.05], [0.0, 1.0], [0.02, 1.0]]
    facts = spark.createDataFrame([(i, x, "p", 0.9 if i else 0.95, None, None) for i, x in enumerate(v)], "id long, embedding array<double>, project_id string, importance double, valid_to timestamp, deleted_at timestamp")
    insights = spark.createDataFrame([(100, [1.0, 0.01], "p")], VECTORS)
    new, support = cycle.promote(facts, insights, ["project_id"])
    assert [r.id for r in new.collect()] == [2]
    assert {(r.insight_id, r.fact_id) for r in support.collect()} == {(100, 0), (100, 1), (2, 3)}
    pairs = facts.select("id", "embedding", "project_id")
    plain = {(r.new_id, r.old_id) for r in consolidate.supersede_candidates(pairs, ["project_id"]).collect()}
    told = pairs.withColumn("episode", F.when(F.col("id") < 2, 1))  # null episodes are nobody's siblings
    assert plain == {(1, 0), (3, 2)} and {(r.new_id, r.old_id) for r in consolidate.supersede_candidates(told, ["project_id"], source="episode").collect()} == {(3, 2)}
    asking = pairs.withColumn("asks", F.when(F.col("id") == 1, 1))
    assert {(r.new_id, r.old_id) for r in consolidate.supersede_candidates(asking, ["project_id"], asks="asks").collect()} == {(1, 0)}
    assert {(r.lo, r.hi) for r in consolidate.synonyms(asking, ["project_id"], 0.9, asks="asks").collect()} == {(0, 1)}
    chosen = consolidate.supersede_candidates(pairs, ["project_id"], decide=lambda found: found.groupBy("left_id").agg(F.max("score").alias("s")).filter("s > 0.9"))
    assert chosen.count() == 4


def test_packing_is_the_greedy_fold(spark):
    r = random.Random(3)
    rows = [(e, p, r.randint(1, 90)) for e in range(9) for p in range(r.randint(0, 30))] + [(50, 0, 500), (50, 1, 1)]
    want = {}
    for e in {x[0] for x in rows}:
        group = used = 0
        for _, p, n in sorted(x for x in rows if x[0] == e):
            if p and used + n > 120:
                group, used = group + 1, 0
            used += n
            want[e, p] = group
    r.shuffle(rows)
    got = consolidate.packed(spark.createDataFrame(rows, "episode_id long, position long, tokens long"), 120).collect()
    assert {(x.episode_id, x.position): x.group for x in got} == want


def test_cycle_stops_at_its_deadline(spark):
    t = cycle.Tables(D.facts(spark, SF), D.episodes(spark, SF).withColumn("summary", F.lit(None).cast("string")), D.chunks(spark, SF), D.mentions(spark, SF))
    ticks = iter([0, 1, 2, 9, 9, 9])
    passes = [(n, lambda t, now, hooks: t) for n in "abcd"]
    assert cycle.run(t, D.now(), deadline_s=5, passes=passes, clock=lambda: next(ticks)).done == ("a", "b")
    hooks = cycle.Hooks(extract=lambda chunks: chunks.select("chunk_id", F.lit(0).alias("nth"), F.upper("text").alias("content")), relate=lambda f, m: f.select(F.lit("x").alias("src"), F.lit("x").alias("dst"), F.lit(1.0).alias("confidence")))
    done = cycle.run(t, D.now(), hooks, passes=[p for p in cycle.PASSES if p[0] in ("extraction", "relations")])
    assert done.extracted.count() == D.chunks(spark, SF).count() and done.relations.isEmpty()


def test_long_texts_are_summarised_in_parts(spark):
    body = " ".join(f"w{i}" for i in range(40_000))
    texts = spark.createDataFrame([(1, body), (2, "short text"), (3, None), (4, "")], "id long, body string")
    got = {r.id: r.summary for r in cycle.summarised(texts, "id", "body", 64).collect()}
    assert got[2] == "short text" and got[4] == "" and 3 not in got and 0 < len(got[1]) <= 256


def test_empty_state_stays_empty(spark):
    f = D.facts(spark, SF).limit(0)
    assert lifecycle.snapshot(f, D.at()).isEmpty() and lifecycle.supersede(f, f.select(F.col("fact_id").alias("old_id"), F.col("valid_from").alias("new_from"))).isEmpty()
    assert lifecycle.soft_delete(f, f, D.now()).isEmpty() and lifecycle.merge(f, f.select(F.col("fact_id").alias("group"), "fact_id"), D.now())[0].isEmpty()
    v = spark.createDataFrame([], VECTORS)
    for op in (consolidate.duplicates, consolidate.synonyms, consolidate.clusters, consolidate.supersede_candidates):
        assert op(v, ["project_id"]).isEmpty()
    assert consolidate.fresh(v, v, ["project_id"]).isEmpty()
    edges = spark.createDataFrame([], "src string, dst string")
    assert graph.components(edges).isEmpty() and graph.pagerank(edges, spark.createDataFrame([], "node string")).isEmpty() and graph.overview(edges, edges.select(F.col("src").alias("node"), F.lit("k").alias("kind")), 3, 3)[0].isEmpty()


def test_chunks_fit_and_join():
    body = "One sentence here. Another one follows.\n\n" * 40 + "x" * 3000
    parts = list(chunking.split(body, 64, 8))
    assert "".join(t[n:] for t, n in parts) == body
    assert max(chunking.tokens(t) for t, _ in parts) <= 64


def test_files(spark, tmp_path):
    files = {
        "a.html": "<b>hi</b> there&#8217;s &#x27; &apos; &bogus; &amp;lt; &#0;".encode(), "b.bin": b"\0\1\2", "c.txt": b"P\n\0", "d.txt": "né".encode("utf-16"), "e.txt": b"\xfe\xff" + "né".encode("utf-16-be"),
        "f.txt": b"\xef\xbb\xbfplain", "g.bin": b"ok " * 10 + b"\xff" * 3, "h.txt": b"ok " * 100 + b"\xff", "i.txt": b"", "j.txt": b"tab\tand \x01",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in store.attachments(spark, str(tmp_path)).collect()}
    no = (None, "unsupported")
    assert got == {
        "a.html": ("hi there\u2019s ' ' &bogus; &lt; &#0;", "extracted"), "b.bin": no, "c.txt": no, "d.txt": ("né", "extracted"), "e.txt": ("né", "extracted"),
        "f.txt": ("plain", "extracted"), "g.bin": no, "h.txt": ("ok " * 100 + "\ufffd", "extracted"), "j.txt": ("tab\tand \x01", "extracted"),
    }


def test_path_segments_and_slugs(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:8]
    want = {"ok": "ok", "a.b_c-1": "a.b_c-1", "..": f"x-{h('..')}", ".": f"x-{h('.')}", "": f"x-{h('')}", "a//b": f"a__b-{h('a//b')}", ".a b": f"a_b-{h('.a b')}", "...": "..."}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", text.path_segment(F.col("t")).alias("s")).collect()}
    assert got == want
    slugs = {"Café au lait": "cafe-au-lait", "ﬁne Å": "fine-a", "日本": "", "--x--": "x", "a" * 80: "a" * 72, "word " * 30: "-".join(["word"] * 14)}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in slugs], "t string").select("t", text.slug(F.col("t")).alias("s")).collect()}
    assert got == slugs


def test_kinds_and_speakers(spark):
    r = spark.range(1).select(*(text.primary_kind(F.array(*map(F.lit, labels)), F.lit(stated), ("Fact", "Chunk")).alias(n) for n, labels, stated in (("a", ["MemoryItem", "Chunk"], None), ("b", ["X"], None), ("c", ["Fact"], "insight"))), text.speaks(F.lit("USER: hi")).alias("d"), text.speaks(F.lit("hi\nUSER: x")).alias("e")).first()
    assert tuple(r) == ("chunk", "unknown", "insight", True, False)


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        store.read_events(spark, str(tmp_path), "a long").collect()


def test_sessions_join_over_batches(spark, tmp_path):
    for i, minutes in enumerate([[0, 20, 200], [10, 45, 400], [60, 230]]):
        rows = [(m, 1) for m in minutes]
        spark.createDataFrame(rows, "m long, user_id long").select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "user_id").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    from quillstone.streaming import jobs

    for files in (1, 8):  # sessions that touch are one, within a batch and over batches
        got = jobs.sessions(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/b0").schema, "30 minutes", files).collect()
        assert sorted(r.n for r in got) == [1, 2, 5]


def test_answer_json(spark):
    answers = ["", None, "no json", "<think>[1]</think> {\"a\": [1, 2]} and more", "{\"a\": 1", "x <think>{\"a\": 1}", "```json\n[1]\n``` {\"b\": 2}"]
    got = spark.createDataFrame(list(enumerate(answers)), "i int, t string").select("i", text.answer_json("t").alias("j")).orderBy("i").collect()
    assert [r["j"] for r in got] == [None, None, None, '{"a":[1,2]}', None, None, "[1]"]


def test_last_speaker(spark):
    rows = [(0, None), (1, "hello"), (2, "USER: a\nASSISTANT: b"), (3, "ASSISTANT: a\nUSER(Ann B): b\nnot USER: c"), (4, "SYSTEM TRIGGER (CRON): x")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", text.last_speaker(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [None, None, "ASSISTANT", "USER(Ann B)", "SYSTEM TRIGGER (CRON)"]


def test_new_versions_leave_unchanged_and_dead_rows(spark):
    state = spark.createDataFrame([("a", 1, 1.0, False), ("a", 2, 2.0, True), ("b", 1, 3.0, True)], "key string, version long, value double, live boolean")
    got = lifecycle.new_versions(state, spark.createDataFrame([("a", 9.0), ("z", 1.0)], "key string, value double"), "key")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1.0, False), ("a", 2, 2.0, False), ("a", 3, 9.0, True), ("b", 1, 3.0, True)]


def test_patch_sets_to_null(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, c string")
    changes = spark.createDataFrame([(1, None, True), (2, "n", False), (9, "n", True)], "id long, c string, set_c boolean")
    assert sorted(map(tuple, lifecycle.patch(old, changes, "id", ["c"]).collect())) == [(1, None), (2, "y"), (3, None)]


def test_repeated_changes_multiply_no_rows(spark):
    state = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending"), (None, "pending")], "intention_id long, status string").withColumns({c: F.lit(None).cast("timestamp") for c in ("valid_to", "completed_at", "last_fired_at", "due_at")} | {"fired": F.lit(0)})
    changes = spark.createDataFrame([(1, "fired"), (1, "fired"), (2, "cancelled"), (2, "completed"), (3, "fired"), (3, "cancelled"), (None, "fired")], "intention_id long, change string")
    got = {r.intention_id: (r.fired, r.status) for r in cycle.moved_intentions(state, changes, D.now()).collect()}
    assert got == {1: (2, "pending"), 2: (0, "completed"), 3: (1, "cancelled"), None: (0, "pending")}
    episodes = spark.createDataFrame([(1, None, "provisional"), (2, "x", "full")], "episode_id long, summary string, summary_kind string")
    out = cycle.install_summaries(episodes, spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "episode_id long, summary string"))
    assert sorted(map(tuple, out.collect())) == [(1, "a", "full"), (2, "x", "full")]
    old = spark.createDataFrame([(1, 5, "t"), (2, 6, None), (None, 7, "n")], "id long, value long, tag string")
    new = spark.createDataFrame([(1, 8, None), (1, None, "u"), (1, 9, None), (3, 1, "w"), (None, 4, "z")], "id long, value long, tag string")
    assert sorted(map(tuple, lifecycle.upsert(old, new, "id").collect()), key=str) == sorted([(1, 9, "u"), (2, 6, None), (3, 1, "w"), (None, 7, "n"), (None, 4, "z")], key=str)
    twice = spark.createDataFrame([(1, 8, True), (1, None, True), (2, None, True), (2, 1, False), (9, 1, True)], "id long, value long, set_value boolean")
    assert sorted(map(tuple, lifecycle.patch(old, twice, "id", ["value"]).collect()), key=str) == sorted([(1, 8, "t"), (2, None, None), (None, 7, "n")], key=str)
    versions = spark.createDataFrame([("a", 1, 5, True)], "k string, version long, value long, live boolean")
    assert lifecycle.new_versions(versions, spark.createDataFrame([("a", 6), ("a", 7)], "k string, value long"), "k").count() == 2


def test_null_order_keys_go(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "at long, id long")
    assert [r.id for r in cycle.bounded_delete(rows, F.lit(True), ["at", "id"], 2).collect()] == [3]


def test_labels_of_kinds(spark):
    label = lambda kind, content, value=None: one(spark, x=text.label(F.lit(kind), F.lit(content), F.lit(7), F.lit(value))).x
    assert label("preference", "lang", "French") == "lang = French" and label("preference", "k", "v" * 50) == "k = " + "v" * 39 + "…" and label("preference", "k") == "k = "
    assert label("research", None, "what it says") == "what it says" and label("entity", None) == "7" and label("procedure", None) == "" and label("fact", None) == "" and label("odd", "x") == "7"


@pytest.mark.parametrize("data, want", [(b"\xff\xfea\x00b", "a�"), (b"\xff\xfe\x3d\xd8", "�"), (b"\xff\xfe\x00\xdca\x00", "�a"), (b"\xfe\xff\xd8\x3d\xde\x00\x00!", "\U0001f600!"), (b"\xfe\xff\xd8\x3d\xd8\x3d\xde\x00", "�\U0001f600"), (b"\xff\xfe", ""), (b"\xef\xbb\xbfa\xff", "a�"), (b"", ""), (b"\xfe\xff\x00", "�")])
def test_no_bytes_fail_decoding(spark, data, want):
    assert spark.createDataFrame([(bytearray(data),)], "content binary").select(store.decoded(F.col("content")).alias("t")).first().t == want


def test_streams_without_files(spark, tmp_path):
    from quillstone.streaming import jobs

    (tmp_path / "none").mkdir()
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    assert jobs.bucket_counts(spark, str(tmp_path / "none"), schema).count() == 0 and jobs.sessions(spark, str(tmp_path / "none"), schema).count() == 0


def _recall(spark, items, **parts):
    """A state over a few items of all the columns that recall needs."""
    from quillstone.operators import recall
    from quillstone.plans.kinds import ITEM, TYPES

    given = ["kind", "id", "content", "project_id", "importance", "confidence", "used", "entity_id"]
    rows = spark.createDataFrame(items, "kind string, id long, content string, project_id string, importance double, confidence double, used long, entity_id long, embedding array<double>")
    plain = {"redacted": F.lit(False), "live": F.lit(True), "seen_at": D.at(), "valid_from": F.lit("2020-01-01")}
    table = rows.select(*(F.col(c) if c in given else plain.get(c, F.lit(None)).cast(TYPES[c]).alias(c) for c in ITEM), "embedding")
    none = spark.createDataFrame([], "chunk_id long, fact_id long")
    asked = recall.Request([1.0, 0.0], "cats", D.now(), D.at(), **parts.pop("asked", {}))
    return recall, recall.State(asked, table, none, **parts)


def test_neighbours_go_by_position(spark):
    """Ids say nothing of places; other episodes' chunks aren't neighbours; the radius counts."""
    items = [("chunk", i, "x", None, None, None, None, None, [1.0, 0.0] if i == 70 else [0.0, 1.0]) for i in (70, 3, 99, 71, 5)]
    chunks = spark.createDataFrame([(70, 1, 4), (3, 1, 3), (99, 1, 5), (5, 1, 6), (71, 2, 5)], "chunk_id long, episode_id long, position long")
    recall, state = _recall(spark, items, chunks=chunks)
    found = spark.createDataFrame([("chunk", 70, 0.5, "vector")], "kind string, id long, fused double, sources string")
    near = lambda radius: {r.id: r.fused for r in recall.neighbours(recall._with(state, found), radius=radius).candidates.collect()}
    assert near(1) == pytest.approx({70: 0.5, 3: 0.15, 99: 0.15}) and near(2).keys() == {70, 3, 99, 5}


def test_research_needs_a_project(spark):
    items = [("research", 1, "x", "p1", None, None, None, None, [1.0, 0.0]), ("research", 2, "x", None, None, None, None, None, [1.0, 0.0]), ("knowledge_chunk", 3, "x", "p1", None, None, None, None, [1.0, 0.0])]
    for scopes, want in (({}, {3}), ({"project_id": "p1"}, {1, 2, 3})):
        recall, state = _recall(spark, items, asked={"kinds": ("research", "knowledge_chunk"), "scopes": scopes})
        assert {r.id for r in recall.vector_lists(state).candidates.collect()} == want


def test_rerank_keeps_within_the_context(spark):
    """The window is halved where its texts are too long; those reranked come first, the others follow by score."""
    items = [("fact", i, "word " * 20, None, 0.5, 0.5, 0, 1, [1.0, 0.0]) for i in range(8)]
    recall, state = _recall(spark, items)
    scored = recall._with(state, spark.createDataFrame([("fact", i, 1.0 - i / 10) for i in range(8)], "kind string, id long, score double"))
    asked = []

    def by(rows, words):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.col("id").alias("by"))

    order = lambda **k: [(r.id, r.promoted) for r in recall.top_k(recall.rerank(scored, by, **k)).candidates.orderBy("nth").collect()]
    assert order(window=4, keep=3) == [(3, True), (2, True), (1, False), (0, None), (4, None), (5, None), (6, None), (7, None)] and asked[-1] == [0, 1, 2, 3]
    assert [i for i, _ in order(window=4, context=100)] == [1, 0, 2, 3, 4, 5, 6, 7] and asked[-1] == [0, 1]
    assert order(window=4, chars=4, context=100)[0][0] == 3


def test_requests_are_embedded_as_texts_are(spark):
    from quillstone.operators import recall

    v = recall.request_vector(spark, "two cats two")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and recall.request_vector(spark, " ") == []
    row = spark.createDataFrame([("two cats two",), (None,), ("",)], "t string").select(vectors.hashed_words(F.col("t")).alias("v")).collect()
    assert row[0].v == v and row[1].v is None and row[2].v is None


def test_every_number_of_a_vector_is_given(spark, tmp_path):
    """All weights of all texts come out of hashed_vectors_all, not a digest of them; texts without words have none."""
    from quillstone.plans import records

    texts = ["two cats two", "Two\tCATS\x0btwo  two", None, "", " \n", " ".join(f"w{i}" for i in range(2000)), "ä\u00a0ö 語"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256 for w in re.split("[ \t\n\x0b\f\r]+", (t or "").lower()) if w)
        norm = math.sqrt(sum(n * n for n in counts.values()))
        want |= {(i, b): (round(n / norm, 6), 256, 1.0, round(max(counts.values()) / norm, 6)) for b, n in counts.items()}
    got = records.hashed_vectors_all(spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 256 and {(r.doc_id, r.bucket): (r.weight, r.dim, r.square, r.most) for r in got} == want


def counted_cuts(monkeypatch):
    calls = []
    monkeypatch.setattr(consolidate, "cut", lambda df: calls.append(1) or store.cut(df))
    return calls


def test_dense_buckets_take_few_rounds(spark, monkeypatch):
    """All near to each other: a fact a round would decide, as all have lesser ones within two links."""
    rows = [(i, [1.0, (i * 37 % 199) / 400, (i * 53 % 211) / 300], "p") for i in range(400)] + [(1000 + i, [1.0, 0.0, -0.5], "q") for i in range(90)]
    near, free, want = brute_pairs(rows, 0.5), {r[0] for r in rows}, {}
    for i in sorted(free):
        if i in free and (others := sorted((-near[i, j], j) for j in free if (i, j) in near)[:5]):
            for j in (i, *(j for _, j in others)):
                free.remove(j)
                want[j] = i
    df = spark.createDataFrame(rows, VECTORS)
    calls = counted_cuts(monkeypatch)
    for block, most in ((2048, 3), (40, 30)):
        calls.clear()
        assert {r.id: r.cluster for r in consolidate.clusters(df, ["project_id"], 0.5, block=block).collect()} == want and len(calls) <= most


def test_equal_facts_are_passed_in_one_round(spark, monkeypatch):
    """Many facts of the same words, and new ones among many open ones."""
    v = [[1.0, 0.0, 0.1 * k] for k in range(12)]
    new = [(i, v[i % 12], f"p{i % 3}") for i in range(300)]
    live = [(1000 + i, v[i % 4], "p1") for i in range(300)]
    near, kept = brute_pairs(new + live, 0.999), []
    for i, _, _ in new:
        if not any((i, j) in near for j in [*kept, *(x[0] for x in live)]):
            kept.append(i)
    frame = lambda x: spark.createDataFrame(x, VECTORS)
    calls = counted_cuts(monkeypatch)
    for block, most in ((2048, 3), (9, 30)):
        calls.clear()
        assert sorted(r.id for r in consolidate.fresh(frame(new), frame(live), ["project_id"], 0.999, block=block).collect()) == kept and len(calls) <= most
