"""The resumable cycle: stops and goes on, marks, failures, each pass by hand."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import resume
from quillstone.sources import derive as D
from quillstone.sources.journal import Journal

SF = "/root/testdata/sf0.001"
DAY = "2024-03-01 00:00:00"


def frame(spark, name, rows, columns):
    """Rows of a table by the columns given; the others are null."""
    kinds = dict(c.strip().split(" ", 1) for c in resume.TABLES[name].split(", "))
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if kinds[c] == 'timestamp' else kinds[c]}" for c in columns))
    return resume.shaped(name, df)


def told(spark):
    """Episodes of two scopes with chunks, and facts from elsewhere."""
    episodes = frame(spark, "episodes", [(i, f"2024-01-0{i + 1} 00:00:00", None, "provisional", "p1" if i % 2 else None, "u1") for i in range(6)], ["episode_id", "recorded_at", "summary", "summary_kind", "project_id", "user_id"])
    said = ["Anna lives in Paris. Bob likes tea.", "Anna lives in Paris. Carl plays chess.", "Anna lives in Paris. Bob likes tea a lot.", None, "", "Dora sings. Dora sings. Eve reads."]
    chunks = frame(spark, "chunks", [(10 * i, i, 0, t) for i, t in enumerate(said)], ["chunk_id", "episode_id", "position", "text"])
    old = [(1, "Bob likes tea.", [0.0] * 3, "2023-01-01 00:00:00", "2023-01-01 00:00:00", 0.9, 0.9, 0, None, "u1"), (2, "Zoe runs.", [0.0] * 3, "2023-01-01 00:00:00", "2023-01-01 00:00:00", 0.9, 0.1, 0, None, "u1")]
    facts = frame(spark, "facts", old, ["fact_id", "content", "embedding", "valid_from", "recorded_at", "confidence", "importance", "reference_count", "project_id", "user_id"])
    return {"episodes": episodes, "chunks": chunks, "facts": facts.withColumn("embedding", resume.Parts().embed(F.col("content")))}


def now():
    return F.lit(DAY).cast("timestamp")


def contents(tables):
    """All tables as sets of rows, vectors rounded."""
    out = {}
    for name, df in tables.items():
        shown = [F.transform(c, lambda x: F.round(x, 6)).cast("string").alias(c) if t == "array<double>" else F.col(c) for c, t in df.dtypes]
        out[name] = sorted(map(str, df.select(*shown).collect()))
    return out


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    journal = Journal(spark, str(tmp_path_factory.mktemp("whole")))
    resume.begin(journal, told(spark))
    assert resume.run(journal, "one", now(), resume.Parts(synonym=0.5)) == [n for n, _ in resume.PASSES]
    return journal


def test_extraction_by_hand(spark, whole):
    t = whole.tables()
    facts = {r.fact_id: r for r in t["facts"].collect()}
    new = {r.content: r for r in facts.values() if r.fact_id > 2 and r.merged_from is None}
    # what a bucket knows isn't taken in again, in order of time; the other bucket learns it by itself
    assert sorted((r.content, r.episode_id) for r in new.values()) == [("Anna lives in Paris.", 1), ("Bob likes tea a lot.", 2), ("Carl plays chess.", 1), ("Dora sings.", 5), ("Eve reads.", 5)] or len([r for r in facts.values() if r.content == "Anna lives in Paris."]) == 2
    assert all(str(r.valid_from) < "2024-01-07" and str(r.recorded_at) == DAY and r.checked_at is not None for r in new.values())
    assert {r.key for r in t["marks"].filter("step = 'extraction'").collect()} == set(range(6))
    assert {r.summary_kind for r in t["episodes"].join(t["chunks"].filter("text IS NOT NULL").select("episode_id"), "episode_id").collect()} == {"full"}
    named = {r.entity for r in t["mentions"].collect()}
    assert {"anna", "paris", "carl", "dora", "eve"} <= named == {r.entity for r in t["entities"].collect()}
    assert ("anna", "paris") in {(r.src, r.dst) for r in t["relations"].collect()}
    assert t["events"].filter("kind = 'create'").count() == len([r for r in facts.values() if r.fact_id > 2 and r.merged_from is None])
    # pruned: of low importance and old; the important one became an insight, whose source is open
    assert facts[2].pruned_at is not None and facts[2].deleted_at is None and facts[1].pruned_at is None
    assert {r.insight_id for r in t["insights"].collect()} <= {1} | {r.fact_id for r in facts.values() if r.importance >= 0.85}


@pytest.mark.parametrize("stop", ["extraction", "consolidation", "retirement"])
def test_stopped_cycles_go_on(spark, whole, tmp_path, monkeypatch, stop):
    """A cycle that dies within a pass, after it has written tables, and is run again gives the tables of one run."""
    journal, parts = Journal(spark, str(tmp_path)), resume.Parts(synonym=0.5)
    resume.begin(journal, told(spark))

    def dies(work):
        def run(t, at, p):
            for name, df in work(t, at, p).items():
                df.write.parquet(f"{journal.path}/tables/{name}-0-torn")
            raise ConnectionError("lost")

        return run

    with pytest.raises(ConnectionError):
        resume.run(journal, "one", now(), parts, passes=[(n, dies(w) if n == stop else w) for n, w in resume.PASSES])
    again = Journal(spark, str(tmp_path))
    names = [n for n, _ in resume.PASSES]
    assert resume.run(again, "one", now(), parts) == names[names.index(stop) :]
    assert contents(again.tables()) == contents(whole.tables())
    assert resume.run(again, "one", now(), parts) == []  # nothing is left
    assert again.sweep() > 0 and contents(again.tables()) == contents(whole.tables())


def test_only_unmarked_episodes_are_read(spark, tmp_path):
    journal, asked = Journal(spark, str(tmp_path)), []

    def extract(groups):
        asked.append({r.episode_id for r in groups.select("episode_id").collect()})
        return resume.sentences(groups).withColumn("error", F.when(F.col("episode_id") == 1, "bad"))

    parts, passes = resume.Parts(extract=extract, batch=2, attempts=2), [p for p in resume.PASSES if p[0] == "extraction"]
    resume.begin(journal, told(spark))
    for name in "abcd":
        resume.run(journal, name, now(), parts, passes=passes)
    assert asked == [{0, 1}, {2}, {4, 5}, set()]  # 3 has no text; both it and 4 are marked without facts
    marks = {(r.key, r.attempts): r.next_at for r in journal.tables()["marks"].collect()}
    assert marks[1, 1] is not None and journal.tables()["facts"].filter("episode_id = 1").isEmpty()
    later = F.lit("2024-04-01").cast("timestamp")
    resume.run(journal, "e", later, parts, passes=passes)
    assert asked[-1] == {1} and journal.tables()["marks"].filter("key = 1 AND attempts = 2 AND next_at IS NULL").count() == 1
    resume.run(journal, "f", F.lit("2025-04-01").cast("timestamp"), parts, passes=passes)
    assert asked[-1] == set()  # attempts are used up


def test_deadline_leaves_the_later_passes(spark, tmp_path):
    journal, ticks = Journal(spark, str(tmp_path)), iter(range(100))
    resume.begin(journal, {})
    assert resume.run(journal, "x", now(), deadline_s=1, clock=lambda: next(ticks)) == ["summaries", "extraction"]
    assert all(df.isEmpty() for name, df in journal.tables().items())


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = Journal(spark, str(tmp_path)), Journal(spark, str(tmp_path))
    df = spark.createDataFrame([(1,)], "x int")
    a.commit({"t": df}, "r", "s")
    monkeypatch.setattr(b, "_last", lambda: 0)
    with pytest.raises(RuntimeError):
        b.commit({"t": df.limit(0)}, "r", "s")
    assert a.tables()["t"].count() == 1


def test_groups_carry_the_speaker(spark):
    said = ["USER(Anna): " + "a" * 60, "b" * 80, "ASSISTANT: c", "d" * 90]
    chunks = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(said)] + [(9, 2, 0, "no label at all"), (10, 2, 1, None)], "chunk_id long, episode_id long, position long, text string")
    got = {(r.episode_id, r.group): r.body for r in resume.groups(chunks, 25).collect()}
    note = "[continued mid-turn; current speaker: {}]\n\n{}"
    assert got == {(1, 0): said[0], (1, 1): note.format("USER(Anna)", said[1]), (1, 2): said[2], (1, 3): note.format("ASSISTANT", said[3]), (2, 0): "no label at all"}


def test_the_judge_decides(spark, tmp_path):
    """Clusters are merged as the judge says; too few members, empty and too long words don't count."""
    rows = [(i, f"word{i // 3} same thing", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 0.5 + i / 100, 0.5, i) for i in range(9)]
    facts = frame(spark, "facts", rows, ["fact_id", "content", "valid_from", "recorded_at", "confidence", "importance", "reference_count"])
    facts = facts.withColumn("embedding", F.when(F.col("fact_id") < 3, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(F.col("fact_id") < 6, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    mentions = frame(spark, "mentions", [(i, "e") for i in range(9)] + [(0, "f")], ["fact_id", "entity"])
    said = F.when(F.col("cluster") == 0, "one").when(F.col("cluster") == 3, "x" * 501).otherwise("three")
    judge = lambda c: c.filter("fact_id <> 2 AND fact_id < 7").select("cluster", "fact_id", said.alias("merged"))
    journal = Journal(spark, str(tmp_path))
    resume.begin(journal, {"facts": facts, "mentions": mentions})
    resume.run(journal, "x", now(), resume.Parts(judge=judge), passes=[p for p in resume.PASSES if p[0] == "consolidation"])
    t = journal.tables()
    new = t["facts"].filter("merged_from IS NOT NULL").collect()
    assert [(r.fact_id, r.content, r.merged_from, r.reference_count, round(r.confidence, 2)) for r in new] == [(9, "one", [0, 1], 1, 0.51)]
    assert {r.fact_id for r in t["facts"].filter("valid_to IS NOT NULL").collect()} == {0, 1}
    assert {r.entity for r in t["mentions"].filter("fact_id = 9").collect()} == {"e", "f"}


def test_passes_let_go_of_their_plans(spark, tmp_path, monkeypatch):
    """The driver is cleared before and after each commit; a writer looks up no schema that it wrote itself."""
    journal, cleared = Journal(spark, str(tmp_path)), []
    monkeypatch.setattr(resume, "release", lambda s: cleared.append(s))
    resume.begin(journal, {})
    passes = [p for p in resume.PASSES if p[0] in ("pruning", "retirement")]
    assert resume.run(journal, "x", now(), passes=passes) == ["pruning", "retirement"] and len(cleared) == 4
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert set(journal.tables()) == set(resume.TABLES)
    assert len(set(tracker.getJobIdsForGroup(None)) - before) <= 2  # the commit's file alone
    again = Journal(spark, str(tmp_path)).tables()
    assert {n: df.schema for n, df in journal.tables().items()} == {n: df.schema for n, df in again.items()}
