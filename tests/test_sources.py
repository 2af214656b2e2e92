"""Blobs, vault files, readers and row-wise ingestion."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files, ingest, readers

DOCS = "doc_id long, project_id string, title string, tags array<string>, body string"


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_blobs(spark, tmp_path):
    """Equal contents are one file, written once; a changed or lost file is told; what nobody names is swept."""
    root = f"file://{tmp_path}/blobs"
    rows = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"a"), (4, b""), (5, None)], "id long, content binary").repartition(4)
    refs = {r.id: r for r in files.put_blobs(rows, root).collect()}
    assert refs[1].sha256 == refs[3].sha256 and refs[4].size == 0 and refs[5].sha256 is None
    names = tree(f"{tmp_path}/blobs")
    assert names == sorted({files.place_of(r.sha256) for r in refs.values() if r.sha256})
    before = {n: os.stat(f"{tmp_path}/blobs/{n}").st_mtime_ns for n in names}
    files.put_blobs(rows, root)
    assert {n: os.stat(f"{tmp_path}/blobs/{n}").st_mtime_ns for n in tree(f"{tmp_path}/blobs")} == before
    with open(f"{tmp_path}/blobs/{files.place_of(refs[2].sha256)}", "wb") as f:
        f.write(b"other")
    os.remove(f"{tmp_path}/blobs/{files.place_of(refs[4].sha256)}")
    table = spark.createDataFrame([tuple(r) for r in refs.values()], files.REF)
    got = {r.id: (r.content, r.sound) for r in files.get_blobs(table, root).collect()}
    assert got == {1: (b"a", True), 2: (b"other", False), 3: (b"a", True), 4: (None, False), 5: (None, False)}
    assert files.sweep_blobs(table.filter("id = 1"), root) == 1 and tree(f"{tmp_path}/blobs") == [files.place_of(refs[1].sha256)]


def test_vault(spark, tmp_path):
    root = str(tmp_path / "vault")
    write = lambda rows: {r.path: r.state for r in files.write_vault_files(spark.createDataFrame(rows, DOCS), root, F.lit("2024-01-01").cast("timestamp")).collect()}
    rows = [(1, "p", "First Title", ["x"], "one"), (2, None, "Zweite Straße", None, None), (3, "a/b", None, [], "three"), (1000, "p", "First Title", ["x"], "one")]
    first = write(rows)
    assert set(first.values()) == {"missing"} and tree(root) == sorted(first) and "p/first-title--1.md" in first and any(p.startswith("shared/zweite-stra") for p in first)
    times = {n: os.stat(f"{root}/{n}").st_mtime_ns for n in tree(root)}
    assert set(write(rows).values()) == {"same"} and {n: os.stat(f"{root}/{n}").st_mtime_ns for n in tree(root)} == times
    second = write([(1, "p", "New Title", ["x"], "one"), (3, "a/b", None, [], "changed"), (1000, "p", "First Title", ["x"], "one")])
    assert second["p/first-title--1.md"] == "orphan" and second["p/new-title--1.md"] == "missing" and [s for p, s in second.items() if p.endswith("/3.md")] == ["stale"] and second["p/first-title--1000.md"] == "same"
    trash = open(f"{root}/_trash/p/first-title--1.md").read()
    assert trash.startswith('---\ntitle: {"t":"First Title"}') and "deleteReason: orphaned\n---\none" in trash
    assert set(write([(1, "p", "New Title", ["x"], "one"), (3, "a/b", None, [], "changed"), (1000, "p", "First Title", ["x"], "one")]).values()) == {"same"}
    assert files.vault_state(spark.createDataFrame([], DOCS), str(tmp_path / "none")).isEmpty()


def test_listings_are_made_by_tasks(spark, tmp_path, monkeypatch):
    """The driver reads no folder: Spark's own file reader would hold each file's name there."""
    root = tmp_path / "deep"
    for name in ("a/1.md", "a/b/c/2.md", "3.md", "a/4.txt", "_trash/a/5.md", "a/.6.md", "a/_7.part", "x y/ü #%20.md", "x=1/8.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "empty").mkdir()
    monkeypatch.setattr(type(spark.read), "load", lambda *a, **k: pytest.fail("the driver lists files"))
    for address in (str(root), f"file://{root}", f"file://{root}/"):
        assert sorted(r.path for r in files.listing(spark, address, "*.md").select("path").collect()) == ["3.md", "a/1.md", "a/b/c/2.md", "x y/ü #%20.md", "x=1/8.md"]
    assert files.listing(spark, f"{root}/empty").isEmpty() and files.listing(spark, f"{root}/none").isEmpty()
    assert sorted(r.path for r in files.listing(spark, f"{root}/a").collect()) == ["1.md", "4.txt", "b/c/2.md"]
    docs = spark.createDataFrame([(1, "p", "T", ["x"], None), (2, "p", "T", None, "é")], DOCS)
    at = F.lit("2024-01-01").cast("timestamp")
    assert [sorted(r.state for r in files.write_vault_files(docs, str(tmp_path / "v"), at).collect()) for _ in range(2)] == [["missing"] * 2, ["same"] * 2]


def read(spark, data, mime=None, chain=None):
    r = readers.extracted(spark.createDataFrame([(bytearray(data) if data is not None else None, mime, "kept")], "content binary, mime string, text string"), chain).first()
    return r.status, r.text, r.detail


def stub(takes, status="done", text="x"):
    return readers.Reader(takes, lambda kind, content: readers.outcome(status, F.lit(text), "stub"))


def test_first_reader_wins(spark):
    chain = [stub(lambda m: m.startswith("text/"), text="first"), stub(lambda m: m == "text/plain", text="second")]
    assert read(spark, b"x", "text/plain", chain)[1] == "first"
    assert read(spark, b"x", "application/zip", chain) == ("unsupported", "", "application/zip")
    off = [readers.disabled("image/", "no vision provider configured")]
    assert read(spark, b"x", "image/jpeg", off) == ("skipped", "", "no vision provider configured")


@pytest.mark.parametrize("data, mime, want", [
    (b"plain words", None, ("done", "plain words", "text/plain")),
    (b"plain words", "TEXT/Markdown; charset=utf-8", ("done", "plain words", "text/markdown")),
    (b"<html><script>x</script><p>a &amp; b&#8217;s</p>", None, ("done", "a & b’s", "text/html")),
    (b'{"a": 1}', None, ("done", '{"a": 1}', "application/json")),
    (b'{"a": ', "application/json", ("done", '{"a": ', "not well-formed")),
    (b"a,b\n1,2", "text/csv", ("done", "a,b\n1,2", "text/csv")),
    (b"\xff\xfea\x00", "text/plain", ("done", "a", "text/plain")),
    (b"\xff\xfea\x00b", "text/plain", ("unsupported", "", "binary content")),
    (b"\x00\x01\x02" * 9, "text/plain", ("unsupported", "", "binary content")),
    (b"%PDF-1.7", "text/plain", ("skipped", "", "no reader of PDF")),
    (b"\x89PNG\r\n", None, ("skipped", "", "no reader of images")),
    (b"PK\x03\x04", None, ("unsupported", "", "application/zip")),
    (b"", None, ("done", "", "text/plain")),
    (None, "text/plain", ("failed", "", "no content")),
])
def test_readers(spark, data, mime, want):
    assert read(spark, data, mime) == want


def test_long_texts_are_cut_and_said_so(spark):
    assert read(spark, b"a" * 50, "text/plain", readers.chain(10)) == ("done", "a" * 10, "first 10 bytes")


def test_ingestion(spark):
    lines = [(1, '{"id": 1, "v": 2.0}'), (1, '{"id": null, "v": -1}'), (1, "{oops"), (1, '{"id": 2, "v": 3}}{'), (1, None), (1, '{"id": 3}'), (None, '{"id": 4, "v": 0}')] + [(2, f'{{"id": {i}, "v": 1}}') for i in range(10, 14)]
    schema, rules = "id long, v double", {"known": F.col("id").isNotNull(), "positive": F.col("v") >= 0}
    good, bad = ingest.ingested(spark.createDataFrame(lines, "batch long, line string"), schema, rules, 6)
    assert sorted(r.id for r in good.collect()) == [1, 4, 10, 11, 12, 13]
    assert sorted((r.line or "", r.broken) for r in bad.collect()) == [("", ["malformed"]), ('{"id": 2, "v": 3}}{', ["malformed"]), ('{"id": 3}', ["positive"]), ('{"id": null, "v": -1}', ["known", "positive"]), ("{oops", ["malformed"])]
    assert {r.rule: r.n for r in ingest.report(bad).collect()} == {"malformed": 3, "known": 1, "positive": 2}
    good, bad = ingest.ingested(spark.createDataFrame(lines, "batch long, line string"), schema, rules, 5)
    assert sorted(r.id for r in good.collect()) == [4, 10, 11, 12, 13] and bad.filter("array_contains(broken, 'batch_too_large')").count() == 6
    mended, rest = ingest.replayed(bad, F.replace("line", F.lit("{oops"), F.lit('{"id": 9, "v": 9}')), schema, rules)
    assert sorted(r.id for r in mended.collect()) == [1, 9] and rest.count() == 4
    none = ingest.ingested(spark.createDataFrame([], "batch long, line string"), schema, rules)
    assert none[0].isEmpty() and none[1].isEmpty()
