"""Sinks of many files, written by tasks: a store of contents by hash, and a vault of one Markdown file a document.

Tasks write through pyarrow's file systems, so the root is any address that they open (file, hdfs, s3 and others). A file is written beside its place and moved there, so readers see whole files only, and a task
that runs again writes the same bytes to the same place. Listings and the files' hashes are made by tasks too, so the driver holds no file's name; what begins with an underscore or a dot is hidden from them."""

from __future__ import annotations

import fnmatch
import hashlib
import itertools
import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.sources.store import cut, exists

REF = "id long, sha256 string, size long"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def put_file(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """Whole or not at all."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part"
    with fs.open_output_stream(beside) as f:
        f.write(content)
    fs.move(beside, path)


def names(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, and whether they are folders; one by one where the system is local, else a folder's at a time."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as there:
            yield from ((x.name, x.is_dir()) for x in there)
    else:
        yield from ((x.base_name, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(folder)))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root) of the files there; none if there is no such folder. Folders are listed by tasks, one level after another."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = ((f"{folder}/{n}" if folder else n, d) for n, d in names(fs, f"{base}/{folder}" if folder else base) if not n.startswith(("_", ".")) and (d or fnmatch.fnmatchcase(n, pattern)))
                while part := [*itertools.islice(found, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([d for _, d in part], pa.bool_())], names=["path", "folder"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while not levels or not folders.isEmpty():
        level = cut(folders.repartition(parts, "path").mapInArrow(inside, "path string, folder boolean"))
        levels.append(level.filter("NOT folder").select("path"))
        folders = level.filter("folder").select("path")
    return reduce(DataFrame.unionByName, levels)


# ---- contents by hash ----


def place_of(sha256: str) -> str:
    """Sharded by the first two digits, so no folder holds them all."""
    return f"{sha256[:2]}/{sha256}"


def put_blobs(rows: DataFrame, root: str) -> DataFrame:
    """Stores contents (id, content), equal ones once, and gives id, sha256, size of each row. Equal contents meet before they are dealt; a content that is there already isn't written again.
    Null contents have no blob (sha256 null); empty ones have one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            new = []
            for sha, content in zip(batch.column("sha256").to_pylist(), batch.column("content")):
                path = f"{base}/{place_of(sha)}"
                fresh = fs.get_file_info(path).type == pafs.FileType.NotFound
                if fresh:
                    put_file(fs, path, content.as_py())
                new.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(new, pa.bool_())], names=["sha256", "fresh"])

    refs = rows.select(F.col("id").cast("long").alias("id"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content")
    once = refs.filter("content IS NOT NULL").groupBy("sha256").agg(F.first("content").alias("content"))
    cut(once.mapInArrow(write, "sha256 string, fresh boolean"))
    return refs.drop("content")


def get_blobs(refs: DataFrame, root: str) -> DataFrame:
    """refs (id, sha256, ...) with content, and whether the bytes read still have that hash: null content and false where the file is gone, false where it isn't what it was."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, contents = batch.slice(at, 200), []
                for sha in part.column("sha256").to_pylist():
                    path = f"{base}/{place_of(sha)}" if sha else None
                    there = path is not None and fs.get_file_info(path).type == pafs.FileType.File
                    contents.append(fs.open_input_stream(path).readall() if there else None)
                sound = [c is not None and hashlib.sha256(c).hexdigest() == sha for c, sha in zip(contents, part.column("sha256").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary()), pa.array(sound, pa.bool_())], names=[*part.schema.names, "content", "sound"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema)
    return refs.mapInArrow(read, f"{schema}, content binary, sound boolean")


def _removed(paths: DataFrame, root: str) -> int:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if fs.get_file_info(f"{base}/{path}").type == pafs.FileType.File:
                    fs.delete_file(f"{base}/{path}")
            yield batch

    return cut(paths.select("path").mapInArrow(remove, "path string")).count()


def sweep_blobs(refs: DataFrame, root: str) -> int:
    """Removes the contents that refs (sha256) don't name: how many."""
    there = listing(refs.sparkSession, root).select("path", F.substring_index("path", "/", -1).alias("sha256"))
    return _removed(there.join(refs.select("sha256").distinct(), "sha256", "left_anti"), root)


# ---- one file a document ----


def document_path(project: Column, title: Column, key: Column) -> Column:
    """project/slug--id.md; without a slug, the id alone. Titles may change, ids don't."""
    name = text.slug(F.coalesce(title, F.lit("")))
    stem = F.when(name != "", F.concat(name, F.lit("--"), key.cast("string"))).otherwise(key.cast("string"))
    return F.concat(text.path_segment(F.coalesce(project, F.lit("shared"))), F.lit("/"), stem, F.lit(".md"))


def document_text(title: Column, tags: Column, body: Column) -> Column:
    """Front matter and body."""
    head = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct(title.alias("t"))), F.lit("\ntags: "), F.coalesce(F.to_json(tags), F.lit("[]")), F.lit("\n---\n"))
    return F.concat(head, F.coalesce(body, F.lit("")))


def vault_state(docs: DataFrame, root: str) -> DataFrame:
    """path, state, document: what docs (doc_id, project_id, title, tags, body) should be in the vault against what is there: missing, stale (other bytes), same, or orphan (no document's)."""
    wanted = docs.select(document_path(F.col("project_id"), F.col("title"), F.col("doc_id")).alias("path"), document_text(F.col("title"), F.col("tags"), F.col("body")).alias("document")).filter("path IS NOT NULL")
    there = listing(docs.sparkSession, root, "*.md").select(F.col("path").alias("found"))
    both = wanted.join(there, F.col("path") == F.col("found"), "full_outer")
    state = F.when(F.col("path").isNull(), "orphan").when(F.col("found").isNull(), "missing")
    rows = both.select(F.coalesce("path", "found").alias("path"), state.alias("state"), "document")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            states = batch.column("state").to_pylist()
            for i, (path, state) in enumerate(zip(batch.column("path").to_pylist(), states)):
                if state is None:
                    same = fs.open_input_stream(f"{base}/{path}").readall() == batch.column("document")[i].as_py().encode()
                    states[i] = "same" if same else "stale"
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(states, pa.string()), batch.column("document")], names=["path", "state", "document"])

    return rows.mapInArrow(judged, "path string, state string, document string")


def write_vault_files(docs: DataFrame, root: str, at: Column, reason: str = "orphaned") -> DataFrame:
    """Brings the vault in line with docs: what is missing or stale is written, orphans (documents that went, or that moved as their title changed) go to _trash with the time and reason in their
    front matter. path, state as it was. A second run finds all the same and writes nothing. Two rows of one doc_id and title are one file, of either row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for path, state, document, when in zip(*(batch.column(c).to_pylist() for c in ("path", "state", "document", "at"))):
                live = f"{base}/{path}"
                if state in ("missing", "stale"):
                    put_file(fs, live, document.encode())
                elif state == "orphan" and fs.get_file_info(live).type == pafs.FileType.File:
                    old = fs.open_input_stream(live).readall().decode(errors="replace")
                    note = f"deletedAt: {when}\ndeleteReason: {reason}\n---\n"
                    put_file(fs, f"{base}/_trash/{path}", (old.replace("\n---\n", f"\n{note}", 1) if old.startswith("---\n") and "\n---\n" in old else f"---\n{note}{old}").encode())
                    fs.delete_file(live)
            yield batch.select(["path", "state"])

    once = vault_state(docs, root).groupBy("path").agg(F.min("state").alias("state"), F.min("document").alias("document"))
    once = once.withColumn("document", F.when(F.col("state").isin("missing", "stale"), F.col("document")))  # the others aren't written
    rows = cut(once).withColumn("at", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))  # judged before anything is written
    return cut(rows.mapInArrow(work, "path string, state string"))
