"""Versions of tables, committed together. A commit is one small file that names each table's folder; it gets its place by a rename, after all it names has been written, so a reader sees
all of a commit or nothing of it, and what an interrupted writer left is named by none. Two writers of one place can't both commit: the second's rename fails."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "seq long, run string, step string, tables map<string,string>"


class Journal:
    """Tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._place("commits"))
        self._schemas: dict[str, object] = {}

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _last(self) -> int:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._place("commits"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def commits(self) -> DataFrame:
        """All commits: seq, run, step, tables."""
        n = self._last()
        return self.spark.read.schema(COMMIT).json([f"{self.path}/commits/{i}" for i in range(1, n + 1)]) if n else self.spark.createDataFrame([], COMMIT)

    def done(self, run: str) -> set[str]:
        """The steps of a run that were committed."""
        return {r.step for r in self.commits().filter(F.col("run") == run).select("step").collect()}  # a row a step

    def tables(self) -> dict[str, DataFrame]:
        """The tables as last committed."""
        n = self._last()
        named = self.spark.read.schema(COMMIT).json(f"{self.path}/commits/{n}").first()["tables"] if n else {}
        return {name: self._read(folder) for name, folder in named.items()}

    def _read(self, folder: str) -> DataFrame:
        """A table; a job looks up its schema once."""
        path = f"{self.path}/{folder}"
        df = self.spark.read.schema(self._schemas[folder]).parquet(path) if folder in self._schemas else self.spark.read.parquet(path)
        self._schemas[folder] = df.schema
        return df

    def commit(self, changed: dict[str, DataFrame], run: str, step: str) -> None:
        """Writes the changed tables as new versions and commits them with all others as they are."""
        n = self._last()
        named = dict(self.spark.read.schema(COMMIT).json(f"{self.path}/commits/{n}").first()["tables"]) if n else {}
        for name, df in changed.items():
            named[name] = f"tables/{name}-{n + 1}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.path}/{named[name]}")
            self._schemas[named[name]] = df.schema
        tried = f"commits/try-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n + 1, run, step, named)], COMMIT).coalesce(1).write.json(f"{self.path}/{tried}")
        if self._fs.exists(self._place(f"commits/{n + 1}")) or not self._fs.rename(self._place(tried), self._place(f"commits/{n + 1}")):
            raise RuntimeError(f"another writer has committed {n + 1} to {self.path}")

    def sweep(self) -> int:
        """Removes what the last commit doesn't name: former versions, and what interrupted writers left. How many folders went. No writer may be at work."""
        named = set(self.spark.read.schema(COMMIT).json(f"{self.path}/commits/{self._last()}").first()["tables"].values()) if self._last() else set()
        there = [f"tables/{x.getPath().getName()}" for x in self._fs.listStatus(self._place("tables"))] if self._fs.exists(self._place("tables")) else []
        tried = [f"commits/{x.getPath().getName()}" for x in self._fs.listStatus(self._place("commits")) if x.getPath().getName().startswith("try-")]
        gone = [x for x in there if x not in named] + tried
        for x in gone:
            self._fs.delete(self._place(x), True)
        return len(gone)
