"""Loads that appear whole: tables in folders per load, and a manifest that is published last.

A load writes its rows of every table first, then one manifest. Readers see what the newest manifest names: all loads up to its
number in the append tables, and the listed folders of the tables that are replaced. What an interrupted load left
is not named by any manifest; the next try of the same load overwrites or ignores it. A load number that is
not later than the newest one is refused, so a repeated batch changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RefusedLoad(ValueError):
    """The load, or a later one, has been committed."""


@dataclass(frozen=True)
class Snapshot:
    """``load``: number of the last load. ``folders``: folders of each replaced table, in an order of the writer's own."""

    load: int = -1
    folders: dict[str, list[str]] = field(default_factory=dict)


class Commits:
    """Tables under ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path, self._rename = jvm.Path, jvm.Options.Rename
        configuration = spark._jsc.hadoopConfiguration()
        folder = self._path(f"{root}/_commits")
        self._files = folder.getFileSystem(configuration)
        self._context = jvm.FileContext.getFileContext(folder.toUri(), configuration)
        self._folder = folder

    def snapshot(self) -> Snapshot:
        if not self._files.exists(self._folder):
            return Snapshot()
        names = sorted(f.getPath().getName() for f in self._files.listStatus(self._folder))
        names = [n for n in names if n.startswith("load-")]
        if not names:
            return Snapshot()
        text = self.spark.read.text(f"{self.root}/_commits/{names[-1]}", wholetext=True).first()[0]
        return Snapshot(**json.loads(text))

    def _publish(self, snapshot: Snapshot) -> None:
        """The manifest becomes visible by a rename that fails where another writer was first."""
        aside = self._path(f"{self.root}/_commits/_writing-{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps({"load": snapshot.load, "folders": snapshot.folders}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        none[0] = self._rename.NONE
        self._context.rename(aside, self._path(f"{self.root}/_commits/load-{snapshot.load:019d}.json"), none)

    def begin(self, load: int) -> Load:
        seen = self.snapshot()
        if load <= seen.load:
            raise RefusedLoad(f"load {load} comes after load {seen.load}")
        return Load(self, seen, load)

    def read(self, name: str, schema: T.StructType, at: Snapshot | None = None) -> DataFrame:
        """Rows of an append table up to a snapshot, with their ``load``; empty before the first one."""
        at = at or self.snapshot()
        path = f"{self.root}/{name}"
        wide = T.StructType([*schema.fields, T.StructField("load", T.LongType())])
        if at.load < 0 or not self._files.exists(self._path(path)):
            return self.spark.createDataFrame([], wide)
        return self.spark.read.schema(wide).parquet(path).where(F.col("load") <= at.load)

    def read_folders(self, name: str, schema: T.StructType, at: Snapshot | None = None) -> DataFrame:
        """Rows of a replaced table."""
        folders = (at or self.snapshot()).folders.get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))


class Load:
    """One load's tables on the way; nothing is visible before ``commit``."""

    def __init__(self, commits: Commits, seen: Snapshot, load: int) -> None:
        self.commits, self.seen, self.number = commits, seen, load
        self.folders = dict(seen.folders)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes this load's rows and reads them back."""
        path = f"{self.commits.root}/{name}/load={self.number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def new_folder(self, name: str) -> str:
        return f"{name}/{self.number}-{uuid.uuid4().hex}"

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        folder = self.new_folder(name)
        rows.write.parquet(f"{self.commits.root}/{folder}")
        self.folders[name] = [folder]
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.commits.root}/{folder}")

    def commit(self) -> Snapshot:
        done = Snapshot(self.number, self.folders)
        self.commits._publish(done)
        return done
