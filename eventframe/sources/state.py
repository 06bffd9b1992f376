"""State of jobs: tables that change together, each version named by one commit file.

A version's snapshots are complete before its commit file is made. The file is made
whole, and by one writer only: whoever finds the number taken raises ``StaleVersion`` and
has changed nothing. So there are no locks to hold, renew or take away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import folders

# Commit files that stay, so that a late writer finds its number taken.
KEPT_COMMITS = 50


class StaleVersion(RuntimeError):
    """Another writer has replaced the state since it was read."""


@dataclass(frozen=True)
class Head:
    """A version: the folders of its snapshots by table, and the batch of events that belongs to it."""

    version: int
    tables: dict[str, str] = field(default_factory=dict)
    batch: str | None = None


class JobState:
    """The tables of one job. A commit replaces some or all of them at once."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _commit_path(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def versions(self) -> list[int]:
        names = folders.children(self.spark, f"{self.path}/commits")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def head(self, version: int | None = None) -> Head | None:
        """The current version, or one that is kept; None before the first one."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        text = folders.read_text(self.spark, self._commit_path(version))
        if text is None:
            raise StaleVersion(f"{self.path}: version {version} is not kept")
        return Head(version, **json.loads(text))

    def load(self, table: str, schema: T.StructType, head: Head | None) -> DataFrame:
        """A table as of a version; empty if the version has none."""
        if head is None or table not in head.tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{head.tables[table]}")

    def stage(self, table: str, schema: T.StructType, snapshot: DataFrame, version: int) -> str:
        """Write a snapshot that no commit names yet; returns the name of its folder."""
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        columns = [snapshot[f.name].cast(f.dataType).alias(f.name) for f in schema]
        snapshot.select(*columns).write.parquet(f"{self.path}/{table}/{name}")
        return name

    def commit(self, version: int, tables: Mapping[str, str], base: Head | None, batch: str | None = None) -> Head:
        """Make staged snapshots current, all at once; tables that are not named stay as in ``base``.

        Raises ``StaleVersion`` if another writer has made this version or a later one.
        """
        head = Head(version, {**(base.tables if base else {}), **tables}, batch)
        text = json.dumps({"tables": head.tables, "batch": batch})
        known = self.versions()
        if known and known[-1] >= version or not folders.create(self.spark, self._commit_path(version), text):
            raise StaleVersion(f"{self.path}: version {version} comes too late")
        self._clean(head)
        return head

    def _clean(self, head: Head) -> None:
        """Delete what neither a kept version nor a writer of the next one needs."""
        known = self.versions()
        for old in known[:-KEPT_COMMITS]:
            folders.delete(self.spark, self._commit_path(old))
        heads = [head if v == head.version else self.head(v) for v in known[-self.keep :]]
        for table in head.tables:
            used = {h.tables.get(table) for h in heads}
            for name in folders.children(self.spark, f"{self.path}/{table}"):
                if name not in used and int(name.split("-")[0]) <= head.version:
                    folders.delete(self.spark, f"{self.path}/{table}/{name}")


class StateTable:
    """One table of a job's state, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 3, table: str = "rows"):
        self.spark, self.schema, self.table = spark, schema, table
        self.job = JobState(spark, path, keep)

    def version(self) -> int | None:
        """The current version; None before the first one."""
        known = self.job.versions()
        return known[-1] if known else None

    def load(self, version: int | None = None) -> DataFrame:
        """The current snapshot, or one of the versions that are kept."""
        return self.job.load(self.table, self.schema, self.job.head(version))

    def commit(self, snapshot: DataFrame, version: int) -> None:
        """Replace the table by its only writer; the current version committed again is left alone."""
        head = self.job.head()
        if head is not None and head.version >= version:
            if head.version == version:
                return
            raise StaleVersion(f"{self.job.path}: version {head.version} is current, {version} comes too late")
        self.job.commit(version, {self.table: self.job.stage(self.table, self.schema, snapshot, version)}, head)

    def swap(self, snapshot: DataFrame, expected: int | None) -> int:
        """Replace the snapshot that was read as version ``expected``; returns the new version.

        Raises ``StaleVersion`` if any other writer came first; nothing is changed then.
        """
        head = self.job.head()
        if (head.version if head else None) != expected:
            raise StaleVersion(f"{self.job.path}: version {expected} is no longer current")
        version = 0 if expected is None else expected + 1
        self.job.commit(version, {self.table: self.job.stage(self.table, self.schema, snapshot, version)}, head)
        return version
