"""Tables published by one commit.

A store is a folder of versions: every rebuild writes its files to folders of
a new version, and creating one empty file, ``_commits/<version>``, makes them
the current ones.  A file either is there or not, on HDFS, local disks and
object stores alike, so readers see the whole old tables or the whole new ones
whenever the writer stops, and all tables of one build change together.

    <base>/_commits/<version>          the last name is the current version
    <base>/<version>/...               files of a store of one table
    <base>/<table>/<version>/...       files of a store of several tables

Nothing is renamed or overwritten.  The version before the current one stays
until the next commit, so a query that has begun on it ends well.  Versions
number upwards; of two writers at once the later number wins, and equal
numbers are ordered by a random part.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A version's folder that was never committed is removed after this time.
ABANDONED_SECONDS = 7 * 24 * 3600
COMMITS = "_commits"


class Store:
    """The published versions under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Committed versions, the current one last."""
        return sorted(s.getPath().getName() for s in self._found(f"{COMMITS}/v*"))

    def current(self) -> str | None:
        return next(reversed(self.versions()), None)

    def path(self, version: str, table: str = "") -> str:
        return f"{self.base}/{table}/{version}" if table else f"{self.base}/{version}"

    def begin(self) -> Pending:
        last = self.current()
        number = int(last[1:9]) + 1 if last else 1
        return Pending(self, f"v{number:08d}-{uuid.uuid4().hex[:12]}")

    def remove(self, version: str) -> None:
        """The version's files of every table, then its commit."""
        for found in (version, f"*/{version}"):  # "*/" finds the commit as well, last by name order or not
            for s in self._found(found):
                if s.getPath().getParent().getName() != COMMITS:
                    self._fs.delete(s.getPath(), True)
        self._fs.delete(self._path(f"{self.base}/{COMMITS}/{version}"), False)

    def clean(self, keep: int = 1) -> None:
        """Remove all but the current version and ``keep`` before it, and what
        writers that stopped long ago have left."""
        committed = self.versions()
        for version in committed[: -keep - 1]:
            self.remove(version)
        oldest = (time.time() - ABANDONED_SECONDS) * 1000
        for pattern in ("v*", "*/v*"):
            for s in self._found(pattern):
                name = s.getPath().getName()
                if s.isDirectory() and _is_version(name) and name not in committed and s.getModificationTime() < oldest:
                    self._fs.delete(s.getPath(), True)

    def _found(self, pattern: str) -> list:
        return list(self._fs.globStatus(self._path(f"{self.base}/{pattern}")) or [])

    def _create(self, name: str) -> None:
        self._fs.create(self._path(f"{self.base}/{name}"), False).close()


class Pending:
    """A version that is being written.  As a context it is committed at the
    end, or its files are removed when the block fails."""

    def __init__(self, store: Store, version: str):
        self.store, self.version = store, version

    def path(self, table: str = "") -> str:
        return self.store.path(self.version, table)

    def write(self, df: DataFrame, table: str = "", partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
        w = df.write.mode("error").format(fmt)
        (w.partitionBy(*partition_by) if partition_by else w).save(self.path(table))
        return self.path(table)

    def commit(self, keep: int = 1) -> None:
        self.store._create(f"{COMMITS}/{self.version}")
        self.store.clean(keep)

    def abandon(self) -> None:
        self.store.remove(self.version)

    def __enter__(self) -> Pending:
        return self

    def __exit__(self, kind, *_) -> None:
        self.commit() if kind is None else self.abandon()


def _is_version(name: str) -> bool:
    return len(name) == 22 and name[0] == "v" and name[1:9].isdigit() and name[9] == "-"


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the current version of the table at ``path``: of a store
    of its own, or a table of the store above; ``path`` itself if neither has
    a commit (files that something else wrote)."""
    path = path.rstrip("/")
    above, _, name = path.rpartition("/")
    for store, table in ((Store(spark, path), ""), (Store(spark, above), name)):
        version = store.current()
        if version is not None:
            return store.path(version, table)
    return path
