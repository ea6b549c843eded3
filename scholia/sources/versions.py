"""Tables that change together: a batch is written aside, checked as a whole, and made visible by one commit.

A store is a folder. ``data`` holds what was written, never changed afterwards; ``commits`` one small file a version, which names the
data of each table. A commit's file is created only if it does not exist, which the file system decides in one step; so of two
writers that begin from one version one gets through, and a batch that fails its checks, or a driver lost half-way, leaves the old
version as it was. Readers hold the version that they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class Rejected(ValueError):
    """A batch that breaks a rule. ``faults`` holds the first of the violations, ``count`` their number."""

    def __init__(self, faults: list, count: int):
        super().__init__(f"{count} violations, the first of them: {faults[:3]}")
        self.faults, self.count = faults, count


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest version; 0 for a store that holds nothing yet."""
        system, path = self._files()
        if not system.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in system.listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Each table's folder at a version, the newest if none is given."""
        at = self.version() if version is None else version
        if at == 0:
            return {}
        system, path = self._files()
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{at:012d}")
        stream = system.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(version)[table])

    def commit(self, changed: dict[str, DataFrame], parent: int | None = None, check: Callable[[dict[str, DataFrame]], DataFrame] | None = None, adopt: dict[str, str] | None = None) -> int:
        """Makes the changed tables visible as version ``parent`` + 1 and returns it; tables that are not among them stay.

        ``check`` gets all tables as they would be and returns violations; any row of them refuses the whole batch. ``parent`` is
        the version that the change was made from, the newest if none is given; a version made since then is a conflict. ``adopt``
        names folders that were written before and are to be tables as they are.
        """
        parent = self.version() if parent is None else parent
        tables = self.tables(parent)
        if self.version() != parent:
            raise Conflict(f"version {self.version()} came after {parent}")
        aside = f"{self.folder}/data/{uuid.uuid4().hex}"
        for name, rows in changed.items():
            rows.write.mode("errorifexists").parquet(f"{aside}/{name}")
            tables[name] = f"{aside}/{name}"
        tables |= adopt or {}
        if check is not None:
            faults = check({name: self.spark.read.parquet(path) for name, path in tables.items()}).cache()
            try:
                first = faults.limit(20).collect()
                if first:
                    raise Rejected([r.asDict() for r in first], faults.count())
            finally:
                faults.unpersist()
        system, path = self._files()
        system.mkdirs(path)
        try:
            stream = system.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{parent + 1:012d}"), False)
        except Exception as e:
            raise Conflict(f"version {parent + 1} is taken") from e
        try:
            stream.write(bytearray(json.dumps({"version": parent + 1, "tables": tables}), "utf-8"))
        finally:
            stream.close()
        return parent + 1
