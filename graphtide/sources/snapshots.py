"""Versioned snapshots of tables: estimates, truth, or whatever belongs together.

A version's tables are written under names of their own; then its manifest, a small file that names them, is moved into
place in one step. So a version is there whole or not at all: a write that dies leaves the last one as it was, and what it
had written is never read. Earlier versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """The versions in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:020d}.json"

    def versions(self) -> list[int]:
        """All versions, ascending."""
        top = self.path(f"{self.folder}/manifests")
        if not self.files.exists(top):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(top)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def write(self, version: int, tables: dict[str, DataFrame]) -> bool:
        """Writes a version, a number of 0 or more. One that is there already isn't written again, so a repeated batch changes nothing; then False."""
        if version < 0:
            raise ValueError(f"version {version}")
        if self.files.exists(self.path(self._manifest(version))):
            return False
        place = f"{self.folder}/data/{version}-{uuid.uuid4()}"
        for name, df in tables.items():
            df.write.parquet(f"{place}/{name}")
        draft = self.path(f"{self.folder}/manifests/_{uuid.uuid4()}")
        self.files.mkdirs(draft.getParent())
        out = self.files.create(draft, False)
        out.writeBytes(json.dumps({name: f"{place}/{name}" for name in tables}))
        out.close()
        if not self.files.rename(draft, self.path(self._manifest(version))):
            self.files.delete(draft, False)
            return False
        return True

    def read(self, name: str, as_of: int | None = None) -> DataFrame:
        """A table of the last version, or of the last one up to `as_of`. KeyError where there is none."""
        found = [v for v in self.versions() if as_of is None or v <= as_of]
        if not found:
            raise KeyError(f"no version up to {as_of} in {self.folder}")
        tables = json.loads("".join(r[0] for r in self.spark.read.text(self._manifest(found[-1]), wholetext=True).collect()))
        return self.spark.read.parquet(tables[name])
