"""Snapshot sinks: tables of one version written beside the earlier ones, and a manifest that makes them the current ones."""

from __future__ import annotations

import json
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S


class Snapshots:
    """Versions of a set of tables in a folder that driver and executors share.

    ``commit`` writes tables first, each in a folder of its own, then a manifest that lists them and whatever the writer wants
    to remember (how far it has read, say). The manifest gets its name in one rename, so readers see all tables of a
    version or none; of two writers of the same version the later one is refused. Tables that a commit doesn't bring stay
    those of the version before. Older versions can be read until ``expire`` removes them with the tables only they hold."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        path = self._path(folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._path(f"{folder}/manifests"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.files.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version, or the current one, holds; an empty manifest of version 0 if there is none."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "marks": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/v{version:012d}.json").collect()))

    def commit(self, tables: dict[str, DataFrame], marks: dict | None = None, by: str = "project_id", base: dict | None = None) -> int:
        """Write ``tables`` (partitioned by ``by`` where they have it) as the version after ``base``, the current one by default."""
        base = base or self.manifest()
        held = dict(base["tables"])
        for name, table in tables.items():
            path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            if by in table.columns:
                table.write.partitionBy(by).parquet(path)  # each task has rows of all projects either way
            else:
                table.write.parquet(path)
            held[name] = {"path": path, "schema": table.schema.jsonValue()}
        version = base["version"] + 1
        said = json.dumps({"version": version, "tables": held, "marks": base["marks"] | (marks or {})})
        draft, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/v{version:012d}.json")
        out = self.files.create(draft, False)
        out.write(bytearray(said.encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            self.files.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        table = self.manifest(version)["tables"][name]
        return self.spark.read.schema(S.StructType.fromJson(table["schema"])).parquet(table["path"])

    def expire(self, keep: int) -> list[int]:
        """Remove all versions but the last ``keep`` (one at least); tables that a kept version holds stay."""
        versions = self.versions()
        old, kept = versions[: -max(1, keep)], versions[-max(1, keep) :]
        needed = {t["path"] for v in kept for t in self.manifest(v)["tables"].values()}
        for v in old:
            gone = {t["path"] for t in self.manifest(v)["tables"].values()} - needed
            self.files.delete(self._path(f"{self.folder}/manifests/v{v:012d}.json"), False)
            for path in gone:
                with suppress(FileNotFoundError):
                    self.files.delete(self._path(path), True)
        return old
