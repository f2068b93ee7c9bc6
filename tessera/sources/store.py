"""Tables that are published together: folders of files that never change, and one manifest that names the current ones.

A table is a list of segments, each written once under ``data/``. A version is a manifest of all tables, made by one
file that appears under its name when it is whole; readers take the last. Whatever fails before that leaves the version
that was, so several tables change as one or not at all, and any earlier version can be published again.

Versions are claimed by creating a file that must not be there. Of two writers on one version the later one fails
(``Conflict``), and what it wrote is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another version was published meanwhile."""


class Files:
    """The few calls on the file system of a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.at(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(path))] if self.fs.exists(self.at(path)) else []

    def text(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str = "") -> None:
        """A new file; an error if there is one of that name."""
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, path: str, new: str) -> None:
        if not self.fs.rename(self.at(path), self.at(new)):
            raise OSError(f"{path} could not take the name {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def file_version(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, bytes and time of the last change of each of the files, in order: what tells a table of files from the same one rewritten in place."""
    out = []
    for p in sorted(paths):
        files = Files(spark, p)
        s = files.fs.getFileStatus(files.at(p))
        out.append([p, s.getLen(), s.getModificationTime()])
    return out


class Store:
    """The tables under ``folder``, in files of one format."""

    def __init__(self, spark: SparkSession, folder: str, format: str = "parquet"):
        self.spark, self.folder, self.format, self.files = spark, folder.rstrip("/"), format, Files(spark, folder)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, tables (name to segments and schema) and info of a version, by default the last; version 0 has no tables."""
        version = (self.versions() or [0])[-1] if version is None else version
        return json.loads(self.files.text(f"{self.folder}/versions/{version:012d}.json")) if version else {"version": 0, "tables": {}, "info": {}}

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).format(self.format).load(entry["segments"]) if entry["segments"] else self.spark.createDataFrame([], schema)

    def segments(self, name: str, version: int | None = None) -> list[str]:
        return self.manifest(version)["tables"].get(name, {"segments": []})["segments"]

    def publish(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        drop: tuple[str, ...] = (),
        info: dict | None = None,
        verify: Callable[[dict[str, DataFrame]], None] | None = None,
        base: int | None = None,
    ) -> int:
        """Write the tables to ``replace`` and the new segments to ``append``, then make them the next version with the others as they are.

        ``verify`` gets the new files as tables; what it raises is raised, and nothing is published. ``base`` is the version that the rows were made from, by default the last.
        """
        before = self.manifest(base)
        tables = {k: v for k, v in before["tables"].items() if k not in drop}
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        try:
            made = {}
            for name, df in ((replace or {}) | (append or {})).items():
                df.write.format(self.format).save(path := f"{place}/{name}")
                made[name] = self.spark.read.schema(df.schema).format(self.format).load(path)
                kept = tables.get(name, {"segments": []})["segments"] if name in (append or {}) else []
                tables[name] = {"segments": [*kept, path], "schema": json.loads(df.schema.json())}
            if verify:
                verify(made)
            return self._commit(before["version"], {"tables": tables, "info": before["info"] | (info or {})})
        except BaseException:
            self.files.delete(place)
            raise

    def _commit(self, base: int, manifest: dict) -> int:
        top = f"{self.folder}/versions"
        claimed = [int(n.removesuffix(".claim")) for n in self.files.names(top) if n.endswith(".claim")]
        version = max([base, *claimed]) + 1  # a claim without a manifest is a writer's that died
        try:
            self.files.create(claim := f"{top}/{version:012d}.claim")
        except Exception as e:
            raise Conflict(f"version {version} of {self.folder} is being written") from e
        self.files.create(new := f"{top}/_{uuid.uuid4().hex}.new", json.dumps({"version": version} | manifest))
        if (self.versions() or [0])[-1] != base:
            self.files.delete(new)
            self.files.delete(claim)
            raise Conflict(f"{self.folder} has gone past version {base}")
        self.files.rename(new, f"{top}/{version:012d}.json")
        return version

    def rollback(self, version: int) -> int:
        """Publish an earlier version again; its files are still there unless ``vacuum`` took them."""
        old = self.manifest(version)
        return self._commit(self.manifest()["version"], {"tables": old["tables"], "info": old["info"]})

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` versions has, and the manifests before them; how many folders went. Not while another writer is at work."""
        versions = self.versions()
        stay = {s.split("/data/", 1)[1].split("/")[0] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for s in t["segments"]}
        gone = [n for n in self.files.names(f"{self.folder}/data") if n not in stay]
        for v in versions[:-keep]:
            self.files.delete(f"{self.folder}/versions/{v:012d}.json")
        for n in gone:
            self.files.delete(f"{self.folder}/data/{n}")
        return len(gone)
