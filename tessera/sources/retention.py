"""Age limits of artifacts: files and folders that are older than their time to live are deleted. Only what the file system says of them is read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Files

DAY = 86_400
#: Folders that were changed this many seconds ago may still be in use.
ACTIVE = 3600


@dataclass
class Cleanup:
    name: str
    deleted: int = 0
    deleted_bytes: int = 0
    kept: int = 0
    skipped: bool = False
    errors: tuple[str, ...] = ()


def files_of(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path, modified, bytes of the files in ``folder`` itself that match: a scan of metadata, which opens no file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def expired(files: DataFrame, ttl_days: float, now: float) -> DataFrame:
    """``files`` strictly older than ``ttl_days`` at ``now`` (seconds)."""
    return files.filter(F.unix_millis("modified") < int((now - ttl_days * DAY) * 1000))


def clean_files(spark: SparkSession, name: str, folder: str, ttl_days: float, now: float, pattern: str = "*.json") -> Cleanup:
    """Delete the expired files of a folder. Without a positive ``ttl_days`` nothing is looked at; a folder that isn't there has none. A file that can't be deleted is an error of the result, and the others still go."""
    files = Files(spark, folder)
    if ttl_days <= 0:
        return Cleanup(name, skipped=True)
    if not files.fs.exists(files.at(folder)) or not any(not n.startswith(("_", ".")) for n in files.names(folder)):
        return Cleanup(name)
    found, out, errors = files_of(spark, folder, pattern), Cleanup(name), []
    for row in expired(found, ttl_days, now).orderBy("path").toLocalIterator():
        try:
            if not files.fs.delete(files.at(row["path"]), False):
                raise OSError("it is gone")
        except Exception as e:
            errors.append(f"{row['path']}: {e}")
            continue
        out.deleted, out.deleted_bytes = out.deleted + 1, out.deleted_bytes + row["bytes"]
    out.errors = tuple(errors)
    return out


def folders_of(files: Files, root: str) -> Iterator:
    """The artifact folders: those within the folders of dates."""
    for day in files.fs.listStatus(files.at(root)) if files.fs.exists(files.at(root)) else []:
        if day.isDirectory():
            yield from (s for s in files.fs.listStatus(day.getPath()) if s.isDirectory())


def clean_folders(spark: SparkSession, name: str, root: str, ttl_days: float, now: float, active: float = ACTIVE) -> Cleanup:
    """Delete artifact folders strictly older than ``ttl_days``, but none that is temporary (.tmp), locked (holds .lock) or changed within ``active`` seconds."""
    files, out = Files(spark, root), Cleanup(name)
    if ttl_days <= 0:
        return Cleanup(name, skipped=True)
    for s in folders_of(files, root):
        path, changed = s.getPath(), s.getModificationTime() / 1000
        busy = path.getName().endswith(".tmp") or files.fs.exists(files.at(f"{path}/.lock"))
        if busy or changed >= now - ttl_days * DAY or now - changed < active:
            out.kept += 1
            continue
        out.deleted_bytes += files.fs.getContentSummary(path).getLength()
        files.fs.delete(path, True)
        out.deleted += 1
    return out


def clean(spark: SparkSession, targets: list[tuple[str, str, float]], now: float) -> dict:
    """All targets (name, folder, ttl_days): counts and bytes in all, and what became of each."""
    results = [clean_files(spark, *t, now=now) for t in targets]
    return {"deleted": sum(r.deleted for r in results), "deleted_bytes": sum(r.deleted_bytes for r in results), "targets": results}
