"""Erasure and retention on stored Parquet folders: only what is affected is rewritten.

Erasure finds the files that hold an erased key by reading the key column alone, writes
what stays of those files beside them, and replaces them in one step: a journal that
names old and new files is the commit.  Without it an interrupted run leaves nothing behind
but a hidden folder; with it the replacement can be finished by any later run.  Files that
hold no erased key are never opened for writing.

Retention works on folders partitioned by day: days before the cutoff are dropped without being
read, the day of the cutoff alone is rewritten.

One such job runs on a folder at a time.  While a journal is applied, a reader may see kept rows of
replaced files twice, never a row missing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.joins import lookup
from contactlake.session import ensure_checkpoint_dir

_MARK = "_erasing_"


class Folder:
    """Files of one folder through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._root = self._path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._root = self._fs.makeQualified(self._root)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def at(self, relative: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, relative)

    def names(self, relative: str = "") -> list[str]:
        found = self._fs.listStatus(self.at(relative) if relative else self._root)
        return [status.getPath().getName() for status in found]

    def files(self, relative: str) -> list[str]:
        """Data files below a folder, relative to it."""
        base, out = self._fs.makeQualified(self.at(relative)).toUri(), []
        walk = self._fs.listFiles(self.at(relative), True)
        while walk.hasNext():
            path = walk.next().getPath()
            if not path.getName().startswith(("_", ".")):
                out.append(base.relativize(path.toUri()).getPath().lstrip("/"))
        return out

    def relative(self, uri: str) -> str:
        return self._root.toUri().relativize(self._jvm.java.net.URI(uri)).getPath().lstrip("/")

    def absolute(self, relative: str) -> str:
        return self.at(relative).toString()

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self.at(relative))

    def is_folder(self, relative: str) -> bool:
        return self._fs.getFileStatus(self.at(relative)).isDirectory()

    def make(self) -> None:
        self._fs.mkdirs(self._root)

    def remove(self) -> None:
        """The folder itself, with all it holds."""
        self._fs.delete(self._root, True)

    def delete(self, relative: str) -> None:
        self._fs.delete(self.at(relative), True)

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self.at(target).getParent())
        if not self._fs.rename(self.at(source), self.at(target)):
            raise OSError(f"cannot move {source} to {target}")

    def write(self, relative: str, text: str) -> None:
        out = self._fs.create(self.at(relative), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, relative: str) -> str:
        stream = self._fs.open(self.at(relative))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _apply(folder: Folder, staging: str) -> None:
    """Finish a journal; every step may have been done before."""
    journal = json.loads(folder.read(f"{staging}/journal"))
    for name in journal["new"]:
        if folder.exists(f"{staging}/new/{name}"):
            folder.move(f"{staging}/new/{name}", name)
    for name in journal["old"]:
        folder.delete(name)
    folder.delete(staging)


def finish_erasures(spark: SparkSession, path: str) -> int:
    """Finish what a lost driver had committed, drop what it had not; the number of runs that were found."""
    folder = Folder(spark, path)
    found = [name for name in folder.names() if name.startswith(_MARK)]
    for staging in found:
        if folder.exists(f"{staging}/journal"):
            _apply(folder, staging)
        else:
            folder.delete(staging)
    return len(found)


def erase_from_files(spark: SparkSession, path: str, keys: DataFrame, key: Column, on: str = "key") -> DataFrame:
    """Remove the rows whose ``key`` is in ``keys(on)`` from a Parquet folder; (file, deleted_rows) per replaced file.

    Null keys match nothing.  A folder may be partitioned by columns (``name=value`` folders).
    """
    ensure_checkpoint_dir(spark)
    finish_erasures(spark, path)
    folder = Folder(spark, path)
    held = keys.select(F.col(on).alias("__key")).where("__key is not null").distinct()
    stored = spark.read.parquet(path)
    tagged = stored.select(key.alias("__key"), F.col("_metadata.file_path").alias("file"))
    touched = lookup(tagged, held, "__key", "left_semi").groupBy("file").agg(F.count("*").alias("deleted_rows")).checkpoint(eager=True)
    # Part of the listing that the driver holds anyway.
    old = [folder.relative(r.file) for r in touched.select("file").collect()]
    if not old:
        return touched
    rest = spark.read.option("basePath", path).schema(stored.schema).parquet(*[folder.absolute(name) for name in old])
    kept = lookup(rest.withColumn("__key", key), held, "__key", "left_anti").select(*stored.columns)
    staging = f"{_MARK}{uuid.uuid4().hex}"
    parts = [step.split("=")[0] for step in old[0].split("/")[:-1] if "=" in step]
    writer = kept.write.partitionBy(*parts) if parts else kept.write
    writer.parquet(folder.absolute(f"{staging}/new"))
    folder.write(f"{staging}/journal.part", json.dumps({"old": old, "new": folder.files(f"{staging}/new")}))
    folder.move(f"{staging}/journal.part", f"{staging}/journal")
    _apply(folder, staging)
    return touched


@dataclass
class Retained:
    """Days that were dropped unread and days that were rewritten."""

    dropped: list[date] = field(default_factory=list)
    rewritten: list[date] = field(default_factory=list)


def retain_since(spark: SparkSession, path: str, cutoff: datetime, day: str = "day", time: str = "ts") -> Retained:
    """Drop rows older than ``cutoff`` from a folder partitioned by the day of ``time``, both in the session's time zone.

    Rows without a time stay unless their whole day goes; what is in no day's folder stays.
    """
    folder, out = Folder(spark, path), Retained()
    for name in folder.names():
        try:
            found = date.fromisoformat(name.removeprefix(f"{day}=")) if name.startswith(f"{day}=") else None
        except ValueError:
            found = None
        if found and found < cutoff.date():
            folder.delete(name)
            out.dropped.append(found)
        elif found == cutoff.date():
            rows = spark.read.option("basePath", path).parquet(folder.absolute(name))
            old = F.coalesce(F.col(time) < F.lit(cutoff.isoformat(sep=" ")).cast("timestamp"), F.lit(False))
            if rows.where(old).isEmpty():
                continue
            if rows.where(~old).isEmpty():
                folder.delete(name)
                out.dropped.append(found)
                continue
            rows.where(~old).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
            out.rewritten.append(found)
    out.dropped.sort()
    return out
