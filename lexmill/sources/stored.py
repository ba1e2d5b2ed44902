"""Tables that are changed as a whole: versions in folders of their own, and a pointer to the one that holds.

A change is staged first: the new rows are written, all of them, to a folder that nobody reads. Then a small file with the next number is
put in place by one rename, which says which folder holds from now on. Up to that rename readers see the version before, and
those that have begun to read it go on doing so; if anything fails on the way, the old rows are what there is. Of two writers
that began with the same version only one can put the next number in place; the other gets an error and may start anew.

The pointer may carry notes, such as the number of a stream's batch: they change together with the rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.joins import join_same


class Conflict(RuntimeError):
    """Another writer was first."""


class StoredTable:
    """A versioned table in a folder of any file system that Spark's Hadoop knows and that renames a file in one step."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # ---- the pointer ----

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, at = self._files(), self._path("pointers")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()) if files.exists(at) else []

    def pointer(self, version: int | None = None) -> dict:
        """What the pointer says: version, folder and notes; version 0, without a folder, before the first change."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {"version": 0, "folder": None, "notes": {}}
        stream = self._files().open(self._path(f"pointers/{version:012d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _switch(self, pointer: dict) -> None:
        """Put the pointer in place, if its number isn't taken."""
        files, staged, target = self._files(), self._path(f"pointers/_{uuid.uuid4().hex}"), self._path(f"pointers/{pointer['version']:012d}")
        stream = files.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(pointer).encode()))
        finally:
            stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE  # never over another one
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, target, none)
        except Exception as e:
            files.delete(staged, False)
            raise Conflict(f"version {pointer['version']} of {self.folder} is there already") from e

    # ---- rows ----

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the one that holds now; what is read later doesn't change with the table."""
        folder = self.pointer(version)["folder"]
        return self.spark.createDataFrame([], self.schema) if folder is None else self.spark.read.schema(self.schema).parquet(f"{self.folder}/{folder}")

    def commit(self, rows: DataFrame, since: int | None = None, **notes) -> int:
        """Make rows the table's, all of them, and return the new version; since: the version they were made from."""
        before = self.pointer()
        if since is not None and before["version"] != since:
            raise Conflict(f"version {since} of {self.folder} is no longer the last")
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.folder}/{folder}")
        self._switch({"version": before["version"] + 1, "folder": folder, "notes": {**before["notes"], **notes}})
        return before["version"] + 1

    def upsert(self, rows: DataFrame, keys: list[str], **notes) -> int:
        """Rows take the place of those with the same keys, null being a key like any other; the others stay. rows has each key once."""
        before = self.pointer()["version"]
        old = self.read(before)
        return self.commit(rows.select(*old.columns).unionByName(join_same(old, rows, keys, "left_anti")), before, **notes)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last few, and what changes that failed have left. Not while others write."""
        files, known = self._files(), self.versions()
        held = {self.pointer(v)["folder"] for v in known[-keep:]}
        for v in known[:-keep]:
            files.delete(self._path(f"pointers/{v:012d}"), False)
        for f in files.listStatus(self._path()) if files.exists(self._path()) else []:
            if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in held:
                files.delete(f.getPath(), True)
