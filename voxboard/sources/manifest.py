"""Tables whose batches are visible whole or not at all.

A batch is written to a folder of its own; one small file, the manifest, then names all
folders that make up the table from there on. Manifests are numbered and made once, so a
batch that was only half written is in none of them, a batch that is replayed finds its
number among those committed, and every earlier state of the table can still be read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: From so many folders on, a commit first puts them together.
MAX_PARTS = 200


@dataclass(frozen=True)
class Manifest:
    """One state of a table: its folders, the last batch of each writer, and notes of theirs."""

    version: int = -1
    parts: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


class CommittedTable:
    """A table under ``path`` that grows by committed batches."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self._fs_path(f"{self.path}/_manifest/{version:012d}.json")

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest:
        """The last state, or the one of a version."""
        known = self.versions()
        if not known:
            return Manifest()
        stream = self._fs.open(self._file(known[-1] if version is None else version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(found["version"], tuple(found["parts"]), found["batches"], found["notes"])

    def read(self, version: int | None = None) -> DataFrame:
        """The committed rows, now or as of a version."""
        parts = self.manifest(version).parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def _write(self, rows: DataFrame, name: str) -> str:
        part = f"data/{name}-{uuid.uuid4().hex}"
        rows.select([f.name for f in self.schema.fields]).write.parquet(f"{self.path}/{part}")
        return part

    def _publish(self, now: Manifest) -> None:
        """Make the manifest under another name, then give it its own, which must be free."""
        made = self._fs_path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(now.__dict__).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._file(now.version)) or not self._fs.rename(made, self._file(now.version)):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {now.version} of {self.path} was committed by another writer")

    def commit(self, rows: DataFrame, writer: str, batch: int, notes: dict[str, str] | None = None) -> bool:
        """Add a batch of a writer once; False if it was committed before.

        Batches of a writer come in ascending order, as those of a stream do.
        """
        now = self.manifest()
        if now.batches.get(writer, -1) >= batch:
            return False
        parts = (*now.parts, self._write(rows, f"{writer}-{batch}"))
        if len(parts) > MAX_PARTS:
            whole = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])
            parts = (self._write(whole, f"{writer}-upto-{batch}"),)
        after = replace(now, version=now.version + 1, parts=parts)
        self._publish(
            replace(after, batches=now.batches | {writer: batch}, notes=now.notes | (notes or {}))
        )
        return True

    def remove_unused(self) -> list[str]:
        """Delete folders that no manifest names: what is left of batches that failed."""
        named = {p for v in self.versions() for p in self.manifest(v).parts}
        folder = self._fs_path(f"{self.path}/data")
        found = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        left = sorted(set(found) - named)
        for part in left:
            self._fs.delete(self._fs_path(f"{self.path}/{part}"), True)
        return left
