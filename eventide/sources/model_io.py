"""Model tables in a shared folder: versions, of which a manifest names the good ones.

A version is written to a folder of its own that nothing reads yet; its manifest, one
small file, is written under another name and renamed last.  So a reader sees
a version whole or not at all, a write that stops half-way leaves the versions before it as they were,
and a version stays readable by its number for as long as it is kept.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    loss: float
    config: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    tables: tuple[str, ...] = ()


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[Version]:
        """The published versions, oldest first."""
        at = self._fs_path(os.path.join(self.path, "manifests"))
        if not self._fs.exists(at):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(at))
        return [self._read(n) for n in names if n.startswith("v") and n.endswith(".json")]

    def _read(self, name: str) -> Version:
        text = "\n".join(r.value for r in self.spark.read.text(os.path.join(self.path, "manifests", name), wholetext=True).collect())
        raw = json.loads(text)
        return Version(**raw | {"tables": tuple(raw["tables"])})

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write the tables to a fresh folder; nobody sees them yet."""
        folder = os.path.join(self.path, "data", uuid.uuid4().hex)
        for name, df in tables.items():
            df.write.parquet(os.path.join(folder, name))
        return folder

    def publish(self, folder: str, names: tuple[str, ...], loss: float, config: dict, meta: dict) -> Version:
        """Make a written folder the next version.  Of two writers that publish the
        same number one fails: a rename does not replace a file."""
        found = self.versions()
        v = Version(found[-1].number + 1 if found else 1, folder, loss, config, meta, tuple(names))
        at = os.path.join(self.path, "manifests")
        draft = self._fs_path(os.path.join(self.path, f"draft-{uuid.uuid4().hex}"))
        self._fs.mkdirs(self._fs_path(at))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(v), sort_keys=True).encode()))
        out.close()
        final = self._fs_path(os.path.join(at, f"v{v.number:09d}.json"))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {v.number} was published by another writer")
        return v

    def save_if_better(self, tables: dict[str, DataFrame], loss: float, config: dict, meta: dict) -> Version | None:
        """Publish a version if its loss is below that of every one before it;
        else write nothing."""
        if any(v.loss <= loss for v in self.versions()):
            return None
        return self.publish(self.write(tables), tuple(tables), loss, config, meta)

    def load(self, number: int | None = None) -> tuple[dict[str, DataFrame], Version]:
        """The tables of a version (the latest by default)."""
        found = {v.number: v for v in self.versions()}
        if not found or number is not None and number not in found:
            raise LookupError(f"no version {number or ''} in {self.path}")
        v = found[max(found) if number is None else number]
        return {n: self.spark.read.parquet(os.path.join(v.folder, n)) for n in v.tables}, v

    def keep_last(self, n: int) -> None:
        """Drop all but the last ``n`` versions: the manifest first, then its data."""
        for v in self.versions()[:-n]:
            self._fs.delete(self._fs_path(os.path.join(self.path, "manifests", f"v{v.number:09d}.json")), False)
            self._fs.delete(self._fs_path(v.folder), True)
