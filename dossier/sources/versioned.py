"""A keyed table with versions: upserts rewrite the buckets they touch and become visible by one rename.

A version is a manifest, a small JSON file that names the folder of each bucket of keys. A writer puts the new files of the
touched buckets into a folder of its own, then renames its manifest to the next number, which fails if another writer took that
number first; it then merges again onto that writer's version. A writer that is killed leaves files that no manifest names, so the
old version stays. Files of a version never change, so a reader keeps the version that it began with; vacuum() deletes what the
last versions do not name, and files of writers that ended long ago. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, TRIES = 64, 20


class Conflict(RuntimeError):
    """Other writers took every version that this one tried to commit."""


class VersionedTable:
    """Rows keyed by columns; a new folder gives an empty table of the schema."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        path, fs = self._fs(f"{self.path}/{folder}")
        return [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names("manifests") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict[str, str]:
        """Bucket -> folder of a version; version -1 is the empty table."""
        if version < 0:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _latest(self) -> int:
        return max(self.versions(), default=-1)

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest). What is read stays that version, whatever is written meanwhile."""
        return self._rows(self._manifest(self._latest() if version is None else version))

    def _commit(self, version: int, manifest: dict[str, str]) -> bool:
        """Puts the manifest in place as this version; false if there is one."""
        jvm, draft = self.spark._jvm, f"{self.path}/manifests/_{uuid.uuid4().hex}"
        path, fs = self._fs(draft)
        out = fs.create(path, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()) if path.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(path, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{version:020d}.json"), options)
        except Py4JJavaError as e:
            fs.delete(path, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Commits merge(old rows, new rows) of the buckets that new rows touch, and gives the version. merge must be safe to repeat."""
        from dossier.sources.shared import discard, materialize

        new = materialize(self._bucketed(new), "upsert")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # `buckets` at most
        try:
            for _ in range(TRIES):
                version = self._latest()
                manifest = self._manifest(version)
                if not touched:
                    return version
                old = self._rows({str(b): manifest[str(b)] for b in touched if str(b) in manifest})
                folder = uuid.uuid4().hex
                merged = self._bucketed(merge(old, new.drop("bucket")).select(*self.schema.names))
                merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
                path, fs = self._fs(f"{self.path}/data/{folder}")
                written = {x.getPath().getName()[7:] for x in fs.listStatus(path) if x.getPath().getName().startswith("bucket=")}
                manifest = {b: f for b, f in manifest.items() if int(b) not in touched} | {b: folder for b in written}
                if self._commit(version + 1, manifest):
                    return version + 1
                fs.delete(path, True)
        finally:
            discard(new)
        raise Conflict(f"{TRIES} versions of {self.path} were taken by other writers")

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> None:
        """Deletes all versions but the last, and the data folders that none of them names and that are older than some hours."""
        versions = self.versions()
        kept = {folder for v in versions[-keep:] for folder in self._manifest(v).values()}
        for v in versions[:-keep]:
            path, fs = self._fs(f"{self.path}/manifests/{v:020d}.json")
            fs.delete(path, False)
        for name, changed in self._names("data"):
            if name not in kept and changed <= (time.time() - hours * 3600) * 1000:
                path, fs = self._fs(f"{self.path}/data/{name}")
                fs.delete(path, True)
