"""A table that changes in one step: staged files, and a manifest of the version that names them, put in place last.

Rows lie in a fixed number of buckets by key.  A change writes new files for the buckets that it touches and then a manifest
that names, for each bucket, the files that make it up; readers follow the newest manifest, so they see the table
before or after a change and nothing between.  Manifests are numbered, and the file system lets one writer only create a
number; the other reads the new version and tries again.  A change carries an id: one that is already in the table's history
is not applied again, so a repeated or half-failed job leaves one version.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, and how often a change that others overtake is tried.
BUCKETS, TRIES = 16, 20
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Others kept changing the table."""


class VersionedTable:
    """The table in a folder; key is the column that rows are updated by."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(f"{self.folder}/manifests").getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:010d}.json"

    def version(self) -> int:
        """The newest version; 0 of a table without rows."""
        folder = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit()), default=0)

    def _state(self, version: int) -> dict[str, Any]:
        if not version:
            return {"buckets": {}, "changes": []}
        return json.loads(self.spark.read.text(self._manifest(version), wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._rows(self._state(self.version() if version is None else version), None)

    def _rows(self, state: dict[str, Any], only: set[int] | None) -> DataFrame:
        folders = [f"{self.folder}/data/{part}/{BUCKET}={b}" for b, parts in state["buckets"].items() if only is None or int(b) in only for part in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows by bucket under a new name; its name and its buckets."""
        part = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets))
        spread = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn(BUCKET, bucket)
        spread.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{part}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/data/{part}"))]
        return part, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))

    def _commit(self, version: int, state: dict[str, Any]) -> bool:
        """Put the manifest of a version in place; False if another writer was first."""
        staged = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(json.dumps(state).encode())
        out.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, self._path(self._manifest(version)), options)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(staged, False)
            return False
        return True

    def _change(self, rows: DataFrame, change: str, replace: bool) -> int:
        part, touched = (None, []) if replace else self._stage(rows)
        for _ in range(TRIES):
            version = self.version()
            state = self._state(version)
            if change in state["changes"]:
                return version
            if replace:
                new, hit = self._stage(rows)
                old = self._rows(state, set(hit))
                fresh = self._rows({"buckets": {b: [new] for b in hit}}, None)
                part, touched = self._stage(old.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh))
            buckets = {int(b): parts for b, parts in state["buckets"].items()}
            for b in touched:
                buckets[b] = [part] if replace else [*buckets.get(b, []), part]
            if self._commit(version + 1, {"buckets": buckets, "changes": [*state["changes"], change]}):
                return version + 1
        raise Conflict(f"{self.folder} changed {TRIES} times meanwhile")

    def append(self, rows: DataFrame, change: str) -> int:
        """Add rows; the version that has them.  Rows without an id get one beforehand, as identified() does."""
        return self._change(rows, change, replace=False)

    def update(self, rows: DataFrame, change: str) -> int:
        """Put rows in place of those with the same keys and add the others.  Keys are unique in rows; null keys only add."""
        return self._change(rows, change, replace=True)


def identified(rows: DataFrame, key: str, change: str) -> DataFrame:
    """rows with ids where key is null: derived from the change and the row, so a repeated job gives the same ones."""
    return rows.withColumn(key, F.coalesce(F.col(key).cast("string"), F.substring(F.sha1(F.concat_ws("\x1f", F.lit(change), *[F.col(c).cast("string") for c in rows.columns])), 1, 12)))
