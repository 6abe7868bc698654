"""A table that grows by small batches and stays cheap to read.

Each batch adds one *run* (a parquet folder) to a table.  What a table says of
a key is the merge of its rows in all runs: the last row, or the sum of signed
counts.  After a batch, runs are merged until each holds fewer than half the
rows of the one before it.  A run has one row per key, so all runs together hold
less than twice the rows of the oldest, one for each key there was when it was
written, however many batches there were.  There are at most log2(keys) runs,
and on average a row is written again log2(keys) times at most.

A manifest names the runs.  A new one is written under another name and then
renamed, and readers take the newest, so a batch of several tables becomes
visible as a whole, and a writer that dies leaves only folders that no manifest
names; the next writer's ``vacuum`` removes them.  One writer at a time (a
stream's ``foreachBatch``), any number of readers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Manifests that stay readable while newer ones are written.
KEPT = 8


def last_row(keys: list[str], order: str = "_batch") -> Callable[[DataFrame], DataFrame]:
    """Merge: of each key the row with the greatest ``order``."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
        return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])
    return merge


def signed_sum(keys: list[str], count: str = "n") -> Callable[[DataFrame], DataFrame]:
    """Merge: of each key the sum of the signed counts; a key that sums to 0 is gone."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) != 0).select(*rows.columns)
    return merge


@dataclass(frozen=True)
class Run:
    path: str
    rows: int


@dataclass(frozen=True)
class Table:
    """Columns, the keys a run is sorted by (so that filters on them skip its
    row groups), and how rows of a key are merged."""
    schema: T.StructType
    keys: list[str]
    merge: Callable[[DataFrame], DataFrame]


class RunStore:
    """Tables under ``base`` that are committed together."""

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, Table]):
        self.spark, self.base, self.tables = spark, base, tables
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([base, *parts]))
        self._text = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path().getFileSystem(conf)
        self._fs.mkdirs(self._path("manifests"))

    # ------------------------------------------------------------------ manifests

    def _versions(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(n for n in names if n.endswith(".json"))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path("manifests", name))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{"batch": last batch, "runs": {table: [[path, rows], ...]}}, oldest run first."""
        found = self._versions()
        return self._read(found[-1]) if found else {"batch": -1, "runs": {t: [] for t in self.tables}}

    def _swap(self, manifest: dict) -> None:
        found = self._versions()
        name = f"{int(found[-1][:20]) + 1 if found else 0:020}.json"
        draft = self._path("manifests", f"{name}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._fs.rename(draft, self._path("manifests", name)):
            raise RuntimeError(f"another writer has committed {name} under {self.base}")

    # ------------------------------------------------------------------ runs

    def write(self, table: str, rows: DataFrame) -> Run:
        """Write ``rows`` (one per key) as a run that no manifest names yet."""
        path, seen = f"{self.base}/runs/{table}-{uuid.uuid4().hex}", Observation()
        t = self.tables[table]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in t.schema.fields])
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).sortWithinPartitions(*t.keys).write.parquet(path)
        return Run(path, seen.get["rows"])

    def rows(self, table: str, runs: list[Run] | None = None) -> DataFrame:
        """The rows of the runs as they are, a key once per run that has it."""
        runs = [Run(*r) for r in self.manifest()["runs"][table]] if runs is None else runs
        schema = self.tables[table].schema
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r.path for r in runs])

    def read(self, table: str) -> DataFrame:
        """One row per key."""
        return self.tables[table].merge(self.rows(table))

    # ------------------------------------------------------------------ batches

    def has(self, batch_id: int) -> bool:
        return batch_id <= self.manifest()["batch"]

    def commit(self, batch_id: int, new: dict[str, Run]) -> None:
        """Add the batch's runs, then merge runs as needed.  A batch that is retried
        after it was committed changes nothing."""
        manifest = self.manifest()
        if batch_id <= manifest["batch"]:
            return
        for table, run in new.items():
            if run.rows:
                manifest["runs"][table].append([run.path, run.rows])
        self._swap(manifest | {"batch": batch_id})
        self.settle()

    def settle(self) -> None:
        """Merge the newest runs of each table until each run holds fewer than
        half the rows of the run before it."""
        for table, t in self.tables.items():
            manifest = self.manifest()
            runs = [Run(*r) for r in manifest["runs"][table]]
            start, rows = len(runs) - 1, runs[-1].rows if runs else 0
            while start > 0 and 2 * rows >= runs[start - 1].rows:
                start, rows = start - 1, rows + runs[start - 1].rows
            if start < len(runs) - 1:
                merged = self.write(table, t.merge(self.rows(table, runs[start:])))
                kept = [*runs[:start], *([merged] if merged.rows else [])]
                manifest["runs"][table] = [[r.path, r.rows] for r in kept]
                self._swap(manifest)
        self.vacuum()

    def vacuum(self) -> None:
        """Remove manifests but the newest KEPT, and runs that none of those names."""
        found = self._versions()
        for name in found[:-KEPT]:
            self._fs.delete(self._path("manifests", name), False)
        named = {r[0].rsplit("/", 1)[1] for n in found[-KEPT:] for runs in self._read(n)["runs"].values() for r in runs}
        if self._fs.exists(self._path("runs")):
            for s in self._fs.listStatus(self._path("runs")):
                if s.getPath().getName() not in named:
                    self._fs.delete(s.getPath(), True)
