"""Tables with versions: upserts and queue steps that persist, with every earlier version still readable.

A version is a manifest: a row for each data file with its number of rows and its least and greatest key. Data files are never changed. A merge
finds the files that hold a changed key, in two steps: ranges of the changes against ranges of the files (a small table against the manifest), then
the keys themselves, of those files only. It writes those files anew and lists all others as they are. What is written comes first and the version's marker
last, by a rename that fails if another writer has taken the number: then the merge is made again on top of that version.

Keys are not null and one row has a key; a merge raises if its changes break that. Changes are rows of keys and of the columns that they change. An
empty table or empty changes are versions like any other. Columns keep their order. Old files stay until their folder goes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ROWS, RETRIES = 2_000_000, 5
MANIFEST = "file string, rows long, low string, high string"


class CommitConflict(RuntimeError):
    """Another writer has taken this version."""


class VersionedTable:
    """A table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.key, self.file_rows = spark, path.rstrip("/"), key, file_rows

    # ---- versions
    def _files(self):
        return self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()

    def latest(self) -> int:
        """The greatest version; 0 if there is none."""
        fs, conf = self._files()
        folder = fs.Path(f"{self.path}/versions")
        system = folder.getFileSystem(conf)
        if not system.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def _marker(self, version: int) -> dict:
        row = self.spark.read.text(f"{self.path}/versions/{version:012d}").first()
        return json.loads(row[0])

    def _commit(self, version: int, marker: dict) -> None:
        fs, conf = self._files()
        context = fs.FileContext.getFileContext(fs.Path(self.path).getFileSystem(conf).getUri(), conf)
        draft, final = fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}"), fs.Path(f"{self.path}/versions/{version:012d}")
        system = draft.getFileSystem(conf)
        system.mkdirs(final.getParent())
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # atomic, and an error if the version is there
        except Exception as e:
            if system.exists(final):
                raise CommitConflict(f"version {version} is taken") from e
            raise

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, rows, low, high of a version."""
        marker = self._marker(version or self.latest())
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{marker['manifest']}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        marker = self._marker(version or self.latest())
        return self._rows(self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{marker['manifest']}"), marker["schema"])

    def _rows(self, manifest: DataFrame, schema: str) -> DataFrame:
        # a name a file, as Spark's own listing would bring
        files = [r[0] for r in manifest.select("file").collect()]
        from pyspark.sql.types import StructType

        typed = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(typed).parquet(*files) if files else self.spark.createDataFrame([], typed)

    # ---- writing
    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows to new files by ranges of the key; their manifest."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        typed = rows.schema
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.option("maxRecordsPerFile", self.file_rows).parquet(folder)
        written = self.spark.read.schema(typed).parquet(folder).select(F.col("_metadata.file_path").alias("file"), self.key)
        ends = written.groupBy("file").agg(F.count("*").alias("rows"), F.min(self.key).cast("string").alias("low"), F.max(self.key).cast("string").alias("high"))
        return ends

    def _save_manifest(self, manifest: DataFrame) -> str:
        name = uuid.uuid4().hex
        manifest.select("file", "rows", "low", "high").write.parquet(f"{self.path}/manifests/{name}")
        return name

    def create(self, rows: DataFrame) -> int:
        """Version 1."""
        self._check(rows)
        manifest = self._save_manifest(self._write(rows))
        self._commit(1, {"manifest": manifest, "schema": rows.schema.json(), "parent": 0})
        return 1

    def _check(self, rows: DataFrame) -> None:
        bad = rows.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col(self.key).isNull() | (F.col("n") > 1))
        if not bad.isEmpty():
            raise ValueError(f"{self.key} is null or not unique")

    def touched(self, changes: DataFrame, version: int | None = None) -> DataFrame:
        """file: those of a version that hold a key of the changes."""
        marker = self._marker(version or self.latest())
        kind = dict(self.read(version).dtypes)[self.key]
        return self._touched(changes, self.manifest(version), marker["schema"], kind)

    def _touched(self, changes: DataFrame, manifest: DataFrame, schema: str, kind: str) -> DataFrame:
        # a range for each part of the changes: as many rows as there are shuffle partitions, whatever their number
        parts = changes.select(self.key).repartitionByRange(self.key).groupBy(F.spark_partition_id().alias("part"))
        ranges = parts.agg(F.min(self.key).alias("from"), F.max(self.key).alias("to")).select("from", "to")
        low, high = F.col("low").cast(kind), F.col("high").cast(kind)
        near = manifest.join(F.broadcast(ranges), (low <= F.col("to")) & (high >= F.col("from")), "left_semi")
        here = self._rows(near, schema)
        if not here.inputFiles():
            return near.select("file")
        return here.select(F.col("_metadata.file_path").alias("file"), self.key).join(changes.select(self.key), self.key, "left_semi").select("file").distinct()

    def merge(self, changes: DataFrame, blank_keeps: bool = False, insert: bool = True, keep: Callable[[str, Column, Column], Column] | None = None) -> int:
        """Commit the changes to rows by key and, with insert, the rows that are new; the version.

        A null in the changes keeps the old value, and so does an empty string with blank_keeps; ``keep`` (column, old, new) states another rule."""
        self._check(changes)
        for _ in range(RETRIES):
            base = self.latest()
            try:
                return self._merge(changes, base, blank_keeps, insert, keep)
            except CommitConflict:
                continue
        raise CommitConflict(f"{RETRIES} writers came first")

    def _merge(self, changes: DataFrame, base: int, blank_keeps: bool, insert: bool, keep) -> int:
        marker = self._marker(base)
        manifest, present = self.manifest(base), self.read(base)
        columns, kind = present.columns, dict(present.dtypes)[self.key]
        if unknown := [c for c in changes.columns if c not in columns]:
            raise ValueError(f"not columns of the table: {', '.join(unknown)}")
        files = self.spark.createDataFrame(self._touched(changes, manifest, marker["schema"], kind).collect(), "file string")
        old = self._rows(files, marker["schema"])
        named = [c for c in changes.columns if c != self.key]
        new = changes.select(F.col(self.key).alias("__key"), F.lit(True).alias("__changed"), *[F.col(c).alias(f"__{c}") for c in named])

        def value(c: str) -> Column:
            was, is_ = F.col(c), F.col(f"__{c}").cast(dict(present.dtypes)[c])
            if keep is not None:
                return F.when(F.col("__changed"), keep(c, was, is_)).otherwise(was)
            return F.coalesce(F.when(is_.cast("string") != "", is_) if blank_keeps else is_, was)

        both = old.join(new, F.col(self.key) == F.col("__key"), "full" if insert else "left")
        made = both.select(*[
            F.coalesce(F.col(c), F.col("__key")).cast(kind).alias(c) if c == self.key else value(c).alias(c) if c in named else F.col(c) for c in columns
        ])
        listed = manifest.join(files, "file", "left_anti").unionByName(self._write(made))
        self._commit(base + 1, {"manifest": self._save_manifest(listed), "schema": marker["schema"], "parent": base})
        return base + 1

    def missing(self, changes: DataFrame, column: str, version: int | None = None) -> DataFrame:
        """key, expected, actual: changes that a version does not show."""
        here = self.read(version).select(self.key, F.col(column).alias("actual"))
        both = changes.where(F.col(column).isNotNull()).select(self.key, F.col(column).alias("expected")).join(here, self.key, "left")
        return both.where(~F.col("expected").eqNullSafe(F.col("actual")))
