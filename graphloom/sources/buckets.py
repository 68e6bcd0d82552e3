"""Tables in hash buckets of a path, changed by idempotent merges.

A table's rows lie in folders, a bucket of the path's hash each. A manifest
says for every table and bucket which folder counts. A merge writes the buckets
of changed paths anew and a manifest that points to them and, for all others,
to the folders that counted before; readers see one manifest or the other. It
names the last batch, so that a batch that is handed over again changes
nothing. What the driver holds is the manifest: tables times buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.ordering import spare
from graphloom.sources.sinks import _current, put_pointer

BUCKETS = 64


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Bucketed:
    """Tables below a root; ``keys`` names the path column of each."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        number, content = _current(spark, self.root)
        self.number = number
        self.manifest = json.loads(content) if content else {"batch": None, "buckets": buckets, "tables": {}}
        self.buckets = self.manifest["buckets"]

    @property
    def batch(self) -> int | None:
        """The last batch that was merged."""
        return self.manifest["batch"]

    def folders(self, name: str) -> dict[int, str]:
        """The folder of each bucket that has one."""
        return {int(k): v for k, v in self.manifest["tables"].get(name, {}).get("folders", {}).items()}

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        schema = StructType.fromJson(self.manifest["tables"][name]["schema"])
        paths = [f"{self.root}/{v}" for k, v in self.folders(name).items() if only is None or k in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame) -> dict[int, str]:
        """Writes rows by bucket; the folders of buckets that have rows."""
        bucket, run = spare("bucket", rows), f"{name}/{uuid.uuid4().hex}"
        own = rows.withColumn(bucket, bucket_of(F.col(self.keys[name]), self.buckets))
        own.repartition(bucket).write.partitionBy(bucket).parquet(f"{self.root}/{run}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{run}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = [x.getPath().getName() for x in found if x.isDirectory()]
        return {int(n.rpartition("=")[2]): f"{run}/{n}" for n in names if "=" in n}

    def _commit(self, tables: dict, batch: int | None) -> None:
        manifest = self.manifest | {"batch": batch, "tables": tables}
        put_pointer(self.spark, self.root, self.number + 1, json.dumps(manifest))
        self.number, self.manifest = self.number + 1, manifest

    def create(self, tables: dict[str, DataFrame], batch: int | None = None) -> None:
        """All tables from scratch."""
        self._commit({name: {"schema": df.schema.jsonValue(), "folders": self._write(name, df)} for name, df in tables.items()}, batch)

    def merge(self, changes: dict[str, tuple[DataFrame, DataFrame]], batch: int) -> bool:
        """For each table (changed paths in column path, rows that now stand for them): replaces what changed, in its buckets only.

        Fresh rows of other paths are left out. False, and nothing is done, if
        the batch was merged before.
        """
        if self.batch is not None and batch <= self.batch:
            return False
        tables = dict(self.manifest["tables"])
        for name, (changed, fresh) in changes.items():
            key = self.keys[name]
            gone = changed.select(F.col("path").alias(key)).distinct()
            touched = sorted(r[0] for r in gone.select(bucket_of(F.col(key), self.buckets)).distinct().collect())
            if not touched:
                continue
            kept = self.read(name, touched).join(gone, key, "left_anti")
            rows = kept.unionByName(fresh.join(gone, key, "left_semi")).select(*kept.columns)
            folders = {k: v for k, v in self.folders(name).items() if k not in touched} | self._write(name, rows)
            tables[name] = tables[name] | {"folders": folders}
        self._commit(tables, batch)
        return True
