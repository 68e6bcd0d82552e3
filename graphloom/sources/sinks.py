"""Sinks: versioned tables with a pointer, and a registry of projects."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.ordering import first_by

POINTER = "CURRENT"


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _read(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number and the version of the newest pointer; (0, None) without one."""
    fs, path = _files(spark, root)
    if not fs.exists(path(root)):
        return 0, None
    found = [x.getPath() for x in fs.listStatus(path(root)) if x.getPath().getName().startswith(f"{POINTER}-")]
    newest = max(found, key=lambda x: x.getName(), default=None)
    return (int(newest.getName().rpartition("-")[2]), _read(spark, fs, newest)) if newest else (0, None)


def put_pointer(spark: SparkSession, root: str, number: int, content: str) -> None:
    """Writes a pointer aside and gives it its number; an error if another writer has taken that. The one before stays for readers."""
    fs, path = _files(spark, root)
    fresh, pointer = path(f"{root}/new-{uuid.uuid4().hex}"), path(f"{root}/{POINTER}-{number:012d}")
    out = fs.create(fresh, True)
    out.write(content.encode("utf-8"))
    out.close()
    if fs.exists(pointer) or not fs.rename(fresh, pointer):
        raise OSError(f"could not write pointer {number} of {root}")
    fs.delete(path(f"{root}/{POINTER}-{number - 2:012d}"), False)


def _written(tables: dict[str, DataFrame], root: str, version: str) -> dict[str, list[dict]]:
    """Writes tables below a version; what a manifest says of them."""
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    return {name: [{"path": f"{version}/{name}", "schema": df.schema.jsonValue()}] for name, df in tables.items()}


def _parts(spark: SparkSession, root: str) -> tuple[int, dict[str, list[dict]]]:
    """The number of the newest pointer, and the parts of each table."""
    number, content = _current(spark, root)
    return number, json.loads(content)["tables"] if content else {}


def save_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Writes a new version of all tables, then points to it; readers see the old version or the new one.

    Pointers are numbered and written aside first; the newest counts, so there
    is no moment without one. Two writers of one number are an error.
    """
    version = uuid.uuid4().hex
    parts = _written(tables, root, version)
    put_pointer(spark, root, _current(spark, root)[0] + 1, json.dumps({"tables": parts}))
    return version


def load_tables(spark: SparkSession, names: list[str], root: str) -> dict[str, DataFrame]:
    """The tables of the current version, by their saved schemas; columns that some parts lack are null. Raises FileNotFoundError before the first one."""
    number, known = _parts(spark, root)
    if not number:
        raise FileNotFoundError(f"{root} holds no version")
    out = {}
    for name in names:
        parts = [spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{root}/{x['path']}") for x in known[name]]
        out[name] = parts[0]
        for part in parts[1:]:
            out[name] = out[name].unionByName(part, allowMissingColumns=True)
    return out


def append_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """A new version with the current one's parts, as they are, and those of the rows given; other tables stay."""
    version = uuid.uuid4().hex
    number, known = _parts(spark, root)
    fresh = _written(tables, root, version)
    put_pointer(spark, root, number + 1, json.dumps({"tables": known | {name: known.get(name, []) + parts for name, parts in fresh.items()}}))
    return version


def migrated(table: DataFrame, schema: str) -> DataFrame:
    """``table`` in the columns of a schema: known ones cast, missing ones null, others left out."""
    fields = table.sparkSession.createDataFrame([], schema).schema.fields
    return table.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def recent_projects(opened: DataFrame, keep: int = 10) -> DataFrame:
    """(path, opened_at): the newest ``keep`` projects, each once; paths differ by neither slashes nor case of the drive."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/+$", "")
    clean = opened.withColumn("path", F.when(path.rlike("^[A-Za-z]:"), F.concat(F.upper(path.substr(1, 1)), F.expr("substring(regexp_replace(replace(path, '\\\\', '/'), '/+$', ''), 2)"))).otherwise(path))
    return first_by(clean, ["path"], [F.col("opened_at").desc()]).orderBy(F.col("opened_at").desc(), "path").limit(keep)
