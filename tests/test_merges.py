"""Bucketed tables against full builds."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources.buckets import Bucketed, bucket_of
from graphloom.streaming import live

KEYS = {"symbols": "file_path", "edges": "from_path"}


class Project:
    """Files with names and with references to names; a reference goes to the first file that has its name."""

    def __init__(self, spark, seed):
        self.spark, rnd = spark, random.Random(seed)
        self.files = {f"f{k:02d}": ({rnd.choice("abcdefgh") for _ in range(2)}, {rnd.choice("abcdefgh") for _ in range(3)}) for k in range(20)}

    def symbols(self, paths=None):
        rows = [(p, n) for p, (names, _) in self.files.items() if paths is None or p in paths for n in sorted(names)]
        return self.spark.createDataFrame(rows, "file_path string, name string")

    def refs(self):
        return self.spark.createDataFrame([(p, n) for p, (_, refs) in self.files.items() for n in sorted(refs)], "from_path string, name string")

    def edges_of(self, paths, symbols):
        owner = symbols.groupBy("name").agg(F.min("file_path").alias("to_path"))
        asked = self.refs().join(paths.select(F.col("path").alias("from_path")), "from_path", "left_semi")
        return asked.join(owner, "name").where("from_path <> to_path").select("from_path", "to_path", "name")

    def asking(self, fresh):
        return self.refs().join(fresh.select("name").distinct(), "name", "left_semi").select(F.col("from_path").alias("path")).distinct()

    def full(self):
        owner = {}
        for p in sorted(self.files):
            for n in self.files[p][0]:
                owner.setdefault(n, p)
        return sorted((p, owner[n], n) for p, (_, refs) in self.files.items() for n in refs if n in owner and owner[n] != p)


@pytest.fixture()
def quiet(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merges_equal_full_builds(spark, tmp_path, quiet):
    project, root = Project(spark, 3), f"file://{tmp_path}/t"
    paths = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    Bucketed(spark, root, KEYS, 8).create({"symbols": project.symbols(), "edges": project.edges_of(paths(project.files), project.symbols())})
    steps = [{"f00": None}, {"f05": ({"a", "b"}, {"h"}), "f11": None}, {"new": ({"c"}, {"a", "z"}), "f00": ({"d", "z"}, {"a"})}]
    for batch, step in enumerate(steps):
        for name, now in step.items():
            if now is None:
                project.files.pop(name)
            else:
                project.files[name] = now
        tables = Bucketed(spark, root, KEYS)
        before = tables.folders("symbols")
        assert live.merge_changes(tables, paths(step), batch, lambda p, own=step: project.symbols(set(own)), project.edges_of, project.asking)
        after = tables.folders("symbols")
        touched = {r[0] for r in paths(step).select(bucket_of(F.col("path"), 8)).collect()}
        assert all(before.get(k) == after.get(k) for k in range(8) if k not in touched)
        assert sorted(map(tuple, tables.read("edges").select("from_path", "to_path", "name").collect())) == project.full()
        assert sorted(map(tuple, tables.read("symbols").collect())) == sorted(map(tuple, project.symbols().collect()))
        again = Bucketed(spark, root, KEYS)
        assert not live.merge_changes(again, paths(step), batch, lambda p: project.symbols(), project.edges_of) and again.folders("symbols") == after


def test_one_changed_file_writes_one_bucket(spark, tmp_path, quiet):
    root = f"file://{tmp_path}/t"
    rows = spark.range(200).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("file_path"), F.col("id").alias("bucket"))
    tables = Bucketed(spark, root, {"symbols": "file_path"}, 16)
    tables.create({"symbols": rows})
    assert len(tables.folders("symbols")) == 16 and tables.read("symbols").columns == rows.columns
    before = tables.folders("symbols")
    changed = spark.createDataFrame([("p7",)], "path string")
    tables.merge({"symbols": (changed, rows.withColumn("bucket", F.lit(-1).cast("long")))}, 5)
    after = Bucketed(spark, root, {"symbols": "file_path"}).folders("symbols")
    assert len([k for k in before if before[k] != after[k]]) == 1
    got = {r.file_path: r.bucket for r in Bucketed(spark, root, {"symbols": "file_path"}).read("symbols").collect()}
    assert len(got) == 200 and got["p7"] == -1 and got["p8"] == 8
    late = Bucketed(spark, root, {"symbols": "file_path"})
    tables.merge({"symbols": (changed, rows)}, 6)
    with pytest.raises(OSError):
        late.merge({"symbols": (changed, rows)}, 6)
