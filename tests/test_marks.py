"""Stateful marks against plain sessions."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom.streaming import live, marks

FAR = 10**9


def sessions(rows, wait):
    """(path, first, last, due, n) of the marks (path, ms) by plain loops."""
    out = []
    for path in {p for p, _ in rows}:
        own = sorted(ms for p, ms in rows if p == path)
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k] - own[k - 1] >= wait:
                out.append((path, own[start], own[k - 1], own[k - 1] + wait, k - start))
                start = k
    return sorted(out)


def test_bursts_join_and_clear():
    assert marks.joined([(0, 0, 1), (99, 99, 1), (50, 50, 1), (300, 300, 2)], 100) == [(0, 99, 3), (300, 300, 2)]
    assert marks.joined([(0, 0, 1), (100, 100, 1)], 100) == [(0, 0, 1), (100, 100, 1)]
    assert marks.without([(0, 99, 3), (300, 300, 2)], 99) == [(300, 300, 2)]


def run(spark, tmp_path, given):
    """Runs the stream over the files that are there."""
    stream = spark.readStream.schema("path string, ms long, synced boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    live.run_to(marks.due_marks(stream, 100, "0 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/progress").awaitTermination()
    return sorted(map(tuple, spark.read.schema(marks.DUE).parquet(f"file://{tmp_path}/out").collect()))


def test_a_stream_that_starts_again_equals_sessions(spark, tmp_path):
    marks.stateful(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rnd, clock, batches = random.Random(1), 1000, []
    for _ in range(3):
        own = []
        for _ in range(30):
            clock += rnd.choice([0, 1, 20, 90, 100, 101, 250])
            own.append((f"p{rnd.randrange(4)}", clock))
        rnd.shuffle(own)
        batches.append(own)
    put = lambda k, rows: spark.createDataFrame([(*r, False) if len(r) == 2 else r for r in rows], "path string, ms long, synced boolean").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    try:
        put(0, [*batches[0], (None, 5)])
        first = run(spark, tmp_path, batches[:1])
        put(1, batches[1])
        run(spark, tmp_path, batches[:2])
        put(2, batches[2])
        put(3, [("end", FAR)])
        put(4, [("end", 2 * FAR)])
        got = [r for r in run(spark, tmp_path, batches) if r[0] != "end"]
        assert got == sessions([r for own in batches for r in own], 100)
        assert set(first) <= set(got)
        # A sync clears what was marked before it; a later mark is due again.
        put(5, [("s", 3 * FAR), ("s", 3 * FAR + 10), ("t", 3 * FAR), ("s", 3 * FAR + 10, True), ("t", 3 * FAR - 1, True)])
        put(6, [("end", 4 * FAR)])
        put(7, [("end", 5 * FAR)])
        assert [r for r in run(spark, tmp_path, batches) if r[0] in "st"] == [("t", 3 * FAR, 3 * FAR, 3 * FAR + 100, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


class Handle:
    """Timers of one path, with the number of calls."""

    def __init__(self):
        self.timers, self.calls, self.value = set(), 0, None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_calls_for_timers_do_not_grow_with_open_bursts():
    handle, own = Handle(), marks.Marks(100)
    own.init(handle)
    for k in range(3):
        assert list(own.handleInputRows(("p",), (Row(path="p", ms=1000 * i + k, synced=False) for i in range(500)), Watermark(0))) == []
    assert handle.timers == {102} and handle.calls <= 5
    fired, out = Watermark(400_050), []
    while due := [t for t in sorted(handle.timers) if t <= fired.at]:
        out += own.handleExpiredTimer(("p",), fired, type("Info", (), {"getExpiryTimeInMs": lambda self, at=due[0]: at})())
        handle.timers.discard(due[0])
    assert [r.first_ms for r in out] == [1000 * i for i in range(400)] and {r.n_marks for r in out} == {3}
    assert handle.timers == {400_102} and handle.calls <= 7
    # A sync of all that is open leaves no timer.
    list(own.handleInputRows(("p",), [Row(path="p", ms=10**7, synced=True)], Watermark(0)))
    assert handle.timers == set() and not handle.exists()
