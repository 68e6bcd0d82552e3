"""Change marks as a stateful stream: a burst of marks of a path is due once the path has been quiet.

The state of a path is its open bursts. A mark within the quiet time of a burst
joins it; a path has one timer, at its first due time, and once the watermark
passes it all bursts that are due by then are emitted and cleared, so calls to
the state store grow with paths and batches, not with open bursts. A sync of the
path clears what was marked up to it.
State and timers are in the checkpoint, so a stream that starts again goes on
where it was. Late marks may join two bursts into one while both are open, so
results equal session windows over the same marks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.streaming.live import DEBOUNCE_MS

#: First and last mark and number of marks of each open burst, one after another.
STATE = "bursts array<long>"
DUE = "path string, first_ms long, last_ms long, due_ms long, n_marks long"
#: What a transformWithState query needs of the session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(bursts: list[tuple[int, int, int]], wait: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of bursts, those nearer than the quiet time as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(bursts):
        if out and first < out[-1][1] + wait:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def without(bursts: list[tuple[int, int, int]], synced: int) -> list[tuple[int, int, int]]:
    """The bursts that a sync doesn't clear: those whose last mark came after it."""
    return [b for b in bursts if b[1] > synced]


class Marks(StatefulProcessor):
    """Input rows have path, ms and synced (whether the row is a sync); output is DUE."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bursts", STATE)

    def _known(self) -> list[tuple[int, int, int]]:
        flat = list(self.state.get()[0]) if self.state.exists() else []
        return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))

    def _first_due(self, bursts: list[tuple[int, int, int]]) -> int | None:
        return min((last + self.wait for _, last, _ in bursts), default=None)

    def _keep(self, bursts: list[tuple[int, int, int]], timer: int | None) -> None:
        """Stores the bursts; ``timer`` is the one that is still set."""
        due = self._first_due(bursts)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if bursts:
            self.state.update(([x for b in bursts for x in b],))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, synced = self._known(), []
        bursts = list(known)
        for r in rows:
            if r.synced:
                synced.append(r.ms)
            else:
                bursts.append((r.ms, r.ms, 1))
        bursts = joined(bursts, self.wait)
        self._keep(without(bursts, max(synced)) if synced else bursts, self._first_due(known))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, bursts = timerValues.getCurrentWatermarkInMs(), self._known()
        due = [b for b in bursts if b[1] + self.wait <= now]
        if due:  # the timer that is set has expired
            self._keep([b for b in bursts if b[1] + self.wait > now], None)
        return iter([Row(path=key[0], first_ms=a, last_ms=b, due_ms=b + self.wait, n_marks=n) for a, b, n in due])


def due_marks(marks: DataFrame, wait_ms: int = DEBOUNCE_MS, late: str = "10 minutes") -> DataFrame:
    """DUE rows of a stream of marks (path, ms, synced), each once the watermark, ``late`` behind the newest mark, has passed its due time.

    Marks that come later than that aren't counted. Rows of a null path or time
    are left out. Needs the RocksDB state store (``stateful``).
    """
    own = marks.where("path is not null and ms is not null").select("path", "ms", F.coalesce("synced", F.lit(False)).alias("synced"), F.timestamp_millis("ms").alias("at"))
    return own.withWatermark("at", late).groupBy("path").transformWithState(Marks(wait_ms), DUE, "Append", "EventTime")


def stateful(spark: SparkSession) -> None:
    """Sets the state store that due_marks needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
