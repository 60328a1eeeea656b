"""What a collector knows of each file: first and last sight, tries, and when to try again; the same from a stream or a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Statuses that finish a file, and the errors that will not mend.
DONE = ("ok", "no_text")
GONE = r"(?i)HTTP\s*(?:404|410)\b"

#: Times are microseconds in the state, which has no zone to get wrong.
RESULT = "file_id string, first_seen long, last_seen long, tries int, status string, due_at long, change string"


def _standing(tries: list, most: int, wait: int) -> tuple[str, int | None]:
    """(status, due_at) of a file's tries (at, done, gone), in any order."""
    if any(done for _, done, _ in tries):
        return "done", None
    if any(gone for _, _, gone in tries):
        return "gone", None
    if len(tries) >= most:
        return "given_up", None
    return ("failed", max(at for at, _, _ in tries) + wait) if tries else ("new", None)


class Retries(StatefulProcessor):
    """Keeps for each file its first and last sight and its tries by time; a timer calls when the next try is due.

    Sights only widen a span and tries are kept by their time, so replays and late rows change nothing
    that order in time would not. A file's state is as large as its tries.
    """

    def __init__(self, most: int, wait_hours: int) -> None:
        self.most, self.wait = most, wait_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_seen long, last_seen long")
        self.tries = handle.getMapState("tries", "at long", "done boolean, gone boolean")

    def _row(self, key, change: str) -> Row:
        tries = [(k[0], v[0], v[1]) for k, v in self.tries.iterator()]
        status, due = _standing(tries, self.most, self.wait)
        first, last = self.seen.get()
        return Row(file_id=key[0], first_seen=first, last_seen=last, tries=len(tries), status=status, due_at=due, change=change)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last = self.seen.get() if self.seen.exists() else (None, None)
        for r in rows:
            first = r.micros if first is None else min(first, r.micros)
            last = r.micros if last is None else max(last, r.micros)
            if r.status is not None:
                old = self.tries.getValue((r.micros,)) if self.tries.containsKey((r.micros,)) else (False, False)
                self.tries.updateValue((r.micros,), (old[0] or r.done, old[1] or r.gone))
        self.seen.update((first, last))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        row = self._row(key, "told")
        if row.due_at is not None and timerValues.getCurrentWatermarkInMs() >= 0:
            self.handle.registerTimer(row.due_at // 1000)
        yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, "due")

    def close(self) -> None:
        pass


def _judged(sights: DataFrame) -> DataFrame:
    """Sights with a file and a time, and whether each is a try that finished, or that failed for good."""
    failed = ~F.col("status").isin(*DONE)
    return sights.dropna(subset=["file_id", "at"]).select("file_id", "at", "status", F.coalesce(~failed, F.lit(False)).alias("done"), F.coalesce(failed & F.col("reason").rlike(GONE), F.lit(False)).alias("gone"))


def retry_stream(sights: DataFrame, most: int = 3, wait_hours: int = 6, late: str = "30 days") -> DataFrame:
    """Changes of files in a stream of sights (file_id, at, status, reason): ``told`` after rows, ``due`` when the watermark passes the time of the next try.

    A row without a status is a sight in a listing, one with a status a try. Rows later than ``late`` are
    dropped by the engine. The session needs the state store of ``STORE``.
    """
    timed = _judged(sights).withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    changes = timed.groupBy("file_id").transformWithState(statefulProcessor=Retries(most, wait_hours), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen", "due_at")})


def retry_table(sights: DataFrame, most: int = 3, wait_hours: int = 6) -> DataFrame:
    """(file_id, first_seen, last_seen, tries, status, due_at): where every file stands after all sights.

    ``status``: ``done`` (a try finished), ``gone`` (one failed for good), ``given_up`` (``most`` tries or more), ``failed``
    (try again at ``due_at``) or ``new`` (never tried). Tries of one time count once; null files and times
    nowhere. Tries of one time are one row before the files are summed up, so a hot file is summed in parts.
    """
    moments = _judged(sights).groupBy("file_id", "at").agg(F.bool_or(F.col("status").isNotNull()).alias("tried"), F.bool_or("done").alias("done"), F.bool_or("gone").alias("gone"))
    told = moments.groupBy("file_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count_if("tried").cast("int").alias("tries"), F.bool_or("done").alias("done"), F.bool_or("gone").alias("gone"), F.max(F.when(F.col("tried"), F.col("at"))).alias("tried_at"))
    status = F.when(F.col("done"), "done").when(F.col("gone"), "gone").when(F.col("tries") >= most, "given_up").when(F.col("tries") > 0, "failed").otherwise("new")
    return told.select("file_id", "first_seen", "last_seen", "tries", status.alias("status"), F.when(status == "failed", F.col("tried_at") + F.expr(f"INTERVAL {wait_hours} HOURS")).alias("due_at"))


def still_to_try(listed: DataFrame, standings: DataFrame) -> DataFrame:
    """Listed files that are neither done, gone nor given up."""
    closed = standings.where(F.col("status").isin("done", "gone", "given_up")).select("file_id")
    return listed.join(closed, "file_id", "left_anti")
