"""Files in a stream with timers, against the batch form and a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidewater.streaming import retries

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "file_id string, at timestamp, status string, reason string"


def hours(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture
def keyed(spark):
    old = {k: spark.conf.get(k, None) for k in retries.STORE}
    for k, v in retries.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, tmp_path, batches, **limits):
    """All rows that the stream gives for batches of sights, one file a batch."""
    source, out = tmp_path / "in", []
    source.mkdir()
    def keep(batch, number):
        out.extend((number, *r) for r in batch.collect())
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{i}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
        made = retries.retry_stream(stream, **limits).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
        made.awaitTermination()
    return out


def plain(rows, most=3, wait=6):
    """The standing of each file by a loop over its rows."""
    out = {}
    for f in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == f and r[1] is not None]
        if not mine:
            continue
        tries = {r[1] for r in mine if r[2] is not None}
        if any(r[2] in ("ok", "no_text") for r in mine):
            status = "done"
        elif any(r[2] is not None and "404" in (r[3] or "") for r in mine):
            status = "gone"
        else:
            status = "given_up" if len(tries) >= most else "failed" if tries else "new"
        out[f] = (min(r[1] for r in mine), max(r[1] for r in mine), len(tries), status, max(tries) + dt.timedelta(hours=wait) if status == "failed" else None)
    return out


ODD = [("a", hours(0), None, None), ("a", hours(0), None, None), ("b", hours(1), "failed", "timeout"), ("b", hours(1), "failed", "timeout"), ("c", hours(2), "failed", "HTTP 404"), ("d", hours(2), "no_text", None), ("e", None, "ok", None), (None, hours(1), "ok", None), ("f", hours(3), "failed", "HTTP 4040")]


def test_batch_form_equals_a_loop(spark):
    turn = random.Random(5)
    rows = [("f" + str(turn.randrange(30)), hours(turn.randrange(40)), turn.choice([None, None, "failed", "failed", "ok"]), turn.choice([None, "HTTP 404", "busy"])) for _ in range(150)]
    odd = [r for r in ODD if r[0] != "f"]
    got = {r.file_id: tuple(r)[1:] for r in retries.retry_table(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert got == plain(rows + odd)
    assert retries.retry_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_a_missing_document_is_gone(spark):
    got = {r.file_id: r.status for r in retries.retry_table(spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert got == {"a": "new", "b": "failed", "c": "gone", "d": "done", "f": "failed"}
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("z",)], "file_id string")
    assert sorted(r.file_id for r in retries.still_to_try(listed, retries.retry_table(spark.createDataFrame(ODD, SCHEMA))).collect()) == ["a", "b", "z"]


def test_stream_with_replays_and_late_rows_equals_batch(keyed, tmp_path):
    turn = random.Random(7)
    rows = [("f" + str(turn.randrange(12)), hours(turn.randrange(60)), turn.choice([None, "failed", "failed", "ok"]), turn.choice([None, "busy"])) for _ in range(60)]
    batches = [rows[:20], rows[10:40], rows[30:], ODD]
    got = {}
    for r in streamed(keyed, tmp_path, batches):
        if r[-1] == "told":
            got[r[1]] = r[2:7]
    want = {r.file_id: tuple(r)[1:] for r in retries.retry_table(keyed.createDataFrame(rows + ODD, SCHEMA)).collect()}
    assert got == want


def test_a_timer_calls_once_when_a_try_is_due(keyed, tmp_path):
    batches = [[("a", hours(0), "failed", "busy"), ("b", hours(0), "failed", "busy")], [("b", hours(1), "ok", None), ("z", hours(5), None, None)], [("z", hours(9), None, None)], [("z", hours(30), None, None)]]
    told = streamed(keyed, tmp_path, batches, late="1 hour")
    due = [r for r in told if r[-1] == "due"]
    assert [(r[1], r[5], r[6]) for r in due] == [("a", "failed", hours(6))]
