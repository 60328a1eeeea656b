"""Versioned tables: readers never see a run that stopped, and two writers do not lose each other's."""

from __future__ import annotations

import datetime as dt
import threading

import pytest

from tidewater.sources import versions

DAY = dt.date(2026, 11, 2)


def values(df):
    return sorted(r.v for r in df.collect())


def frame(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v int")


def test_a_stopped_writer_leaves_readers_on_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert versions.current(spark, root, "deals") is None and versions.versions(spark, root) == []
    first = versions.published({"deals": frame(spark, 1), "filings": frame(spark, 5)}, root, DAY)

    def stop(*_):
        raise RuntimeError("stopped before the commit")

    with monkeypatch.context() as broken:
        broken.setattr(versions, "_files", stop)
        with pytest.raises(RuntimeError):
            versions.published({"deals": frame(spark, 2), "filings": frame(spark, 6)}, root, DAY)
    assert values(versions.current(spark, root, "deals")) == [1] and len(versions.unpublished(spark, root)) == 1
    second = versions.published({"deals": frame(spark, 3)}, root, DAY + dt.timedelta(days=1), "again")
    assert values(versions.current(spark, root, "deals")) == [3] and values(versions.current(spark, root, "filings")) == [5]
    assert values(versions.current(spark, root, "deals", first)) == [1] and versions.current(spark, root, "deals", "none") is None
    assert [(v["name"], v["day"], v["note"]) for v in versions.versions(spark, root)] == [(first, "2026-11-02", ""), (second, "2026-11-03", "again")]


def test_a_reader_keeps_its_version(spark, tmp_path):
    root = str(tmp_path)
    versions.published({"deals": frame(spark, 1, 2)}, root, DAY)
    held = versions.current(spark, root, "deals")
    versions.published({"deals": frame(spark, 9)}, root, DAY)
    assert values(held) == [1, 2]


def test_writers_at_once_leave_a_version_each(spark, tmp_path):
    names = []
    writers = [threading.Thread(target=lambda k=k: names.append(versions.published({"t": frame(spark, k)}, str(tmp_path), DAY))) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert [v["name"] for v in versions.versions(spark, str(tmp_path))] == sorted(names) and len(set(names)) == 4


def test_last_good_and_dated_tables(spark, tmp_path):
    root = str(tmp_path / "clean")
    for back, v in ((20, 1), (3, 2), (3, 3), (0, 4)):
        versions.published({"t": frame(spark, v)}, root, DAY - dt.timedelta(days=back))
    found = versions.last_good(spark, root, "t", DAY)
    assert (found[0], values(found[1])) == (DAY - dt.timedelta(days=3), [3])
    assert values(versions.last_good(spark, root, "t", DAY, include_today=True)[1]) == [4]
    assert versions.last_good(spark, root, "t", DAY - dt.timedelta(days=4)) is None and versions.last_good(spark, root, "other", DAY) is None
    dated = str(tmp_path / "canonical")
    for day in ("2026-11-02", "2026-10-30"):
        frame(spark, 1).write.parquet(f"{dated}/{day}/data.parquet")
    frame(spark, 1).write.parquet(f"{dated}/2026-11-01/other.parquet")
    assert versions.dated_tables(spark, dated) == [(d, f"{dated}/{d}/data.parquet") for d in ("2026-10-30", "2026-11-02")]
