"""Readers, writers and streaming operators on small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import archive, documents, prices
from tidewater.sources import files
from tidewater.streaming import windows


def test_delimited_strips_marks_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿SYMBOL , SERIES,CLOSE\nABC , EQ, 10.5\n,EQ,\n", encoding="utf-8")
    got = files.delimited(spark, str(tmp_path / "a.csv"), {"SYMBOL": "symbol", "CLOSE": "close"})
    assert [tuple(r) for r in got.collect()] == [("ABC", "10.5"), (None, None)]
    with pytest.raises(ValueError, match="VOLUME"):
        files.delimited(spark, str(tmp_path / "a.csv"), {"VOLUME": "v"})


def test_json_and_xml_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"id": 1, "name": "x"}, {"id": 2}], "more": 3}')
    (tmp_path / "b.json").write_text('{"data": []}')
    got = files.json_rows(spark, str(tmp_path / "*.json"), "data array<struct<id: int, name: string>>", "data")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]
    (tmp_path / "a.xml").write_text("<all><row><k>1</k></row><row><k>2</k></row></all>")
    assert sorted(r.k for r in files.xml_rows(spark, str(tmp_path / "a.xml"), "row").collect()) == [1, 2]


def test_blobs_are_stored_once_by_content(spark, tmp_path):
    for name, body in (("a", b"one"), ("b", b"two"), ("c", b"two"), ("d", b"")):
        (tmp_path / name).write_bytes(body)
    found = files.blobs(spark, str(tmp_path))
    stored = found.where(F.col("path").endswith("/a")).select("sha256")
    assert sorted(bytes(r.body) for r in files.new_blobs(found, stored).collect()) == [b"two"]  # Spark reads no empty files
    assert sorted(r.c for r in found.select(files.body_check(F.col("body")).alias("c")).collect()) == ["ok", "ok", "ok"]


def test_tables_that_are_missing_are_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    path = str(tmp_path / "t")
    assert files.table_or_empty(spark, path, schema).count() == 0
    files.written_table(spark.createDataFrame([(1,)], schema), path)
    files.written_table(spark.createDataFrame([(2,)], schema), path)
    assert [r.k for r in files.table_or_empty(spark, path, schema).collect()] == [2]


def test_archive_views_and_ids(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, False, "y"), (3, None, "z")], "k int, kept boolean, drop_reason string").withColumns({"first_seen": F.lit(1), "last_seen": F.lit(1)})
    clean = archive.clean_view(df)
    assert clean.columns == ["k"] and sorted(r.k for r in clean.collect()) == [1, 3]
    ids = spark.createDataFrame([(1, None), (1, "a"), (1, None)], "a int, b string").select(archive.event_id(["b", "a"]).alias("x"), archive.event_id(["a", "b"]).alias("y")).collect()
    assert all(r.x == r.y for r in ids) and len({r.x for r in ids}) == 2


def test_quotes_and_preferred_series(spark):
    df = spark.createDataFrame([("The  profit\nrose by 5 %.", "profit rose BY 5 %"), ("The profit fell", "profit rose"), (None, "x")], "t string, q string")
    assert [r.c for r in df.select(documents.contains_quote(F.col("t"), F.col("q")).alias("c")).collect()] == ["loose", "no", "no"]
    rows = spark.createDataFrame([("a", "BE", 1), ("a", "EQ", 2), ("b", "BE", 3)], "k string, series string, v int")
    assert {r.v for r in prices.preferred_series(rows, ["k"], (F.col("series") != "EQ").cast("int")).collect()} == {2, 3}


def _streamed(query, spark, name, mode):
    started = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    started.awaitTermination(120)
    return spark.table(name)


def test_streams_of_gap_sessions_and_first_rows(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    rows = [("a", at(0)), ("a", at(10)), ("a", at(100)), ("b", at(5)), ("b", at(5)), ("a", at(10_000))]
    schema = "k string, ts timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    struct = spark.read.parquet(str(tmp_path / "in")).schema
    stream = windows.parquet_stream(spark, str(tmp_path / "in"), struct)
    closed = _streamed(windows.gap_sessions(stream, "ts", "30 minutes", "k", late="1 hour"), spark, "gaps", "append")
    batch = windows.gap_sessions(spark.createDataFrame(rows, schema), "ts", "30 minutes", "k", late="1 hour")
    assert {(r.k, r.n) for r in batch.collect()} == {("a", 2), ("a", 1), ("b", 2)}
    assert {(r.k, r.n) for r in closed.collect()} <= {("a", 2), ("a", 1), ("b", 2)} and closed.count() == 3
    first = _streamed(windows.once(stream, "ts", ["k", "ts"], late="1 hour"), spark, "firsts", "append")
    assert first.count() == 5
