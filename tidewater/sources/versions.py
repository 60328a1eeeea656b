"""Tables whose readers follow a manifest that is written last: a run that stops halfway is never seen."""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _text(spark: SparkSession, path: str) -> str:
    """A small file, read on the driver."""
    files, where = _files(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
    finally:
        stream.close()


def published(tables: dict[str, DataFrame], root: str, day: date, note: str = "", compression: str = "zstd") -> str:
    """Writes tables as one version of ``root`` and returns its name.

    Each table goes to a folder of its own first. The manifest, which names them all, is written to a
    hidden file and then renamed to the next number and the run's own name, so that two writers at once
    never meet: both versions stand, in the order of their names. Until then readers see the version
    before; folders that no manifest names are what stopped runs left (see :func:`unpublished`).
    """
    spark = next(iter(tables.values())).sparkSession
    run = f"{day.isoformat()}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("compression", compression).parquet(f"{root}/data/{run}/{name}")
    files, draft = _files(spark, f"{root}/{MANIFESTS}/.{run}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps({"day": day.isoformat(), "run": run, "tables": {name: f"data/{run}/{name}" for name in tables}, "note": note}).encode()))
    stream.close()
    number = max([0, *(int(v["name"].split("-")[0]) for v in versions(spark, root))]) + 1
    name = f"{number:09d}-{run}"
    if not files.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFESTS}/{name}.json")):
        raise OSError(f"the manifest {name} was not committed")
    return name


def versions(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of all committed versions, oldest first: name, day, run, tables and note."""
    names = [n for n in _names(spark, f"{root}/{MANIFESTS}") if n.endswith(".json") and not n.startswith(".")]
    return [{"name": n.removesuffix(".json")} | json.loads(_text(spark, f"{root}/{MANIFESTS}/{n}")) for n in names]


def current(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame | None:
    """A table of the newest version that has it, or of one version; None where there is none."""
    found = [v for v in versions(spark, root) if name in v["tables"] and version in (None, v["name"])]
    return spark.read.parquet(f"{root}/{found[-1]['tables'][name]}") if found else None


def last_good(spark: SparkSession, root: str, name: str, run_day: date, back: int = 14, include_today: bool = False) -> tuple[date, DataFrame] | None:
    """The table of the nearest day before ``run_day`` (or of it), at most ``back`` days ago; of a day's versions the newest."""
    first, last = run_day - timedelta(days=back), run_day - timedelta(days=0 if include_today else 1)
    found = [v for v in versions(spark, root) if name in v["tables"] and first <= date.fromisoformat(v["day"]) <= last]
    if not found:
        return None
    best = max(found, key=lambda v: (v["day"], v["name"]))
    return date.fromisoformat(best["day"]), spark.read.parquet(f"{root}/{best['tables'][name]}")


def dated_tables(spark: SparkSession, root: str, file: str = "data.parquet") -> list[tuple[str, str]]:
    """(day, path) of each ``<root>/<day>/<file>``, in order of days; folders without the file are left out."""
    files, _ = _files(spark, root)
    paths = [(day, f"{root}/{day}/{file}") for day in _names(spark, root)]
    return [(day, path) for day, path in paths if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path))]


def unpublished(spark: SparkSession, root: str) -> list[str]:
    """Runs that wrote data and committed nothing."""
    known = {v["run"] for v in versions(spark, root)}
    return [run for run in _names(spark, f"{root}/data") if run not in known]
