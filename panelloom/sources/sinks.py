"""Writing stage outputs and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stage_exists(spark: SparkSession, path: str) -> bool:
    """True if a finished stage lies at ``path``, that is, one with its success marker."""
    fs, place = _file_system(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Remove a stage; its owner calls this when nothing reads it any more."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def run_stage(
    spark: SparkSession, path: str, build, period: str | None = "period", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Build and write a stage unless its finished output is there, then read it.

    Output goes to a fresh path beside the stage and is renamed when it is
    complete, so what a killed job left behind is never read; it is replaced.
    Stages are partitioned by year.  ``start`` and ``end`` limit the periods
    read and prune the folders of other years.  ``build`` is only called
    when the stage has to run.
    """
    if not stage_exists(spark, path):
        df, fresh = build(), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        if period and period in df.columns:
            # Rebalancing gives each year few large files and splits a year that is
            # too big for one writer task.
            df = df.withColumn("stage_year", F.substring(period, 1, 4)).hint("rebalance", "stage_year")
            df.write.partitionBy("stage_year").parquet(fresh)
        else:
            df.write.parquet(fresh)
        fs, place = _file_system(spark, path)
        fs.delete(place, True)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), place):
            raise OSError(f"{fresh} could not be renamed to {path}")
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("stage_year") >= int(start[:4])) & (F.col(period) >= start))
    if end is not None:
        df = df.filter((F.col("stage_year") <= int(end[:4])) & (F.col(period) <= end))
    return df.drop("stage_year")


def file_state(spark: SparkSession, paths: Sequence[str]) -> list[list]:
    """Name, length and time of the files at the paths and right below them: what a stage's inputs were."""
    out = []
    for path in paths:
        fs, place = _file_system(spark, path)
        for status in fs.globStatus(place) or []:
            found = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [[f.getPath().toString(), f.getLen(), f.getModificationTime()] for f in found]
    return sorted(out)


MANIFEST = "_manifest.json"


def _manifest(spark: SparkSession, folder: str) -> str | None:
    fs, place = _file_system(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def run_yearly_stage(
    spark: SparkSession,
    path: str,
    build: Callable[[int], DataFrame],
    start: str,
    end: str,
    parameters: Mapping | None = None,
    inputs: Sequence[str] = (),
    period: str = "period",
) -> DataFrame:
    """Build, publish and read a stage year by year; a rerun builds only what is missing or has changed.

    Each year's folder holds a manifest of the year, the periods asked for, the ``parameters`` and the state of the ``inputs``
    (``file_state``).  A year with that very manifest is finished.  Any other is built by ``build(year)`` into a
    fresh folder and renamed when complete, so a job killed at any point leaves whole years only and repeats
    at most one.  Years outside [start, end] are neither read nor touched.
    """
    state = file_state(spark, inputs)
    years = range(int(start[:4]), int(end[:4]) + 1)
    root = path.rstrip("/")
    for year in years:
        first, last = max(start, f"{year}-01"), min(end, f"{year}-12")
        wanted = json.dumps({"first": first, "last": last, "parameters": dict(parameters or {}), "inputs": state}, sort_keys=True, default=str)
        folder = f"{root}/stage_year={year}"
        if _manifest(spark, folder) == wanted:
            continue
        fresh = f"{root}/_building/{uuid.uuid4().hex}"
        build(year).filter(F.col(period).between(first, last)).write.parquet(fresh)
        fs, place = _file_system(spark, f"{fresh}/{MANIFEST}")
        out = fs.create(place)
        out.write(bytearray(wanted.encode()))
        out.close()
        drop_stage(spark, folder)
        if not fs.rename(place.getParent(), spark._jvm.org.apache.hadoop.fs.Path(folder)):
            raise OSError(f"{fresh} could not be renamed to {folder}")
    drop_stage(spark, f"{root}/_building")
    return spark.read.option("basePath", root).parquet(*[f"{root}/stage_year={y}" for y in years]).drop("stage_year")


def write_report_json(report: DataFrame, path: str) -> None:
    """Write a small report (one row per column or check) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
