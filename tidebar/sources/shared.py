"""Folders and files that the driver and all executors see: written intermediate tables, listings, first lines."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster's executors share. Only a local session may do without it; it uses its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


_WRITTEN: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage and survives lost executors. `drop_written` removes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def drop_written(spark: SparkSession) -> int:
    """Remove all tables that `written` made in this process, when no frame reads them any more; how many there were."""
    gone = 0
    while _WRITTEN:
        fs, at = _path(spark, _WRITTEN.pop())
        gone += bool(fs.delete(at, True))
    return gone


def listed(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in ms) of all data files under paths, folders or globs, in order of paths. One call of the store for each."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        fs, at = _path(spark, p)
        for found in fs.globStatus(at) or []:
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(set(out))


def first_line(spark: SparkSession, path: str) -> str:
    """A file's first line without its end and byte-order mark ('' of an empty file); only the beginning is read."""
    fs, at = _path(spark, path)
    lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        return (lines.readLine() or "").lstrip("﻿").strip()
    finally:
        lines.close()
