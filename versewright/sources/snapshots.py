"""Versions of a store of scriptures: a load writes files of its own, and one small file switches all readers over.

``data/<table>/load=<id>`` holds what one load has read and is never changed. The manifest of a version has a row for each
archive, ``file, stamp, load, listed``, that tells which load's rows are its own. A version is a file with its number in
``versions`` that names the load whose manifest it is; readers take the highest one, so that they see all tables of one version whatever a load is doing, and a
load that stops anywhere leaves the version before it whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import attach

MANIFEST = "file string, stamp string, load string, listed boolean"


class Conflict(RuntimeError):
    """Another load has made a version meanwhile; the one that lost is to be repeated."""


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path with its file system, in full."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(target), system


def _names(spark: SparkSession, path: str) -> list[str]:
    target, system = hadoop_path(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def current(spark: SparkSession, store: str) -> int:
    """The highest version; 0 before the first load."""
    return max((int(n) for n in _names(spark, f"{store}/versions") if n.isdigit()), default=0)


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    version = current(spark, store) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST)
    load = spark.read.text(f"{store}/versions/{version}").first()[0]
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{load}")


def read(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame:
    """The rows of a table in one version: all verses that are kept, names and information of archives in the catalog."""
    known = manifest(spark, store, version)
    if table != "verses":
        known = known.where("listed")
    rows = spark.read.option("basePath", f"{store}/data/{table}").parquet(f"{store}/data/{table}")
    rows = rows.withColumn("load", F.col("load").cast("string"))
    return attach(rows, known.select("file", "load"), ["file", "load"], "left_semi").drop("load")


def commit(spark: SparkSession, store: str, before: int, tables: dict[str, DataFrame], rows_of) -> int:
    """Write ``tables`` as a new load and ``rows_of(load)`` as the manifest of the version after ``before``."""
    load, version = f"l{uuid.uuid4().hex}", before + 1
    for table, rows in tables.items():
        if table == "verses":
            rows = rows.repartition("file", "book_ord").sortWithinPartitions("file", "book_ord", "chapter", "verse")
        rows.write.parquet(f"{store}/data/{table}/load={load}")
    rows_of(load).write.parquet(f"{store}/manifests/{load}")
    # Written aside and renamed: the file of a version is whole as soon as it's there.
    aside, system = hadoop_path(spark, f"{store}/versions/_{load}")
    out = system.create(aside, False)
    out.writeBytes(load)
    out.close()
    pointer, _ = hadoop_path(spark, f"{store}/versions/{version}")
    if system.exists(pointer) or not system.rename(aside, pointer):
        system.delete(aside, False)
        raise Conflict(f"version {version} exists already")
    return version


def expire(spark: SparkSession, store: str) -> list[str]:
    """Delete all versions but the current one and the loads that it has no rows of; returns these loads.

    Not while a load is running: what that has written isn't anybody's yet.
    """
    version = current(spark, store)
    used = {r.load for r in manifest(spark, store, version).select("load").distinct().collect()}  # a row a load, not an archive
    gone = set()
    for table in _names(spark, f"{store}/data"):
        for name in _names(spark, f"{store}/data/{table}"):
            if name.startswith("load=") and name.removeprefix("load=") not in used:
                target, system = hadoop_path(spark, f"{store}/data/{table}/{name}")
                system.delete(target, True)
                gone.add(name.removeprefix("load="))
    kept = {str(version), spark.read.text(f"{store}/versions/{version}").first()[0]} if version else set()
    for folder in ("versions", "manifests"):
        for name in _names(spark, f"{store}/{folder}"):
            if name not in kept:
                target, system = hadoop_path(spark, f"{store}/{folder}/{name}")
                system.delete(target, True)
    return sorted(gone)
