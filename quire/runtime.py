"""What operators need from the session: table access, lineage cuts, chunked text handling."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def local_session(app: str = "quire", cpus: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on this machine alone, as in tests, may go without the setting; it gets a folder made here.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get("at")
    if where is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _own_folder["at"] = tempfile.mkdtemp(prefix="quire-cut-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there, which ends its lineage.

    A table rather than checkpoint(): the plan of a checkpoint keeps the estimated
    size of what it came from, and in a loop of joins that estimate squares with each
    round until planning takes longer than the work. The files' true size lets small
    sides be broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def cut_bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """cut() to a table bucketed by keys: aggregations and joins on them need no further shuffle.

    The one shuffle is here; each of its tasks writes one bucket.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(n, *keys).write.format("parquet").option("path", path).bucketBy(n, *keys).saveAsTable(name)
    _remove_at_end(spark, path)
    out = spark.table(name)
    out._quire_path, out._quire_name = path, name
    return out


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver remove a path when it ends; what is released before is gone by then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def release(*cuts: DataFrame) -> None:
    """Remove the tables behind cut() and cut_bucketed() that no later plan reads."""
    for df in cuts:
        name, path = getattr(df, "_quire_name", None), getattr(df, "_quire_path", None)
        if name:
            df.sparkSession.sql(f"drop table if exists {name}")
        if not path:
            continue
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores; one that has them already stays as it is.

    For scans before costly Python functions: a small file is one partition.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df with the global row number (from 1) in an order, without sorting all rows in one task.

    Rows are sorted within range partitions and kept as a table; the partitions'
    counts, one row each, give the offsets. Ties are numbered in any order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    kept = cut(rows.withColumns({"_part": part, "_in": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_in") + 1).drop("_part", "_in", "_off")


def blank_to_null(c: Column) -> Column:
    """Null for strings of nothing but white space (Unicode blanks included)."""
    return F.when(F.length(F.regexp_replace(c, r"[\s  -​　﻿]+", "")) > 0, c)
