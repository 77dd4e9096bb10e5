"""Written tables that cut lineage, and the broadcast rule.

A plan that reads one intermediate more than once writes it as Parquet into the shared folder and goes
on from the written files: nothing is computed twice, a lost executor costs only its own tasks, and the
later scans still prune columns and push filters down.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormglass.functions.values import CALENDAR_DAYS

MAX_BROADCAST_BYTES = 256 * 1024 * 1024

_written: dict[str, list[str]] = {}


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def default_folder(spark: SparkSession, warehouse: str, master: str) -> str:
    """Folder below the warehouse, resolved by Hadoop; a driver's own disk serves only a local master."""
    target, system = _file_system(spark, f"{warehouse.rstrip('/')}/_stormglass")
    folder = system.makeQualified(target).toString()
    one_process = re.fullmatch(r"local(\[[^\]]*\])?", master)
    if folder.startswith("file:") and not one_process:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach: the cluster's checkpoint folder, else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = default_folder(spark, spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder; it is removed by ``release`` or when the application ends."""
    path = f"{shared_folder(spark)}/stormglass/{name}-{uuid.uuid4().hex}"
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written_paths(spark: SparkSession) -> list[str]:
    """Paths handed out and not released yet, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables whose last reader is done."""
    held = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        target, system = _file_system(spark, path)
        system.delete(target, True)
        system.cancelDeleteOnExit(target)
        if path in held:
            held.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(schema: T.StructType) -> int:
    return sum(64 if isinstance(f.dataType, T.StringType) else 16 for f in schema.fields)


def broadcast_list(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of at most ``rows`` rows, known when the plan is built.

    Beyond the byte limit there is no hint and Spark chooses from its own statistics, which ends in a
    sort-merge join.
    """
    return F.broadcast(df) if rows * _width(df.schema) <= MAX_BROADCAST_BYTES else df


def broadcast_days(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table with one row per date: the calendar bounds its rows."""
    return broadcast_list(df, CALENDAR_DAYS)
