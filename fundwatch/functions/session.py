"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_session(spark: SparkSession) -> SparkSession:
    """Fix the session time zone: naive timestamps are UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only for local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_TABLES: list[str] = []


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` left joined with the row of its ``key`` in a written ``table``; rows without a key go round the join.

    Both sides are then plain shuffles, which is what AQE needs to split a key that holds a
    large part of ``df``.
    """
    none = df.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key])
    joined = df.filter(F.col(key).isNotNull()).join(table, key, "left")
    return joined.unionByName(none)


def release(spark: SparkSession) -> int:
    """Remove the tables that ``cut`` has written in this process; call it once the results built on them are written."""
    count, jvm = len(_TABLES), spark._jvm
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Iterative operators call this once per hop: the plan stays short, the hop is
    computed once, the rows survive the loss of executors, and the reader knows the
    size, so the next join is planned on real statistics. ``release`` removes the tables.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/fundwatch-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)
