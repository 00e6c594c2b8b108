"""File and table sources, and the scored-transfer sink."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import CSV_SCHEMA, TABLES


def read_transfers_csv(spark: SparkSession, path: str, schema: T.StructType | str = CSV_SCHEMA) -> DataFrame:
    """Labelled transfers from CSV with a header, under a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_table(spark: SparkSession, source: str, name: str, **jdbc: str) -> DataFrame:
    """One relational table: parquet under ``source``, or JDBC when ``source`` is a ``jdbc:`` URL.

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    so that the read is split; ``user``, ``password`` and ``driver`` are passed through.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {sorted(TABLES)}")
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, dbtable=name, **jdbc).load()
    return spark.read.schema(TABLES[name]).parquet(f"{source}/{name}")


def write_scored(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append scored transfers, one folder per day.

    Rows are not repartitioned by day: that would send a whole day to one task. AQE
    rebalances instead, which splits large days and merges small ones.
    """
    daily = df.withColumn("dt", F.to_date("ts")).hint("rebalance", F.col("dt"))
    daily.write.mode(mode).partitionBy("dt").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Append scored transfers as the batch ``batch``, at most once; False if that batch is already committed.

    A batch owns the folder ``batch=<key>``, with one folder per day in it. Spark's success
    marker, which the driver sets after all tasks have committed, is its entry in the ledger:
    ``read_scored`` reads only folders that have it. A job that dies leaves rows that nobody
    reads, and its repeat overwrites them, days included that the repeat no longer has. One
    writer per batch key at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"batch keys hold letters, digits, dots, dashes and underscores: {batch!r}")
    spark, folder = df.sparkSession, f"{path}/batch={batch}"
    if _matching(spark, f"{folder}/_SUCCESS"):
        return False
    daily = df.withColumn("dt", F.to_date("ts")).hint("rebalance", F.col("dt"))
    # The whole folder is replaced, whatever the session says about single partitions; the marker is set whatever the session says, too.
    writer = daily.write.mode("overwrite").option("partitionOverwriteMode", "static").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    writer.partitionBy("dt").parquet(folder)
    return True


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Keys of the batches under ``path`` whose write was completed."""
    return [m.split("/batch=")[-1].removesuffix("/_SUCCESS") for m in _matching(spark, f"{path}/batch=*/_SUCCESS")]


def read_scored(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Scored transfers: all rows of ``write_scored``, or the committed batches of ``append_batch`` with their key in ``batch``.

    ``schema`` (with ``dt``) saves reading the footers; it is needed where every committed batch is empty.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if not _matching(spark, f"{path}/batch=*"):
        return reader.parquet(path)
    folders = [f"{path}/batch={b}" for b in committed_batches(spark, path)]
    if not folders:
        if schema is None:
            raise ValueError(f"no batch under {path} is committed; give a schema to read it as an empty table")
        return spark.createDataFrame([], schema)
    return reader.option("basePath", path).parquet(*folders)
