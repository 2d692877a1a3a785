"""The folder that driver and executors share, tables written there to cut lineage, removal of folders, and numbers of tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, at least as long as there are fewer tasks than shuffle partitions, and at most.
LEAST_ROWS, MOST_ROWS = 20_000, 300_000


def tasks_for(spark: SparkSession, n: int, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> int:
    """Tasks that n rows are dealt over: their number grows with the rows, so that what one of them holds does not."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, n // least), -(-n // most))


def dealt(rows: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """Rows exchanged by a key over so many tasks; None leaves their number to Spark."""
    return rows.repartition(tasks, *key) if tasks else rows.repartition(*key)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without one the warehouse, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """A table written to the shared folder, in folders by some columns, and read back: its lineage is cut, and it outlives
    executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, of any store that Spark reads; none if it is not there."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    p, fs = _path(spark, path)
    fs.delete(p, True)
