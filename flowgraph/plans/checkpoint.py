"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, and only where that is unset (a local session, as in tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="flowgraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str = "step") -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and any executor may be lost later."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written step, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Steps:
    """The written steps of one program, by name. A step replaces the one of its name, whose files go once the new ones are
    complete; what still has to be read later needs a name of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, {}, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def put_bucketed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """A step that is dealt out by its key once, as a bucketed table with its files in the shared folder: joins on the key
        then shuffle their other side only."""
        path, n = new_path(self.spark, name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
        self.drop(name)
        self.paths[name], self.tables[name] = path, table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if table := self.tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys once and kept: joins on the keys in a loop then shuffle their other side only. Parts that are
    lost with an executor are made again from df. Call unpersist() after the loop."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).persist()


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted no further); else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
