"""Intermediate tables of an operator, written to the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root


class Scratch:
    """A folder of Parquet tables below ``spark.checkpoint.dir``.

    Written tables cut the lineage: a lost executor costs the tasks it ran, not the
    stages before. ``drop`` removes a table that no later step reads, ``close`` all of them; whatever
    is left goes when the Spark application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def close(self) -> None:
        """Removes all tables; whoever reads one of them must have written its result by then."""
        self._fs.delete(self._path(self.root), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
