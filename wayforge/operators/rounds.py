"""Tables between the steps of iterative operators, in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is set, a folder in the warehouse, which executors share too."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps").rstrip("/")


class Rounds:
    """Writes each step as Parquet, which cuts lineage and outlives executors; removes what is dropped, and the rest when the driver exits."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.read([path], df.schema)

    def read(self, paths: list[str], schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(*paths)
        out._paths = paths
        return out

    def again(self, df: DataFrame) -> DataFrame:
        """The same table read anew, for plans that use it twice."""
        return self.read(df._paths, df.schema)

    def all_of(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of one schema as one scan, however many there are."""
        return self.read([p for t in tables for p in t._paths], tables[0].schema)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            for path in t._paths:
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass
