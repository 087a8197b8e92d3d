"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayforge.operators.rounds import Rounds

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session_ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the bytes of an Arrow batch.

    Batches are cut by bytes as well as by rows, so that a run of very long texts does
    not fill a worker's memory.
    """
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)),
    ):
        spark.conf.set(key, value)


class Scratch(Rounds):
    """Parquet tables in the shared checkpoint folder; they cut lineage and survive executors.

    ``drop`` removes a table once nothing lazy needs it; what is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, tag: str):
        session_ready(spark)
        super().__init__(spark, f"scratch-{tag}")

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.keep(df, name)

    def settle(self) -> None:
        """Let go of shuffle files that no live plan needs: Spark removes them when its driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def hidden(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    x = "__"
    while any(c.lower().startswith(x) for c in df.columns):
        x += "_"
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col, n: int):
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left", share: int = 1000) -> DataFrame:
    """rows with the columns of their group, of which `size` says how many rows it has; rows without a group (or with a
    null key) have nulls, or go if how is "inner". groups has a row for each key; both are read several times, so they
    should be tables.

    Groups with more than 1 / share of all grouped rows are fewer than `share`, so they are broadcast, and
    their rows stay where they are; the others are shuffled, and none is large.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * share > total)
    cold = groups.where(F.col(size) * share <= total)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    out = few.unionByName(rest.select(*few.columns))
    if how == "inner":
        return out
    none = rows.where(F.col(key).isNull()).select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in few.columns))
    return out.unionByName(none)
