"""Ranking and greedy one-to-one matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.operators.rounds import Rounds


def greedy(pairs: DataFrame, score: str = "score", one_sided: bool = True, group: list[str] | None = None) -> DataFrame:
    """The pairs that a greedy pass in order (score desc, j, i) takes, each end used once.

    Locally dominant pairs, best of both their ends, are what the sequential pass takes too; they are taken
    in rounds until no pair is left, and pairs of used ends drop out. one_sided: i and j are different kinds (bipartite);
    else an end is used on either side. Ends are per group.
    """
    group = group or []
    rounds = Rounds(pairs.sparkSession, "greedy")
    order = [F.desc(score), "j", "i"]
    left, taken = rounds.keep(pairs), []
    while not left.isEmpty():
        if one_sided:
            top = left.withColumns({"__a": F.row_number().over(W.partitionBy(*group, "i").orderBy(*order)), "__b": F.row_number().over(W.partitionBy(*group, "j").orderBy(*order))})
            best = top.where("__a = 1 and __b = 1").drop("__a", "__b")
        else:
            rank = F.struct((-F.col(score)).alias("s"), F.col("j").alias("j"), F.col("i").alias("i"))
            ends = left.select(*group, F.explode(F.array("i", "j")).alias("end"), rank.alias("rank"))
            low = ends.groupBy(*group, "end").agg(F.min("rank").alias("rank"))
            hit = low.select(*group, F.col("rank.i").alias("i"), F.col("rank.j").alias("j")).groupBy(*group, "i", "j").count().where("count = 2").drop("count")
            best = left.join(hit, [*group, "i", "j"], "left_semi")
        best = rounds.keep(best.select(*pairs.columns))
        taken.append(best)
        if one_sided:
            rest = left.join(best.select(*group, "i"), [*group, "i"], "left_anti").join(rounds.again(best).select(*group, "j"), [*group, "j"], "left_anti")
        else:
            used = best.select(*group, F.explode(F.array("i", "j")).alias("end"))
            rest = left.join(used.withColumnRenamed("end", "i"), [*group, "i"], "left_anti").join(rounds.again(best).select(*group, F.explode(F.array("i", "j")).alias("j")), [*group, "j"], "left_anti")
        new = rounds.keep(rest.select(*pairs.columns))
        rounds.drop(left)
        left = new
    return rounds.all_of(taken) if taken else left


def best_per_i(pairs: DataFrame, order: list) -> DataFrame:
    """Many to one: the first row of each i."""
    return pairs.withColumn("__r", F.row_number().over(W.partitionBy("i").orderBy(*order))).where("__r = 1").drop("__r")


def combined(direct: DataFrame, projected: DataFrame) -> DataFrame:
    """Direct matches first, then projected ones by distance; one row for each i."""
    both = direct.select("i", "j", F.lit("direct").alias("kind"), "distance").unionByName(projected.select("i", "j", F.lit("projection").alias("kind"), "distance"))
    return best_per_i(both, [(F.col("kind") == "projection").cast("int"), "distance", "j"])


def match_score(hausdorff: Column, length_ratio: Column, overlap: Column, similarity: Column) -> Column:
    return 0.3 * (1 - F.least(hausdorff / 40.0, F.lit(1.0))) + 0.25 * length_ratio + 0.25 * overlap + 0.2 * (similarity + 1) / 2


def good_match(length_ratio: Column, overlap: Column, similarity: Column) -> Column:
    return (length_ratio >= 0.3) & (overlap >= 0.3) & (similarity >= 0.7)


def length_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)
