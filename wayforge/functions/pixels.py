"""Pixel line segments: attributes and pair measures."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turned(dx: Column, dy: Column) -> Column:
    """STRUCT<angle, cos, sin> of a line, angle in 0 to 180, by the C library, as SQL engines have it: the last
    digits of the JVM's atan, cos and sin differ, and thresholds (0.6 of overlap) are met exactly by lines of whole pixels."""

    def each(dx: pd.Series, dy: pd.Series) -> pd.DataFrame:
        def one(x, y):
            if math.isnan(x) or math.isnan(y):
                return math.nan, math.nan, math.nan
            angle = 90.0 if abs(x) < 0.001 else math.degrees(math.atan(y / x))
            angle = angle + 180.0 if angle < 0 else angle
            return angle, math.cos(math.radians(angle)), math.sin(math.radians(angle))

        return pd.DataFrame([one(x, y) for x, y in zip(dx, dy)], columns=["angle", "cos", "sin"], dtype="float64")

    return F.pandas_udf(each, "angle double, cos double, sin double")(dx, dy)


def with_attributes(lines: DataFrame) -> DataFrame:
    """Adds dx, dy, angle (0 to 180) with its cosine and sine, length and the integer midpoint; dx, dy follow the ends as given."""
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    return lines.withColumn("turned", turned(dx, dy)).withColumns({
        "dx": dx, "dy": dy, "angle": F.col("turned.angle"), "cos": F.col("turned.cos"), "sin": F.col("turned.sin"), "length": F.sqrt(dx * dx + dy * dy),
        "mx": F.floor((F.col("x1") + F.col("x2")) / 2), "my": F.floor((F.col("y1") + F.col("y2")) / 2),
    }).drop("turned")


def fold_diff(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 180.0 - F.abs(a - b))


def perpendicular(l1: str, l2: str) -> Column:
    """Distance of the midpoint of l2 from the infinite line l1; 0 if l1 has no length."""
    c = F.col
    n = F.abs(c(f"{l1}.dy") * (c(f"{l2}.mx") - c(f"{l1}.x1")) - c(f"{l1}.dx") * (c(f"{l2}.my") - c(f"{l1}.y1")))
    return F.when(c(f"{l1}.length") > 0, n / c(f"{l1}.length")).otherwise(0.0)


def overlap(l1: str, l2: str) -> Column:
    """Interval overlap along l1, as the larger of its shares of both lines."""
    c = F.col
    at = lambda x, y: c(x) * c(f"{l1}.cos") + c(y) * c(f"{l1}.sin")
    a, b, p, q = at(f"{l1}.x1", f"{l1}.y1"), at(f"{l1}.x2", f"{l1}.y2"), at(f"{l2}.x1", f"{l2}.y1"), at(f"{l2}.x2", f"{l2}.y2")
    both = F.greatest(F.lit(0.0), F.least(F.greatest(a, b), F.greatest(p, q)) - F.greatest(F.least(a, b), F.least(p, q)))
    share = lambda u, v: F.when(F.abs(u - v) > 0, both / F.abs(u - v)).otherwise(0.0)
    return F.greatest(share(a, b), share(p, q))


def same_direction(l1: str, l2: str, least: float = 0.7) -> Column:
    c = F.col
    n = c(f"{l1}.length") * c(f"{l2}.length")
    return F.when(n > 0, (c(f"{l1}.dx") * c(f"{l2}.dx") + c(f"{l1}.dy") * c(f"{l2}.dy")) / n > least).otherwise(True)


def pair_score(distance: Column, over: Column, ratio: Column, diff: Column, lo: float, hi: float, parallel: float) -> Column:
    ideal = (lo + hi) / 2
    return 0.3 * (1 - F.abs(distance - ideal) / ideal) + 0.3 * over + 0.2 * ratio + 0.2 * (1 - diff / parallel)


def parallel_pairs(lines: DataFrame, lo: float = 8.0, hi: float = 25.0, parallel: float = 12.0, least: float = 0.6) -> DataFrame:
    """Pairs i < j of one image that are parallel, in distance range, overlapping and of one direction.

    Angles fall in bins of the threshold, so the join is an equality on image and bin: line i goes
    to its bin and both neighbours (0 and 180 meet), line j to its own.
    """
    bins = int(180 // parallel)
    own = F.least(F.floor(F.col("angle") / parallel), F.lit(bins - 1)).cast("int")
    rich = with_attributes(lines)
    a = rich.withColumn("bin", F.explode(F.array_distinct(F.array(*(F.pmod(own + k, F.lit(bins)) for k in (-1, 0, 1)))))).alias("a")
    b = rich.withColumn("bin", own).alias("b")
    got = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.line_idx") < F.col("b.line_idx")))
    diff, dist, over = fold_diff(F.col("a.angle"), F.col("b.angle")), perpendicular("a", "b"), overlap("a", "b")
    got = got.where(diff <= parallel).where((dist >= lo) & (dist <= hi)).where(over >= least).where(same_direction("a", "b"))
    ratio = F.least("a.length", "b.length") / F.greatest("a.length", "b.length")
    return got.select(
        F.col("a.image").alias("image"), F.col("a.line_idx").alias("i"), F.col("b.line_idx").alias("j"), diff.alias("angle_diff"), dist.alias("distance"), over.alias("overlap"),
        ratio.alias("length_ratio"), F.least("a.length", "b.length").alias("shorter"), pair_score(dist, over, ratio, diff, lo, hi, parallel).alias("score"),
    )
