"""Spatial joins as grid equi-joins.

Each box is listed in the grid cells it touches and boxes meet by cell; a pair counts only in the cell of
the lower corner of the boxes' intersection, so no pair appears twice and no distinct is needed.
Exact distances are checked afterwards. Hot cells are split by adaptive execution, as the join is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.functions import geo

BOX = ("minx", "miny", "maxx", "maxy")


def line_box(line: Column) -> dict[str, Column]:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def _cells(df: DataFrame, cell: float, reach: float, side: str) -> DataFrame:
    """One row for each cell that the box, grown by reach, touches; columns get a prefix."""
    lo = {k: F.floor((F.col(k) - reach) / cell) for k in ("minx", "miny")}
    hi = {k: F.floor((F.col(k) + reach) / cell) for k in ("maxx", "maxy")}
    out = df.withColumn("__cx", F.explode(F.sequence(lo["minx"], hi["maxx"]))).withColumn("__cy", F.explode(F.sequence(lo["miny"], hi["maxy"])))
    return out.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns), F.col("__cx"), F.col("__cy"))


def box_join(left: DataFrame, right: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    """Pairs whose boxes come within reach (by axis); columns l_* and r_*."""
    a, b = _cells(left, cell, reach, "l"), _cells(right, cell, 0.0, "r")
    x0 = F.greatest(F.col("l_minx") - reach, F.col("r_minx"))
    y0 = F.greatest(F.col("l_miny") - reach, F.col("r_miny"))
    touch = (x0 <= F.least(F.col("l_maxx") + reach, F.col("r_maxx"))) & (y0 <= F.least(F.col("l_maxy") + reach, F.col("r_maxy")))
    here = (F.floor(x0 / cell) == F.col("__cx")) & (F.floor(y0 / cell) == F.col("__cy"))
    return a.join(b, ["__cx", "__cy"]).where(touch & here).drop("__cx", "__cy")


def points_to_lines(points: DataFrame, lines: DataFrame, reach: float, cell: float | None = None) -> DataFrame:
    """(l_*, r_*, near): points (x, y) with lines (line) within reach; near is nearest_on of the line."""
    p = points.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
    q = lines.withColumns(line_box(F.col("line")))
    got = box_join(p, q, cell or max(2 * reach, 1e-9), reach).withColumn("near", geo.nearest_on(F.col("r_line"), F.col("l_x"), F.col("l_y")))
    return got.where(F.col("near.d") <= reach)


def points_near_points(points: DataFrame, reach: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(i, j, metres): pairs i < j of points (id, lon, lat) at most reach metres apart on the ellipsoid."""
    deg_y = reach / 110_000.0
    p = points.select("id", F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    # A degree of longitude shrinks with latitude: the grid uses the widest reach of each row's own latitude band.
    band = F.floor(F.col("lat") / 1.0)
    deg_x = reach / 111_000.0 / F.greatest(F.cos(F.radians(F.abs(F.col("lat")) + 1.5)), F.lit(0.01))
    steps = F.pow(F.lit(2.0), F.ceil(F.log2(deg_x)))
    own = p.withColumns({"w": steps, "cy": F.floor(F.col("lat") / deg_y)})
    a = own.withColumn("gx", F.floor(F.col("lon") / F.col("w"))).select("id", "lon", "lat", "w", "gx", "cy")
    sizes = F.array_distinct(F.array("w", F.col("w") / 2, F.col("w") * 2))
    b = own.withColumn("w", F.explode(sizes)).withColumn("gx", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.floor(F.col("lon") / F.col("w")) + k)))
    b = b.withColumn("cy", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.col("cy") + k))).select(F.col("id").alias("jd"), F.col("lon").alias("jlon"), F.col("lat").alias("jlat"), "w", "gx", "cy")
    d = geo.geodesic(F.col("lon"), F.col("lat"), F.col("jlon"), F.col("jlat"))
    del band
    got = a.join(b, ["w", "gx", "cy"]).where(F.col("id") != F.col("jd")).withColumn("metres", d).where(F.col("metres") <= reach)
    i, j = F.least("id", "jd"), F.greatest("id", "jd")
    return got.select(i.alias("i"), j.alias("j"), "metres").groupBy("i", "j").agg(F.min("metres").alias("metres"))


def thin(points: DataFrame, reach: float) -> DataFrame:
    """Points without the j of any pair i < j within reach, whether or not i itself stays; points without an id or a place stay.

    Pairs are not listed. Of rows of one place only those of the smallest id can stay. Any two places of a grid cell lie
    within reach, so the same holds for a cell, and only its smallest id is tested against the cells around: a place
    meets one id for each cell in reach (about 20), however many share its cell.
    """
    # A degree is 110,500 to 111,700 m along a meridian, and on the equator at least 111,300 m.
    side, lon, lat = reach * 0.7 / 111_700.0, F.col("lon"), F.col("lat")
    cos = lambda deg: F.cos(F.radians(deg))
    width = lambda row: F.lit(side) / F.greatest(F.abs(cos(row * side)), F.abs(cos((row + 1) * side)), F.lit(1e-12))
    finite = " and ".join(f"abs({k}) < 1e6" for k in ("lon", "lat"))
    rows = points.select("id", lon.cast("double").alias("lon"), lat.cast("double").alias("lat")).where(f"id is not null and {finite}").distinct()
    place = rows.groupBy("lon", "lat").agg(F.min("id").alias("id")).withColumn("cy", F.floor(lat / side))
    place = place.withColumn("cx", F.floor(lon / width(F.col("cy"))))
    low = place.groupBy("cx", "cy").agg(F.min("id").alias("id")).join(place, ["cx", "cy", "id"]).select("id", "lon", "lat")
    half = reach / 221_000.0  # the mean of both latitudes is that near
    near, far = cos(lat - half), cos(lat + half)
    east = F.when(near * far > 0, F.least(F.lit(reach / 111_300.0) / F.least(F.abs(near), F.abs(far)), F.lit(720.0))).otherwise(720.0)
    around = low.withColumns({"east": east, "cy": F.explode(F.sequence(F.floor(lat / side) - 2, F.floor(lat / side) + 2))})
    cx = F.sequence(F.floor((lon - F.col("east")) / width(F.col("cy"))), F.floor((lon + F.col("east")) / width(F.col("cy"))))
    around = around.select("id", "lon", "lat", "cy", F.explode(cx).alias("cx"))
    other = place.select("cx", "cy", F.col("id").alias("i"), lon.alias("ilon"), lat.alias("ilat"))
    within = geo.geodesic(F.col("ilon"), F.col("ilat"), lon, lat) <= reach
    gone = around.join(other, ["cx", "cy"]).where((F.col("i") < F.col("id")) & within).select("id", "lon", "lat")
    drop = rows.join(low.join(gone, ["id", "lon", "lat"], "left_anti"), ["id", "lon", "lat"], "left_anti").select("id").distinct()
    return points.join(drop, "id", "left_anti")


def best_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group under a total order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule on a closed ring."""
    hits = F.filter(geo.pairs(ring), lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]))
    return F.size(hits) % 2 == 1


def ring_is_valid(ring: Column) -> Column:
    """At least 4 vertices, closed, and no two sides that properly cross."""
    side = lambda s, p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
    segs = geo.pairs(ring)
    cross = F.exists(segs, lambda s: F.exists(segs, lambda t: (side(s, t["a"]) * side(s, t["b"]) < 0) & (side(t, s["a"]) * side(t, s["b"]) < 0)))
    return (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & ~cross


def covered_share(lines: DataFrame, roads: DataFrame, half_width: float) -> DataFrame:
    """(id, length, covered): how much of each line lies within flat-capped strips around road segments.

    A piece of a line meets a strip in one parameter interval; overlapping intervals are merged by a running maximum.
    """
    a = lines.select("id", F.posexplode(geo.pairs(F.col("line"))).alias("k", "s")).select(
        "id", "k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    b = roads.select(F.explode(geo.pairs(F.col("line"))).alias("s")).select(
        F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    boxes = lambda df: df.withColumns({"minx": F.least("x1", "x2"), "maxx": F.greatest("x1", "x2"), "miny": F.least("y1", "y2"), "maxy": F.greatest("y1", "y2")})
    got = box_join(boxes(a), boxes(b), max(4 * half_width, 4e-4), half_width)
    ux, uy = F.col("r_x2") - F.col("r_x1"), F.col("r_y2") - F.col("r_y1")
    n = F.sqrt(ux * ux + uy * uy)
    got = got.withColumn("n", n).where("n > 0")

    def local(x, y):
        dx, dy = F.col(x) - F.col("r_x1"), F.col(y) - F.col("r_y1")
        return (dx * ux + dy * uy) / F.col("n"), (dy * ux - dx * uy) / F.col("n")

    (s1, t1), (s2, t2) = local("l_x1", "l_y1"), local("l_x2", "l_y2")
    got = got.withColumns({"s1": s1, "t1": t1, "s2": s2, "t2": t2})

    def clip(p, q, lo, hi):
        d = F.col(q) - F.col(p)
        u, v = (lo - F.col(p)) / d, (hi - F.col(p)) / d
        inside = (F.col(p) >= lo) & (F.col(p) <= hi)
        flat = F.abs(d) < 1e-15
        return F.when(flat, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(u, v)), F.when(flat, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(u, v))

    (a0, a1), (b0, b1) = clip("s1", "s2", F.lit(0.0), F.col("n")), clip("t1", "t2", F.lit(-half_width), F.lit(half_width))
    spans = got.select(F.col("l_id").alias("id"), F.col("l_k").alias("k"), F.greatest(a0, b0, F.lit(0.0)).alias("lo"), F.least(a1, b1, F.lit(1.0)).alias("hi")).where("hi > lo")
    order = W.partitionBy("id", "k").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    merged = spans.withColumn("seen", F.coalesce(F.max("hi").over(order), F.lit(0.0))).select("id", "k", F.greatest(F.lit(0.0), F.col("hi") - F.greatest("lo", "seen")).alias("share"))
    share = merged.groupBy("id", "k").agg(F.sum("share").alias("share"))
    length = geo.geodesic(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return a.withColumn("m", length).join(share, ["id", "k"], "left").groupBy("id").agg(
        F.sum("m").alias("length"), F.sum(F.col("m") * F.coalesce("share", F.lit(0.0))).alias("covered")
    )
