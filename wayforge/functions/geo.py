"""Geometry expressions over ARRAY<STRUCT<x, y>> lines and plain coordinates; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0  # fixed: radius of spherical Mercator, also the WGS-84 semi-major axis
E2 = 0.00669437999014  # fixed: WGS-84 first eccentricity squared
PT = "array<struct<x:double,y:double>>"


def merc_x(lon: Column) -> Column:
    return F.radians(lon) * R


def merc_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(3.141592653589793) / 4 + F.radians(lat) / 2)) * R


def lon_of(x: Column) -> Column:
    return F.degrees(x / R)


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / R)))


def project_line(line: Column) -> Column:
    """4326 to 3857."""
    return F.transform(line, lambda p: F.struct(merc_x(p["x"]).alias("x"), merc_y(p["y"]).alias("y")))


def unproject_line(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(lon_of(p["x"]).alias("x"), lat_of(p["y"]).alias("y")))


def tile_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    """Slippy tile to its 3857 box."""
    return F.struct(
        merc_x(tile_lon(x, z)).alias("minx"), merc_y(tile_lat(y + 1, z)).alias("miny"), merc_x(tile_lon(x + 1, z)).alias("maxx"), merc_y(tile_lat(y, z)).alias("maxy")
    )


def pixel_to_lonlat(px: Column, py: Column, box: Column, size: int = 256) -> Column:
    """Pixel of a tile (y down) to lon/lat."""
    x = box["minx"] + px / size * (box["maxx"] - box["minx"])
    y = box["maxy"] - py / size * (box["maxy"] - box["miny"])
    return F.struct(lon_of(x).alias("lon"), lat_of(y).alias("lat"))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, axis_swapped: bool = False) -> Column:
    """Metres on the WGS-84 ellipsoid for short ranges. axis_swapped takes lon for lat, for parity with callers that do."""
    if axis_swapped:
        lon1, lat1, lon2, lat2 = lat1, lon1, lat2, lon2
    mid = F.radians((lat1 + lat2) / 2)
    w = F.sqrt(1 - E2 * F.pow(F.sin(mid), F.lit(2.0)))
    north = F.radians(lat2 - lat1) * (R * (1 - E2)) / F.pow(w, F.lit(3.0))
    east = F.radians(lon2 - lon1) * R / w * F.cos(mid)
    return F.sqrt(north * north + east * east)


def pairs(line: Column) -> Column:
    """Consecutive vertices of a line as structs a, b."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast(f"array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def planar_length(line: Column) -> Column:
    return _total(F.transform(pairs(line), lambda s: F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], F.lit(2.0)) + F.pow(s["a"]["y"] - s["b"]["y"], F.lit(2.0)))))


def geodesic_length(line: Column) -> Column:
    return _total(F.transform(pairs(line), lambda s: geodesic(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point and a segment."""
    t = segment_param(px, py, ax, ay, bx, by)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), F.lit(2.0)) + F.pow(py - (ay + t * (by - ay)), F.lit(2.0)))


def segment_param(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment the nearest point lies, 0 to 1."""
    d2 = F.pow(bx - ax, F.lit(2.0)) + F.pow(by - ay, F.lit(2.0))
    return F.when(d2 > 0, F.least(F.greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def nearest_on(line: Column, px: Column, py: Column) -> Column:
    """STRUCT<d, seg, t>: distance, segment (from 0) and place on it of the nearest point; first on ties."""
    segs = pairs(line)
    each = F.transform(segs, lambda s, i: F.struct(
        segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]).alias("d"), i.alias("seg"),
        segment_param(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]).alias("t"),
    ))
    return F.array_min(each)


def bound(value: Column, body) -> Column:
    """body of a value that is worked out once: as a lambda's argument, and not wherever body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distance_to(segs: Column, px: Column, py: Column) -> Column:
    """Least distance of a point to segments (pairs of a line)."""
    return F.array_min(F.transform(segs, lambda s: segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def point_line_distance(line: Column, px: Column, py: Column) -> Column:
    return distance_to(pairs(line), px, py)


def project_on(line: Column, px: Column, py: Column) -> Column:
    """Length along the line to the point nearest to p."""
    n = nearest_on(line, px, py)
    seg = F.element_at(pairs(line), n["seg"] + 1)
    length = lambda s: F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], F.lit(2.0)) + F.pow(s["a"]["y"] - s["b"]["y"], F.lit(2.0)))
    return planar_length(F.slice(line, F.lit(1), n["seg"] + 1)) + n["t"] * length(seg)


def interpolate(line: Column, at: Column, normalized: bool = False) -> Column:
    """Point at a length (or share of it) along the line, clamped to its ends."""
    total = planar_length(line)
    want = F.least(F.greatest(at * total if normalized else at, F.lit(0.0)), total)
    start = F.struct(want.alias("left"), F.lit(False).alias("found"), F.element_at(line, 1).alias("p"))

    def step(acc, s):
        d = F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], F.lit(2.0)) + F.pow(s["a"]["y"] - s["b"]["y"], F.lit(2.0)))
        t = F.when(d > 0, F.least(acc["left"] / d, F.lit(1.0))).otherwise(0.0)
        here = F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))
        return F.when(acc["found"], acc).otherwise(F.struct((acc["left"] - d).alias("left"), (acc["left"] <= d).alias("found"), here.alias("p")))

    return F.aggregate(pairs(line), start, step)["p"]


def line_distance(a: Column, b: Column) -> Column:
    """Least distance of two lines: 0 where segments cross, else the least end-to-segment distance."""
    side = lambda s, p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])

    def of(s):
        u, v = s["u"], s["v"]
        cross = F.exists(u, lambda s: F.exists(v, lambda t: (side(s, t["a"]) * side(s, t["b"]) < 0) & (side(t, s["a"]) * side(t, s["b"]) < 0)))
        ends = F.least(F.array_min(F.transform(a, lambda p: distance_to(v, p["x"], p["y"]))), F.array_min(F.transform(b, lambda p: distance_to(u, p["x"], p["y"]))))
        return F.when(cross, 0.0).otherwise(ends)

    return bound(F.struct(pairs(a).alias("u"), pairs(b).alias("v")), of)


def hausdorff(a: Column, b: Column) -> Column:
    """Vertices of each line against the other line, the larger of both directions."""
    one = lambda u, v: bound(pairs(v), lambda segs: F.array_max(F.transform(u, lambda p: distance_to(segs, p["x"], p["y"]))))
    return F.greatest(one(a, b), one(b, a))


def share_within(points: Column, line: Column, reach: float) -> Column:
    """Share of points within reach of a line."""
    return bound(F.struct(points.alias("p"), pairs(line).alias("s")), lambda x: F.size(F.filter(x["p"], lambda p: distance_to(x["s"], p["x"], p["y"]) <= reach)) / F.size(x["p"]))


def sample_points(line: Column) -> Column:
    """All vertices; of lines over 50 m also points at shares k/n, n = max(3, length / 25)."""
    length = planar_length(line)
    n = F.greatest(F.lit(3), F.floor(length / 25).cast("int"))
    extra = F.transform(F.sequence(F.lit(1), n - 1), lambda k: interpolate(line, k / n, normalized=True))
    return F.concat(line, F.when(length > 50, extra).otherwise(F.array().cast(PT)))


def offset_line(line: Column, metres: float) -> Column:
    """Parallel line: each vertex moves along the mitre of its sides; positive is left."""
    n = F.size(line)

    def move(p, i):
        q, r = F.element_at(line, F.greatest(i, F.lit(1))), F.element_at(line, F.least(i + 2, n))
        normal = lambda u, v: F.struct((-(v["y"] - u["y"])).alias("x"), (v["x"] - u["x"]).alias("y"), F.sqrt(F.pow(v["x"] - u["x"], F.lit(2.0)) + F.pow(v["y"] - u["y"], F.lit(2.0))).alias("l"))
        a, b = normal(q, p), normal(p, r)
        ax, ay = F.when(a["l"] > 0, a["x"] / a["l"]).otherwise(b["x"] / b["l"]), F.when(a["l"] > 0, a["y"] / a["l"]).otherwise(b["y"] / b["l"])
        bx, by = F.when(b["l"] > 0, b["x"] / b["l"]).otherwise(ax), F.when(b["l"] > 0, b["y"] / b["l"]).otherwise(ay)
        sx, sy = ax + bx, ay + by
        k = F.lit(2.0) * metres / F.greatest(sx * sx + sy * sy, F.lit(0.25))
        return F.struct((p["x"] + sx * k).alias("x"), (p["y"] + sy * k).alias("y"))

    return F.transform(line, move)


def shoelace_m2(ring: Column) -> Column:
    """Area of a closed degree ring in square metres, on a local scale at its mean latitude."""
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(ring)
    twice = _total(F.transform(pairs(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))
    return F.abs(twice) / 2 * (111111.0 * 111111.0) * F.cos(F.radians(mean))


def roundness(points: Column) -> Column:
    """TRUE if at least 8 vertices lie between d and 1.8 d from their mean."""
    cx = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(points)
    cy = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(points)
    d = F.transform(points, lambda p: geodesic(cx, cy, p["x"], p["y"]))
    return (F.size(points) >= 8) & (F.array_max(d) <= 1.8 * F.array_min(d))


def wkt(line: Column, kind: str = "LINESTRING") -> Column:
    """WKT of a line or, with kind POINT, of its first vertex."""
    xy = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} ("), xy, F.lit(")")) if kind != "POLYGON" else F.concat(F.lit("POLYGON (("), xy, F.lit("))"))


def parse_wkt(text: Column) -> Column:
    """Vertices of a POINT, LINESTRING or one-ring POLYGON; null if the text is none of them."""
    body = F.regexp_extract(text, r"^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)+\s*$", 1)
    xy = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda s: F.split(F.trim(s), r"\s+"))
    return F.when(body != "", F.transform(xy, lambda p: F.struct(F.element_at(p, 1).cast("double").alias("x"), F.element_at(p, 2).cast("double").alias("y"))))


def parse_struct_text(text: Column) -> Column:
    """Vertices of `{type=LineString, coordinates=[[x, y], ...]}`."""
    list_ = F.from_json(F.regexp_extract(text, r"coordinates=(\[\[.*\]\])", 1), "array<array<double>>")
    return F.transform(list_, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))


def wkt_hash_id(text: Column) -> Column:
    """First 8 hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def geohash(lon: Column, lat: Column, precision: int = 12) -> Column:
    """Geohash: lon and lat as 30-bit fractions, bits interleaved, five to a letter."""
    bits = precision * 5 // 2
    fx = F.least(F.floor((lon + 180.0) / 360.0 * (1 << bits)), F.lit((1 << bits) - 1))
    fy = F.least(F.floor((lat + 90.0) / 180.0 * (1 << bits)), F.lit((1 << bits) - 1))
    letter = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed alphabet

    def at(i: int) -> Column:
        five = F.lit(0).cast("long")
        for k in range(5):
            n = 5 * i + k
            v = fx if n % 2 == 0 else fy
            five = five * 2 + F.shiftright(v, bits - 1 - n // 2).bitwiseAND(F.lit(1).cast("long"))
        return F.substring(F.lit(letter), (five + 1).cast("int"), F.lit(1))

    return F.concat(*(at(i) for i in range(precision)))


def snap_key(v: Column, tolerance: float) -> Column:
    """Integer grid key, ties to even."""
    return F.rint(v / tolerance).cast("long")


def reverse_line(line: Column) -> Column:
    return F.reverse(line)


def split_line(line: Column, seg: Column, t: Column) -> Column:
    """STRUCT<a, b>: the two parts of a line cut at place t of segment seg; they share the new vertex."""
    s = F.element_at(pairs(line), seg + 1)
    p = F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))
    return F.struct(F.concat(F.slice(line, F.lit(1), seg + 1), F.array(p)).alias("a"), F.concat(F.array(p), F.slice(line, seg + 2, F.size(line))).alias("b"))
