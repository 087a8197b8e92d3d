import math

import pytest
from pyspark.sql import functions as F

from wayforge.functions import angles, geo, tags

c = F.col


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def line(*pts):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))


def xy(points):
    return [(p["x"], p["y"]) for p in points]


def test_angles(spark):
    f = lambda *a: [F.lit(float(x)) for x in a]
    got = one(
        spark, north=angles.rotation_angle(*f(0, 0, 0, 1)), east=angles.rotation_angle(*f(0, 0, 1, 0)), west=angles.rotation_angle(*f(0, 0, -1, 0)),
        wrap=angles.angle_diff(*f(350, 10)), fold=angles.line_angle_diff(F.lit(10.0), F.lit(200.0), F.lit("no")), full=angles.line_angle_diff(F.lit(10.0), F.lit(200.0), F.lit("yes")),
        right=angles.vertex_angle(*f(1, 0, 0, 0, 0, 1)), none=angles.vertex_angle(*f(0, 0, 0, 0, 0, 1)), tie=angles.forward_or_backward(*f(90, 0, 180)),
    )
    assert (got["north"], got["east"], got["west"]) == (0.0, 90.0, 270.0)
    assert got["wrap"] == 20 and got["fold"] == pytest.approx(10) and got["full"] == 170
    assert got["right"] == pytest.approx(90) and got["none"] == 0 and got["tie"] == "backward"


def test_direction_labels(spark):
    rows = [(a, b, k) for a in (False, True) for b in (False, True) for k in (0.9, -0.9, 0.0, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, k double").select("*", angles.direction_label(c("a"), c("b"), c("k")).alias("s"))
    got = {(r["a"], r["b"], r["k"]): r["s"] for r in df.collect()}
    assert got[(False, False, 0.9)] == "bidirectional_both" and got[(True, False, -0.9)] == "oneway_to_bidirectional_opposite"
    assert got[(False, True, None)] == "bidirectional_to_oneway" and got[(True, True, 0.0)] == "mixed_direction" and got[(True, True, None)] == "unknown_direction"
    assert len(set(got.values())) == 13


def test_mercator_round_trip_and_tiles(spark):
    got = one(spark, lon=geo.lon_of(geo.merc_x(F.lit(-1.23))), lat=geo.lat_of(geo.merc_y(F.lit(37.9))), box=geo.tile_bbox(F.lit(1), F.lit(0), F.lit(0)))
    assert got["lon"] == pytest.approx(-1.23) and got["lat"] == pytest.approx(37.9)
    half = math.pi * 6378137
    assert got["box"]["minx"] == pytest.approx(-half) and got["box"]["maxy"] == pytest.approx(half) and got["box"]["miny"] == pytest.approx(0, abs=1e-6)


def test_lines(spark):
    bent = line((0, 0), (10, 0), (10, 10))
    got = one(
        spark, length=geo.planar_length(bent), on=geo.project_on(bent, F.lit(11.0), F.lit(4.0)), near=geo.nearest_on(bent, F.lit(5.0), F.lit(3.0)),
        at=geo.interpolate(bent, F.lit(15.0)), half=geo.interpolate(bent, F.lit(0.5), True), over=geo.interpolate(bent, F.lit(99.0)),
        apart=geo.line_distance(bent, line((0, 3), (8, 3))), cross=geo.line_distance(bent, line((5, -1), (5, 1))), hd=geo.hausdorff(line((0, 0), (10, 0)), line((0, 2), (10, 5))),
        cut=geo.split_line(bent, F.lit(0), F.lit(0.5)), back=geo.reverse_line(geo.reverse_line(bent)), same=bent, left=geo.offset_line(line((0, 0), (10, 0)), 2.0),
        mitre=geo.offset_line(bent, 1.0), samples=F.size(geo.sample_points(line((0, 0), (100, 0)))), few=F.size(geo.sample_points(line((0, 0), (40, 0)))),
    )
    assert got["length"] == 20 and got["on"] == 14 and got["near"]["d"] == 3 and got["near"]["t"] == 0.5
    assert xy([got["at"], got["half"], got["over"]]) == [(10, 5), (10, 0), (10, 10)]
    assert got["apart"] == 2 and got["cross"] == 0 and got["hd"] == 5
    assert xy(got["cut"]["a"]) == [(0, 0), (5, 0)] and xy(got["cut"]["b"]) == [(5, 0), (10, 0), (10, 10)]
    assert got["back"] == got["same"] and xy(got["left"]) == [(0, 2), (10, 2)] and xy(got["mitre"])[1] == pytest.approx((9, 1))
    assert got["samples"] == 2 + 3 and got["few"] == 2


def test_areas_and_roundness(spark):
    ring = [(math.cos(k * math.pi / 4) * 1e-4, math.sin(k * math.pi / 4) * 1e-4) for k in range(8)]
    side = 1e-3
    got = one(spark, area=geo.shoelace_m2(line((0, 0), (side, 0), (side, side), (0, side), (0, 0))), round=geo.roundness(line(*ring)), few=geo.roundness(line(*ring[:7])), long=geo.roundness(line(*[(x * 3, y) for x, y in ring])))
    assert got["area"] == pytest.approx((111111 * side) ** 2, rel=1e-6)
    assert got["round"] and not got["few"] and not got["long"]


def test_wkt_and_hashes(spark):
    got = one(
        spark, text=geo.wkt(line((1.5, 2), (3, 4))), pts=geo.parse_wkt(F.lit("LINESTRING (1.5 2.0, 3 4)")), poly=geo.parse_wkt(F.lit("POLYGON ((0 0, 1 0, 1 1, 0 0))")), bad=geo.parse_wkt(F.lit("CIRCLE (1 2)")),
        athena=geo.parse_struct_text(F.lit("{type=LineString, coordinates=[[1.0, 2.0], [3.0, 4.0]]}")), h=geo.wkt_hash_id(F.lit("x")), gh=geo.geohash(F.lit(-5.6), F.lit(42.6)),
        even=geo.snap_key(F.lit(0.25), 0.1), odd=geo.snap_key(F.lit(0.35), 0.1),
    )
    assert got["text"] == "LINESTRING (1.5 2.0, 3.0 4.0)" and xy(got["pts"]) == xy(got["athena"])[:0] + [(1.5, 2), (3, 4)]
    assert len(got["poly"]) == 4 and got["bad"] is None and xy(got["athena"]) == [(1, 2), (3, 4)]
    assert got["h"] == 762385986 and got["gh"].startswith("ezs42")


def test_tag_text(spark):
    got = one(spark, a=tags.parse_map_text(F.lit("{highway=primary, note=a=b, x=, surface=[DELETED]}")), b=tags.parse_map_text(F.lit("{oneway=yes}")), e=tags.parse_map_text(F.lit("{}")))
    assert got["a"] == {"highway": "primary", "surface": "0", "oneway": "no"} and got["b"] == {"oneway": "yes"} and got["e"] == {"oneway": "no"}


@pytest.mark.parametrize(("value", "state"), [("yes", "forward"), (" YES ", "forward"), ("-1", "reverse"), ("no", "bidirectional"), ("maybe", "bidirectional"), (None, "bidirectional")])
def test_oneway(spark, value, state):
    assert one(spark, s=tags.oneway_state(F.lit(value).cast("string")))["s"] == state


def test_limits_names_and_keys(spark):
    s = lambda v: F.lit(v).cast("string")
    m = F.create_map(F.lit("turn:lanes"), F.lit("a"), F.lit("source:lanes"), F.lit("b"), F.lit("highway"), F.lit("c"))
    got = one(
        spark, a=tags.effective_limit(s("signals"), s("50"), s("70"), F.lit(True)), b=tags.effective_limit(s(None), s("50"), s("50"), F.lit(True)), own=tags.own_limit_ok(s("signals"), s("50"), s(None)),
        side=tags.own_limit_ok(s(None), s("50"), s(None)), ids=tags.combined_id(F.array(F.lit("a"), F.lit("b")), F.lit(True)), first=tags.combined_id(F.array(F.lit("a"), F.lit("b")), F.lit(False)),
        keys=F.array_sort(F.map_keys(tags.output_keys(m, ("highway",), ()))), pre=F.map_keys(tags.prefix_keys(F.create_map(F.lit("a"), F.lit("b")))), tile=tags.tile_name(F.lit("/d/pnoa_17_5_6.png")), no=tags.tile_name(F.lit("/d/x.png")),
        kids=F.size(tags.quadkey_children(F.lit("12"), 4)), self_=tags.quadkey_children(F.lit("123"), 3),
    )
    assert got["a"] == 50 and got["b"] is None and not got["own"] and got["side"]
    assert got["ids"] == "a_b" and got["first"] == "a" and got["keys"] == ["highway", "turn:lanes"] and got["pre"] == ["string:a"]
    assert tuple(got["tile"]) == (17, 5, 6) and tuple(got["no"]) == (None, None, None) and got["kids"] == 16 and got["self_"] == ["123"]


def test_geodesic_against_known_lengths(spark):
    got = one(spark, lat=geo.geodesic(*(F.lit(x) for x in (0.0, 0.0, 0.0, 0.01))), lon=geo.geodesic(*(F.lit(x) for x in (0.0, 0.0, 0.01, 0.0))), swap=geo.geodesic(*(F.lit(x) for x in (0.0, 0.0, 0.01, 0.0)), axis_swapped=True))
    assert got["lat"] == pytest.approx(1105.74, abs=0.01) and got["lon"] == pytest.approx(1113.19, abs=0.01) and got["swap"] == pytest.approx(got["lat"])
