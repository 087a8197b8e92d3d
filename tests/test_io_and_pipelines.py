import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayforge.plans import pipelines
from wayforge.sources import geojson

c = F.col


def way(i, tags, pts, nodes=None):
    ids, node_tags = nodes or ([f"{i}.{k}" for k in range(len(pts))], {})
    return {"id": str(i), "properties": tags, "geometry": {"coordinates": pts}, "nodes": [{"id": n, "properties": node_tags.get(n, {}), "geometry": {"coordinates": p}} for n, p in zip(ids, pts, strict=True)]}


def ways_df(spark, tmp_path, ways):
    import csv

    with open(tmp_path / "ways.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["feature"])
        for x in ways:
            w.writerow([json.dumps(x)])
        w.writerow(["{broken"])
    return geojson.read_ways_csv(spark, str(tmp_path / "ways.csv"))


def test_sign_directions(spark, tmp_path):
    nodes = (["a", "b", "c"], {"b": {"highway": "stop", "direction": "10"}, "a": {"highway": "stop", "direction": "x"}, "c": {"highway": "give_way", "direction": "0"}})
    w = ways_df(spark, tmp_path, [way(1, {"highway": "primary"}, [[0, 0], [0, 1], [0, 2]], nodes), way(2, {"highway": "footway"}, [[0, 0], [0, 1], [0, 2]], nodes), way(3, {"highway": "primary"}, [[0, 0]], (["b"], nodes[1]))])
    assert {r["node_id"]: r["alt_dir"] for r in pipelines.sign_directions(w).collect()} == {"b": "backward", "c": "backward"}


def test_triangles_and_entrances(spark, tmp_path):
    d = 6e-4
    tri = [way(1, {"highway": "residential"}, [[0, 0], [d, 0]], (["a", "b"], {})), way(2, {"highway": "primary"}, [[d, 0], [0, d]], (["b", "c"], {})), way(3, {"highway": "residential"}, [[0, d], [0, 0]], (["c", "a"], {}))]
    got = pipelines.triangles(ways_df(spark, tmp_path, tri), 300.0).collect()
    assert sorted(r["way_id"] for r in got) == ["1", "2", "3"] and all(r["has_non_residential"] for r in got)
    # a side in two ways is a triangle still; three curved ways of a round loop are none, nor is a square
    cut = [tri[0], way(2, {"highway": "residential"}, [[d, 0], [d / 2, d / 2]], (["b", "m"], {})), way(4, {"highway": "residential"}, [[0, d], [d / 2, d / 2]], (["c", "m"], {})), tri[2]]
    round_ = [way(k, {"highway": "residential"}, [[d / 2 * float(np.cos(x)) + 1, d / 2 * float(np.sin(x))] for x in np.linspace(2 * k, 2 * k + 2, 7) * np.pi / 3], ([f"r{k % 3}", *(f"r{k}.{i}" for i in range(5)), f"r{(k + 1) % 3}"], {})) for k in range(6, 9)]
    corner = [(2, 0), (2 + d, 0), (2 + d, d), (2, d)]
    square = [way(20 + k, {"highway": "residential"}, [list(corner[k]), list(corner[(k + 1) % 4])], ([f"s{k}", f"s{(k + 1) % 4}"], {})) for k in range(4)]
    got = pipelines.triangles(ways_df(spark, tmp_path, cut + round_ + square), 300.0).collect()
    assert sorted(r["way_id"] for r in got) == ["1", "2", "3", "4"] and not any(r["has_non_residential"] for r in got)
    limit = {"m": {"traffic_sign": "city_limit"}, "n": {"traffic_sign": "city_limit"}}
    roads = [
        way(1, {"highway": "primary", "maxspeed": "90"}, [[0, 0], [1e-4, 0], [2e-4, 0]], (["a", "m", "b"], limit)), way(2, {"highway": "primary", "maxspeed": "50"}, [[2e-4, 0], [4e-4, 0]], (["b", "c"], {})),
        way(3, {"highway": "primary", "maxspeed": "90"}, [[1, 0], [1.0001, 0], [1.0002, 0]], (["d", "n", "e"], limit)),
    ]
    assert [r["id"] for r in pipelines.city_entrances(ways_df(spark, tmp_path, roads)).collect()] == ["n"]


def test_roundabout(spark, tmp_path):
    pts = [[np.cos(k * np.pi / 6) * 1.5e-4, np.sin(k * np.pi / 6) * 1.5e-4] for k in range(12)]
    pts = [[float(x), float(y)] for x, y in pts]
    ring = [way(1, {"highway": "residential"}, pts[:7], ([f"n{k}" for k in range(7)], {})), way(2, {"highway": "residential"}, [*pts[6:], pts[0]], ([f"n{k % 12}" for k in range(6, 13)], {}))]
    arms = [way(3, {"highway": "residential"}, [pts[0], [0.01, 0.0]], (["n0", "x"], {})), way(4, {"highway": "residential"}, [pts[6], [-0.01, 0.0]], (["n6", "y"], {}))]
    got = pipelines.untagged_roundabouts(ways_df(spark, tmp_path, ring + arms)).collect()
    assert {r["way_id"] for r in got} == {"1", "2"}


def test_conflation(spark):
    line = "id string, oneway string, junction string, line array<struct<x:double,y:double>>"
    a = spark.createDataFrame([("1", "yes", None, [(0.0, 0.0), (0.001, 0.0)]), ("2", None, None, [(0.0, 0.01), (0.001, 0.01)]), ("3", "yes", None, [(0.0, 0.5), (0.001, 0.5)])], line)
    b = spark.createDataFrame([("p", "-1", None, [(0.0, 3e-5), (0.001, 3e-5)]), ("q", None, None, [(0.0, 0.01003), (0.001, 0.01003)])], line)
    m = pipelines.conflate(a, b)
    assert {(r["i"], r["j"], r["status"]) for r in m.collect()} == {("1", "p", "opposite_direction"), ("2", "q", "bidirectional_both")}
    assert [r["colour"] for r in pipelines.difference_lines(m, a).collect()] == ["pink"]


def test_detected_roads_and_turn_lanes(spark):
    det = spark.createDataFrame([("new", [(0.0, 5e-5), (0.0, 2e-3)]), ("known", [(0.0, 1e-5), (0.002, 1e-5)]), ("far", [(1.0, 1.0), (1.0, 1.001)]), ("field", [(0.001, 5e-5), (0.001, 6e-4)])], "id string, line array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([("highway=primary", [(-0.001, 0.0), (0.003, 0.0)])], "tags_text string, line array<struct<x:double,y:double>>")
    farms = spark.createDataFrame([([(0.0005, 0.0), (0.0015, 0.0), (0.0015, 0.001), (0.0005, 0.001), (0.0005, 0.0)],)], "ring array<struct<x:double,y:double>>")
    assert [r["id"] for r in pipelines.filter_detected(det, roads, farms).collect()] == ["new"]
    ways = spark.createDataFrame([("w", "{highway=primary, oneway=yes}", [(0.0, 0.0), (0.001, 0.0)])], "id string, tags_text string, line array<struct<x:double,y:double>>")
    signs = spark.createDataFrame([("s", 0.0004, 5e-5, 90.0), ("t", 0.5, 0.0, 90.0)], "id string, lon double, lat double, angle double")
    assert [(r["sign_id"], r["way_id"], round(r["angle_diff"], 3)) for r in pipelines.turn_lanes(ways, signs).collect()] == [("s", "w", 0.0)]


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {"ID": "x", "name": "é"}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]}, "properties": {"name": "m"}},
    ]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojson").write_text(json.dumps(doc))
    got = geojson.read_geojson(spark, str(tmp_path / "in"))
    assert [(r["original_id"], len(r["line"])) for r in got.orderBy("original_id").collect()] == [("1", 2), ("2", 2), ("x", 2)]
    out = got.select(geojson.feature("LineString", c("line"), c("tags")).alias("feature"))
    geojson.write_geojson(out, str(tmp_path / "out"), crs="urn:ogc:def:crs:OGC:1.3:CRS84", name="n")
    back = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert len(back["features"]) == 3 and back["name"] == "n" and back["crs"]["properties"]["name"].endswith("CRS84")
    geojson.write_geojson(out.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["features"] == []
    items = geojson.upload_items(got.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("id"), c("original_id")))), "roads", "2024-01-01").collect()
    assert {r["id"] for r in items} == {"x", "1", "2"} and all(r["properties"]["tofix:category"] == "roads" for r in items)


def test_raster(spark, tmp_path):
    from wayforge.functions import raster

    img = np.full((256, 256, 3), 60, np.uint8)
    img[:, 100:104] = 240
    img[:, 116:120] = 240
    lines = raster.marking_lines(img)
    assert len(lines) >= 2 and all(abs(a[0] - a[2]) <= 3 for a in lines)
    edges = raster.straight_edges(img)
    assert {round(x / 4) for x, *_ in edges} & {25, 26} and all(abs(a[0] - a[2]) <= 3 for a in edges)
    assert raster.straight_edges(np.zeros((256, 256, 3), np.uint8)) == []
    assert len(raster.component_stats(raster.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]], bool)))) == 2
    assert raster.linearity(np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]])) == 1.0
    tile = spark.createDataFrame([("pnoa_17_5_6.png", 256, 256, 3, bytearray(img.tobytes()), 17, 5, 6), ("bad.png", -1, -1, -1, bytearray(), None, None, None)], "origin string, height int, width int, nChannels int, data binary, z int, x int, y int")
    pairs = pipelines.double_lines(tile, lo=8, hi=25)
    report = {r["image"]: (r["ok"], r["pairs"]) for r in pipelines.image_report(tile, pairs).collect()}
    assert report["bad.png"] == (False, 0) and report["pnoa_17_5_6.png"][1] >= 1
    assert pipelines.straight_edges(tile).count() >= 2


def test_buffers():
    from wayforge.functions import raster

    a, b = [(0.0, 0.0), (10.0, 0.0)], [(0.0, 1.0), (10.0, 1.0)]
    assert raster.buffer_iou(a, a, 2.0) == pytest.approx(1, abs=1e-6)
    assert raster.strip_cover((0, -2), (0, 2), [(a[0], a[1])], 2.0) == pytest.approx(40 + np.pi * 4, rel=2e-3)
    assert 0.4 < raster.buffer_iou(a, b, 2.0) < 0.8
    mask, *_ = raster.closed_region([[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]], 2.0, 2.0, 0.5)
    assert mask.sum() * 0.25 == pytest.approx(100, rel=0.1)


def test_overture_and_quadkeys(spark, tmp_path):
    rows = [(1, (0.0, 0.1, 0.0, 0.1), "road", "primary", [("Meta",)]), (2, (5.0, 5.1, 5.0, 5.1), "road", "primary", [("Meta",)]), (3, (0.0, 0.1, 0.0, 0.1), "road", "primary", [("OpenStreetMap",)]), (4, (0.0, 0.1, 0.0, 0.1), "road", "primary", [])]
    df = spark.createDataFrame(rows, "id long, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, subtype string, class string, sources array<struct<dataset:string>>")
    df.write.parquet(str(tmp_path / "o"))
    assert [r["id"] for r in pipelines.non_osm_segments(geojson.read_overture(spark, str(tmp_path / "o"), (-1, -1, 1, 1))).collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    from wayforge.streaming import sign_stream

    nodes = (["a", "b", "c"], {"a": {"highway": "stop", "direction": "170"}, "b": {"highway": "stop", "direction": "200"}, "c": {"highway": "give_way", "direction": "0"}})
    w = ways_df(spark, tmp_path, [way(1, {"highway": "primary"}, [[0, 0], [0, 1], [0, 2]], nodes)])
    want = {(r["node_id"], r["alt_dir"]) for r in pipelines.sign_directions(w).collect()}
    w.write.parquet(str(tmp_path / "ways"))
    q = sign_stream.sign_directions(spark.readStream.schema(w.schema).parquet(str(tmp_path / "ways"))).writeStream.format("memory").queryName("signs").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["node_id"], r["alt_dir"]) for r in spark.table("signs").collect()} == want
