import pytest
from pyspark.sql import functions as F

from wayforge.operators import report

c = F.col


def test_numbers_run_through(spark):
    got = report.numbered(spark.range(1500).withColumnRenamed("id", "k"), ["k"]).orderBy("k").collect()
    assert [r["match_id"] for r in got] == [f"match_{i:03d}" for i in range(1, 1501)]


def test_counts(spark):
    m = spark.createDataFrame([("1", "p", "direct", "same_direction"), ("2", "q", "projection", "bidirectional_both"), ("3", "r", "direct", None)], "i string, j string, kind string, status string")
    r = report.conflation_counts(m, spark.range(6), spark.range(4)).first()
    assert (r["matches"], r["direct"], r["projected"], r["differences"], r["roads_a"], r["roads_b"], r["match_rate"]) == (3, 2, 1, 1, 6, 4, 0.5)
    assert report.conflation_counts(m.limit(0), spark.range(0), spark.range(0)).first()["match_rate"] == 0
    t = spark.createDataFrame([("a",), ("a",)], "triangle_id string")
    assert tuple(report.loop_counts(spark.createDataFrame([(True,), (False,)], "main boolean"), t).first()) == (2, 1, 1)


def test_rows_and_text(spark):
    line = [(0.0, 0.0), (3.0, 4.0)]
    s = spark.createDataFrame([("s", ["a", "b"], True, False, 3, 1, "yes", line), ("t", ["a"], False, False, 1, 1, None, line)], "segment_id string, original_ids array<string>, is_merged boolean, is_split boolean, start_weight int, end_weight int, oneway string, line array<struct<x:double,y:double>>")
    a, b = report.segment_rows(s).orderBy("segment_id").collect()
    assert (a["merged_id"], a["merged_count"], a["at_true_intersection"], a["length_meters"], a["direction"]) == ("a_b", 2, True, 5.0, "forward") and b["original_id"] == "a"
    text = report.image_text(spark.createDataFrame([("x", True, 4), ("y", False, 0)], "image string, ok boolean, pairs long")).first()["value"]
    assert text.splitlines() == ["images: 2", "readable: 1", "pairs: 4", "mean pairs per image with pairs: 4.0"]


def test_small_expressions(spark):
    straight = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 1, 2)))
    bent = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1))))
    r = spark.range(1).select(report.is_straight(straight).alias("a"), report.is_straight(bent).alias("b"), report.candidate_score(F.lit(9.0), F.lit(2.0)).alias("s"), report.candidate_score(F.lit(9.0), F.lit(0.0)).alias("z")).first()
    assert r["a"] and not r["b"] and r["s"] == 3.5 and r["z"] is None
    p = spark.createDataFrame([(1, 40.0, 1.0, 7), (1, 20.0, 3.0, 8), (1, 5.0, 4.0, 9)], "k long, angle_diff double, distance double, road_id long")
    assert report.first_within(p, "k").first()["road_id"] == 8
    z = report.zone_boxes(spark.createDataFrame([("0",), ("3",)], "quadkey string")).orderBy("quadkey").collect()
    assert (z[0]["minx"], z[0]["maxx"]) == (-180, 0) and z[0]["maxy"] == pytest.approx(85.0511, abs=1e-3) and (z[1]["minx"], z[1]["maxy"]) == (0, pytest.approx(0, abs=1e-9))
    m = report.maneuvers(spark.createDataFrame([(1, 5, "yes"), (2, 5, "no"), (3, 5, "-1")], "way_id long, a long, oneway string")).collect()
    assert [(r["node_id"], list(r["ways"])) for r in m] == [(5, [1, 3])]


def test_registered_tables(spark):
    spark.createDataFrame([("w", {"highway": "primary"}, {"iso:3166_1": "DE"}, {"quadkeys": ["12"]}, "d", "g"), ("x", {"highway": "path"}, {"iso:3166_1": "DE"}, {"quadkeys": ["12"]}, "d", "g")],
                          "id string, tags map<string,string>, metadata_str map<string,string>, metadata_array map<string,array<string>>, dt string, geometry_wkt string").createOrReplaceTempView("t_ways")
    assert [r["id"] for r in report.enriched_ways(spark, "t_ways", "DE", "d", ["12", "13"]).collect()] == ["w"]
    rows = [("s", 1.0, 1.0, 5, "straight", "DE", "d", 20, 0.5, "New", "arrow"), ("t", 1.0, 1.0, 5, "left", "DE", "d", 2, 0.5, "New", "arrow")]
    spark.createDataFrame(rows, "id string, lat double, lon double, angle int, detection_type string, country string, dt string, cluster_size int, confidence double, status string, message_type string").createOrReplaceTempView("t_signs")
    assert [(r["id"], r["arrow_type"]) for r in report.sign_detections(spark, "t_signs", "DE", "d", (0, 0, 2, 2)).collect()] == [("s", "through")]
