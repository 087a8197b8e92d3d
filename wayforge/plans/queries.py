"""Registered queries of the road-network operators, over the derived fixture networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.functions import angles, geo, pixels, tags
from wayforge.operators import graph, matching, spatial
from wayforge.sources import fixtures as fx

c = F.col
# NEAR_M: 1.15e-4 degrees, a strip of 7e-5 and 4.5e-5 around it.
LOOP_M, SIGN_REACH, NEAR_M = 200.0, 30.0, 12.8


def r(col, n: int = 6):
    return F.round(col, n)


def half_up(col, n: int):
    """Rounded as SQL engines round a double: col * 10**n to the nearest whole number, halves away from zero. r goes by
    the decimal digits, which differs where either is a half."""
    y = F.abs(col * 10.0**n)
    return F.signum(col) * (F.floor(y) + (y - F.floor(y) >= 0.5).cast("int")) / 10.0**n


def pt(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def sign_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric sign azimuths at way nodes become forward or backward along the way."""
    wn = fx.way_nodes(spark, sf_dir).join(fx.ways(spark, sf_dir).where(c("highway").isin(*tags.ROAD_CLASSES)).select("way_id"), "way_id")
    sign = fx.signs(spark, sf_dir).select(c("event_id").alias("node_id"), c("angle").cast("double").alias("direction"))
    at = W.partitionBy("way_id").orderBy("seq")
    near = wn.withColumns({"nlon": F.lead("lon").over(at), "nlat": F.lead("lat").over(at), "plon": F.lag("lon").over(at), "plat": F.lag("lat").over(at)})
    ahead, back = angles.rotation_angle(c("lon"), c("lat"), c("nlon"), c("nlat")), angles.rotation_angle(c("lon"), c("lat"), c("plon"), c("plat"))
    to_next = F.coalesce(ahead, angles.rotation_angle(c("plon"), c("plat"), c("lon"), c("lat")))
    to_prev = F.coalesce(back, angles.rotation_angle(c("nlon"), c("nlat"), c("lon"), c("lat")))
    got = near.join(sign, "node_id").withColumns({"to_next": to_next, "to_prev": to_prev})
    return got.select("way_id", "node_id", "seq", "direction", angles.forward_or_backward(c("direction"), c("to_next"), c("to_prev")).alias("alt_dir"))


def highway_filter(spark, sf_dir):
    return fx.ways(spark, sf_dir).where(c("highway").isin(*tags.ROAD_CLASSES)).select("way_id", "highway")


def traversable_edges(spark, sf_dir):
    return fx.ways(spark, sf_dir).where(tags.traversable(c("junction"), c("oneway"))).select("way_id", "a", "b")


def loop_start_edges(spark, sf_dir):
    return fx.ways(spark, sf_dir).where(tags.loop_start(c("junction"), c("oneway"))).select("way_id", "a")


def oneway_normalize(spark, sf_dir):
    return fx.ways(spark, sf_dir).select("way_id", "oneway", tags.oneway_state(c("oneway")).alias("state"))


def map_text(spark, sf_dir):
    pieces = [F.concat(F.lit(f"{k}="), F.coalesce(c(k), F.lit(""))) for k in ("highway", "maxspeed", "junction")]
    odd = F.when(c("way_id") % 9 == 0, "note=a=b").when(c("way_id") % 9 == 1, "surface=[DELETED]")
    one = F.when(c("oneway").isNotNull(), F.concat(F.lit("oneway="), c("oneway")))
    return fx.ways(spark, sf_dir).select("way_id", F.concat(F.lit("{"), F.concat_ws(", ", *pieces, odd, one), F.lit("}")).alias("text"))


def tag_text_parse(spark, sf_dir):
    m = map_text(spark, sf_dir).select("way_id", tags.parse_map_text(c("text")).alias("m"))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return m.select("way_id", flat.alias("tags"), F.size("m").cast("long").alias("n"))


def arrow_case_remap(spark, sf_dir):
    s = fx.signs(spark, sf_dir).where("lon > -1.25 and lon < -1.235 and lat > 37.72 and lat < 37.729")
    return s.select("event_id", F.lit("turn_lanes").alias("feature_type"), tags.arrow_name(c("detection_type")).alias("arrow_type"))


def array_quadkey_filter(spark, sf_dir):
    w = fx.ways(spark, sf_dir).withColumn("qks", F.array((c("way_id") % 7).cast("string"), (c("way_id") % 5 + 10).cast("string")))
    return w.where(F.exists("qks", lambda q: q.isin("3", "12")) & c("highway").isin(*tags.ROAD_CLASSES)).select("way_id", F.array_join("qks", ",").alias("qks"))


def quadkey_children(spark, sf_dir):
    qk = fx.nodes(spark, sf_dir).select(F.lpad(F.conv((c("node_id") % 64).cast("string"), 10, 4), 3, "0").alias("qk")).distinct()
    return qk.select(F.explode(tags.quadkey_children(c("qk"), 5)).alias("child")).distinct()


def non_osm_segments(spark, sf_dir):
    source = F.when(c("way_id") % 3 == 0, "OpenStreetMap").when(c("way_id") % 3 == 1, "Meta")
    w = fx.ways(spark, sf_dir).withColumn("sources", F.when(c("way_id") % 10 == 9, F.array().cast("array<struct<dataset:string>>")).otherwise(F.array(F.struct(source.alias("dataset")), F.struct(F.lit("osm").alias("dataset")))))
    first = F.lower(F.try_element_at(c("sources"), F.lit(1))["dataset"])
    return w.where(~first.isin("openstreetmap", "osm") & c("highway").isin(*tags.ROAD_CLASSES_LIVING)).select("way_id", "highway")


def intersection_weights(spark, sf_dir):
    return graph.intersection_weights(fx.way_nodes(spark, sf_dir)).select("node_id", c("weight").cast("long").alias("weight"))


def true_intersections(spark, sf_dir):
    return graph.distinct_weights(fx.way_nodes(spark, sf_dir)).where("weight >= 3").select("node_id", c("weight").cast("long").alias("weight"))


def adjacency_lists(spark, sf_dir):
    return graph.adjacency(fx.way_nodes(spark, sf_dir)).select("node_id", F.array_join("ways", ",").alias("ways"))


def mercator_project(spark, sf_dir):
    n = fx.nodes(spark, sf_dir).withColumns({"x": geo.merc_x(c("lon")), "y": geo.merc_y(c("lat"))})
    return n.select("node_id", r(c("x"), 4).alias("x"), r(c("y"), 4).alias("y"), r(geo.lon_of(c("x"))).alias("lon_back"), r(geo.lat_of(c("y"))).alias("lat_back"))


def tile_bbox(spark, sf_dir):
    n = fx.nodes(spark, sf_dir).select("node_id", F.lit(17).alias("z"), (65000 + c("node_id") % 50).alias("x"), (50500 + c("node_id") % 37).alias("y"))
    b = geo.tile_bbox(c("z"), c("x"), c("y"))
    return n.withColumn("b", b).select("node_id", *(r(c(f"b.{k}"), 4).alias(k) for k in ("minx", "miny", "maxx", "maxy")))


def pixel_to_lonlat(spark, sf_dir):
    n = fx.pixel_lines(spark, sf_dir).withColumn("b", geo.tile_bbox(F.lit(17), 65000 + c("image") % 50, 50500 + c("image") % 37))
    p = geo.pixel_to_lonlat(c("x1"), c("y1"), c("b"))
    return n.withColumn("p", p).select("line_idx", r(c("p.lon"), 8).alias("lon"), r(c("p.lat"), 8).alias("lat"))


def way_chord_length(spark, sf_dir):
    w = fx.way_lines(spark, sf_dir)
    return w.select("way_id", r(geo.geodesic(c("lon1"), c("lat1"), c("lon2"), c("lat2")), 4).alias("metres"), r(geo.geodesic(c("lon1"), c("lat1"), c("lon2"), c("lat2"), axis_swapped=True), 4).alias("metres_swapped"))


def polyline_length(spark, sf_dir):
    return fx.way_lines(spark, sf_dir).select("way_id", r(geo.geodesic_length(c("line")), 4).alias("metres"), r(geo.planar_length(c("line")), 9).alias("degrees"))


def bearing(spark, sf_dir):
    w = fx.way_lines(spark, sf_dir)
    return w.select("way_id", r(angles.bearing(c("lon1"), c("lat1"), c("lon2"), c("lat2"))).alias("bearing"), r(angles.rotation_angle(c("lon1"), c("lat1"), c("lon2"), c("lat2"))).alias("azimuth"))


def _merc_lines(spark, sf_dir):
    return fx.way_lines(spark, sf_dir).select("way_id", "oneway", "highway", geo.project_line(F.array(pt(c("lon1"), c("lat1")), pt(c("lon2"), c("lat2")))).alias("line"))


def _merc_signs(spark, sf_dir):
    return fx.signs(spark, sf_dir).select("event_id", c("angle").cast("double").alias("angle"), geo.merc_x(c("lon")).alias("x"), geo.merc_y(c("lat")).alias("y"))


def _sign_road_pairs(spark, sf_dir):
    return spatial.points_to_lines(_merc_signs(spark, sf_dir), _merc_lines(spark, sf_dir), SIGN_REACH, cell=64.0)


def nearest_road(spark, sf_dir):
    """Each sign's road by (angle difference, distance, road)."""
    got = _sign_road_pairs(spark, sf_dir)
    p, q = F.element_at("r_line", 1), F.element_at("r_line", -1)
    road = angles.rotation_angle(p["x"], p["y"], q["x"], q["y"])
    got = got.withColumn("diff", r(angles.line_angle_diff(c("l_angle"), road, F.coalesce(c("r_oneway"), F.lit("no"))))).withColumn("d", r(c("near.d"), 4))
    best = spatial.best_per(got, ["l_event_id"], [c("diff"), c("d"), c("r_way_id")])
    found = best.select(c("l_event_id").alias("event_id"), c("r_way_id").alias("way_id"), c("diff").alias("angle_diff"), c("d").alias("distance"))
    return fx.signs(spark, sf_dir).select("event_id").join(found, "event_id", "left")


def split_way(spark, sf_dir):
    """Halves of each way at the point nearest to its closest sign."""
    got = _sign_road_pairs(spark, sf_dir).withColumn("d", r(c("near.d"), 4))
    first = spatial.best_per(got, ["r_way_id"], [c("d"), c("l_event_id")])
    first = first.where("near.t > 0 and near.t < 1").withColumn("s", geo.split_line(c("r_line"), c("near.seg"), c("near.t")))
    half = F.explode(F.array(F.struct(F.lit("_a").alias("k"), c("s.a").alias("g")), F.struct(F.lit("_b").alias("k"), c("s.b").alias("g"))))
    rows = first.select("r_way_id", half.alias("h"))
    return rows.select(F.concat(c("r_way_id").cast("string"), c("h.k")).alias("half_id"), r(geo.planar_length(c("h.g")), 3).alias("length"))


def proximity_thinning(spark, sf_dir):
    pts = fx.signs(spark, sf_dir).select(c("event_id").alias("id"), "lon", "lat")
    return spatial.thin(pts, 6.0).select(c("id").alias("event_id"))


def detections_near_network(spark, sf_dir):
    major = _merc_lines(spark, sf_dir).where(~F.concat(F.lit("highway="), c("highway")).rlike(tags.MINOR_OR_LOCAL))
    near = spatial.points_to_lines(_merc_signs(spark, sf_dir), major, NEAR_M, cell=48.0)
    return near.select(c("l_event_id").alias("event_id")).distinct()


def detections_unmatched(spark, sf_dir):
    near = spatial.points_to_lines(_merc_signs(spark, sf_dir), _merc_lines(spark, sf_dir).where("highway <> 'service'"), SIGN_REACH, cell=2 * SIGN_REACH)
    return fx.signs(spark, sf_dir).select("event_id").join(near.select(c("l_event_id").alias("event_id")), "event_id", "left_anti")


def _loop_edges(spark, sf_dir):
    return fx.way_lines(spark, sf_dir).where(tags.traversable(c("junction"), c("oneway"))).select(
        "way_id", "a", "b", geo.geodesic(c("lon1"), c("lat1"), c("lon2"), c("lat2")).alias("cost"))


def _loops(spark, sf_dir):
    starts = fx.ways(spark, sf_dir).where(tags.loop_start(c("junction"), c("oneway"))).select(c("a").alias("node")).distinct()
    return graph.closed_loops(_loop_edges(spark, sf_dir), starts, LOOP_M, fx.nodes(spark, sf_dir).select(c("node_id").alias("node"), "lon", "lat"))


def closed_loops(spark, sf_dir):
    return _loops(spark, sf_dir).select(F.array_join(F.array_sort("path"), ",").alias("ways"), F.size("path").cast("long").alias("n")).distinct()


def untagged_roundabouts(spark, sf_dir):
    """Ordered loops with at least two nodes of weight 3 or more; their pooled vertices tell whether they are round."""
    loops = _loops(spark, sf_dir).select("path").distinct()
    wn = fx.way_nodes(spark, sf_dir)
    heavy = graph.intersection_weights(wn).where("weight >= 3").select("node_id", F.lit(1).alias("heavy"))
    each = loops.select("path", F.explode("path").alias("way_id")).join(wn.select("way_id", "seq", "node_id", "lon", "lat"), "way_id").join(heavy, "node_id", "left")
    g = each.groupBy("path").agg(
        F.countDistinct(F.when(c("heavy") == 1, c("node_id"))).alias("heavy"),
        F.array_sort(F.collect_list(F.struct("way_id", "seq", c("lon").alias("x"), c("lat").alias("y")))).alias("pts"),
    )
    is_round = geo.roundness(F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return g.where("heavy >= 2").select(F.array_join("path", ",").alias("path"), c("heavy").cast("long").alias("heavy"), is_round.alias("is_round"))


def triangles(spark, sf_dir):
    """Three-way loops with their non-residential flag and shoelace area, where every ring angle is 5 to 175 degrees."""
    got = _loops(spark, sf_dir).where("size(path) = 3").select(F.array_sort("path").alias("path")).distinct()
    w = fx.way_lines(spark, sf_dir).select("way_id", "highway", "a", "b", pt(c("lon1"), c("lat1")).alias("p"), pt(c("lon2"), c("lat2")).alias("q"))
    each = got.select("path", F.explode("path").alias("way_id")).join(w, "way_id")
    g = each.groupBy("path").agg(
        F.bool_or(~F.coalesce(c("highway").isin("residential", "unclassified"), F.lit(False))).alias("main"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct(c("a").alias("id"), c("p")), F.struct(c("b").alias("id"), c("q").alias("p"))))))).alias("v"),
    ).where("size(v) = 3")
    v = lambda i, k: c("v")[i]["p"][k]
    ang = [angles.vertex_angle(v((i + 1) % 3, "x"), v((i + 1) % 3, "y"), v(i, "x"), v(i, "y"), v((i + 2) % 3, "x"), v((i + 2) % 3, "y")) for i in range(3)]
    ring = F.array(*(pt(v(i % 3, "x"), v(i % 3, "y")) for i in range(4)))
    g = g.withColumns({"area": geo.shoelace_m2(ring), "least": F.least(*ang), "most": F.greatest(*ang)})
    return g.where("area >= 50 and least >= 5 and most <= 175").select(F.array_join("path", ",").alias("ways"), c("main").alias("has_non_residential"), r(c("area"), 2).alias("area_m2"))


def speed_reachability(spark, sf_dir):
    """Nodes without a limit of at most 50 on their own ways or within 50 m along ways with a limit tag."""
    w = fx.way_lines(spark, sf_dir).withColumn("cost", geo.geodesic(c("lon1"), c("lat1"), c("lon2"), c("lat2")))
    cross = graph.both_directions(w.where(c("maxspeed").isNotNull()).select("way_id", "a", "b", "cost")).select("way_id", "src", "dst", "cost")
    seeds = fx.nodes(spark, sf_dir).select(c("node_id").alias("seed"), c("node_id").alias("node"), F.lit(50.0).alias("left"))
    at = graph.reach(cross, seeds)
    touch = graph.both_directions(w.select("way_id", "a", "b", "cost")).select("way_id", "src").distinct()
    low = w.where(tags.int_of(c("maxspeed")) <= 50).select("way_id")
    ok = at.join(touch, at["node"] == touch["src"]).join(low, "way_id", "left_semi").select("seed").distinct()
    return seeds.select("seed").join(ok, "seed", "left_anti").select(c("seed").alias("node_id"))


def prolongation(spark, sf_dir):
    """Ways from each node to the next intersections (nodes where three or more ways meet)."""
    t = fx.ways(spark, sf_dir)
    e = graph.both_directions(t.select("way_id", "a", "b", F.lit(0.0).alias("cost"))).select("way_id", "src", "dst")
    degree = e.groupBy("src").agg(F.countDistinct("way_id").alias("n")).where("n >= 3").select(c("src").alias("node"))
    seeds = fx.nodes(spark, sf_dir).select(c("node_id").alias("seed"), c("node_id").alias("node"))
    return graph.flood(e, seeds, degree)


def connected_components(spark, sf_dir):
    return graph.components(fx.ways(spark, sf_dir).select("a", "b")).select("node", "root")


def _chain_ends(spark, sf_dir):
    """Ends of all ways; each class is a network of its own, so a place is a node and a class."""
    at = lambda k: F.concat_ws("/", k, "highway").alias(k)
    w = fx.ways(spark, sf_dir).select("way_id", "oneway", at("a"), at("b"))
    one = tags.oneway_state(c("oneway"))
    oriented = w.select("way_id", (one != "bidirectional").alias("oneway"), F.when(one == "reverse", c("b")).otherwise(c("a")).alias("s"), F.when(one == "reverse", c("a")).otherwise(c("b")).alias("e"))
    ends = oriented.select("way_id", "oneway", c("s").alias("node_id"), F.lit(True).alias("is_start")).unionByName(oriented.select("way_id", "oneway", c("e").alias("node_id"), F.lit(False).alias("is_start")))
    true_nodes = ends.groupBy("node_id").count().where("count >= 3").select("node_id")
    return ends, true_nodes


def chain_merge(spark, sf_dir):
    links = graph.chain_links(*_chain_ends(spark, sf_dir))
    return graph.components(links).select(c("node").alias("way_id"), c("root").alias("chain"))


def chain_lines(spark, sf_dir):
    """Merged lines of the chains."""
    links = graph.components(graph.chain_links(*_chain_ends(spark, sf_dir)))
    lines = fx.way_lines(spark, sf_dir).select(c("way_id").alias("node"), F.array(pt(c("lon1"), c("lat1")), pt(c("lon2"), c("lat2"))).alias("line"))
    members = links.join(lines, "node").select("root", c("node").alias("way_id"), "line")
    return graph.merge_chain(members).groupBy("root").agg(F.sum(F.size("way_ids")).cast("long").alias("n_ways"), r(F.sum(geo.planar_length(c("line"))), 7).alias("degrees"))


def split_segments(spark, sf_dir):
    """Ways cut at inner nodes whose private middle node is chosen (every third way)."""
    wn = fx.way_nodes(spark, sf_dir)
    cut = wn.where("seq = 1 and way_id % 3 = 0").select("node_id")
    return graph.split_at(wn, cut).select(F.concat_ws("_", "way_id", "part").alias("segment_id"), F.size("nodes").cast("long").alias("n_nodes"))


def _network_pairs(spark, sf_dir):
    a = fx.way_lines(spark, sf_dir).select(c("way_id").alias("id"), "oneway", "lon1", "lat1", "lon2", "lat2")
    b = fx.roads_b(spark, sf_dir).select(c("way_id").alias("id"), "oneway", "lon1", "lat1", "lon2", "lat2")
    line = lambda d: d.withColumn("line", geo.project_line(F.array(pt(c("lon1"), c("lat1")), pt(c("lon2"), c("lat2")))))
    a, b = (d.withColumns(spatial.line_box(c("line"))) for d in (line(a), line(b)))
    got = spatial.box_join(a, b, cell=96.0, reach=20.0)
    return got.withColumn("distance", geo.line_distance(c("l_line"), c("r_line"))).where("distance <= 20")


def _metrics(spark, sf_dir):
    g = _network_pairs(spark, sf_dir)
    la, lb = geo.planar_length(c("l_line")), geo.planar_length(c("r_line"))
    v = lambda k: (c(k)[1]["x"] - c(k)[0]["x"], c(k)[1]["y"] - c(k)[0]["y"])
    cosine = F.coalesce(angles.direction_cosine(*v("l_line"), *v("r_line")), F.lit(0.0))
    # share of 21 places along the first line that lie within 10 m of the second: the sampled form of the overlap of buffers
    places = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: pt(c("l_line")[0]["x"] + k / 20.0 * (c("l_line")[1]["x"] - c("l_line")[0]["x"]), c("l_line")[0]["y"] + k / 20.0 * (c("l_line")[1]["y"] - c("l_line")[0]["y"])))
    share = geo.share_within(places, c("r_line"), 10.0)
    g = g.withColumns({"ratio": matching.length_ratio(la, lb), "hausdorff": geo.hausdorff(c("l_line"), c("r_line")), "similarity": F.abs(cosine), "overlap": share})
    return g.withColumn("score", matching.match_score(c("hausdorff"), c("ratio"), c("overlap"), c("similarity")))


def network_candidates(spark, sf_dir):
    return _network_pairs(spark, sf_dir).select(c("l_id").alias("i"), c("r_id").alias("j"), r(c("distance"), 3).alias("distance"))


def match_scores(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(c("l_id").alias("i"), c("r_id").alias("j"), r(c("hausdorff"), 3).alias("hausdorff"), r(c("ratio"), 5).alias("length_ratio"), r(c("overlap"), 5).alias("overlap"), r(c("score"), 5).alias("score"))


def _good(spark, sf_dir):
    m = _metrics(spark, sf_dir).where(matching.good_match(c("ratio"), c("overlap"), c("similarity")))
    return m.select(c("l_id").alias("i"), c("r_id").alias("j"), r(c("score"), 6).alias("score"), r(c("distance"), 3).alias("distance"))


def greedy_match(spark, sf_dir):
    return matching.greedy(_good(spark, sf_dir)).select("i", "j", "score")


def _projection_pairs(spark, sf_dir, reach: float = 15.0):
    a = fx.way_lines(spark, sf_dir).select(c("way_id").alias("id"), geo.project_line(F.array(pt(c("lon1"), c("lat1")), pt(c("lon2"), c("lat2")))).alias("line"))
    b = fx.roads_b(spark, sf_dir).select(c("way_id").alias("id"), geo.project_line(F.array(pt(c("lon1"), c("lat1")), pt(c("lon2"), c("lat2")))).alias("line"))
    a, b = (d.withColumns(spatial.line_box(c("line"))) for d in (a.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: geo.interpolate(c("line"), k / 4.0, normalized=True))), b))
    got = spatial.box_join(a, b, cell=96.0, reach=reach)
    got = got.withColumn("d", geo.bound(geo.pairs(c("r_line")), lambda segs: F.transform("l_samples", lambda p: geo.distance_to(segs, p["x"], p["y"]))))
    v = lambda k: (c(k)[1]["x"] - c(k)[0]["x"], c(k)[1]["y"] - c(k)[0]["y"])
    return got.select(
        c("l_id").alias("i"), c("r_id").alias("j"), r(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / 5, 4).alias("distance"),
        (F.size(F.filter("d", lambda x: x <= reach)) / 5).alias("coverage"), F.abs(angles.direction_cosine(*v("l_line"), *v("r_line"))).alias("similarity"),
    )


def projection_match(spark, sf_dir):
    p = _projection_pairs(spark, sf_dir).where("similarity > 0.7 and coverage >= 0.6 and distance <= 15")
    return matching.best_per_i(p, ["distance", "j"]).select("i", "j", "distance", r(c("coverage"), 4).alias("coverage"))


def combined_match(spark, sf_dir):
    """The greedy one-to-one set, and for roads it leaves over the projected match."""
    direct = matching.greedy(_good(spark, sf_dir))
    p = _projection_pairs(spark, sf_dir).where("similarity > 0.7 and coverage >= 0.6 and distance <= 15")
    return matching.combined(direct, matching.best_per_i(p, ["distance", "j"]))


def direction_differences(spark, sf_dir):
    """Direction labels of the greedy one-to-one set, one-way against the other network; equal two-way pairs are no difference."""
    best = matching.greedy(_good(spark, sf_dir)).select("i", "j")
    p = lambda d: d.select("id", tags.oneway_state(c("oneway")).alias("state"), "lon1", "lat1", "lon2", "lat2")
    a = p(fx.way_lines(spark, sf_dir).where(~F.coalesce(c("junction").isin("roundabout", "circular"), F.lit(False))).withColumn("id", c("way_id"))).alias("a")
    b = p(fx.roads_b(spark, sf_dir).withColumn("id", c("way_id"))).alias("b")
    g = best.join(a, c("i") == c("a.id")).join(b, c("j") == c("b.id"))
    sign = lambda k: F.when(c(f"{k}.state") == "reverse", -1.0).otherwise(1.0)
    v = lambda k: (sign(k) * (c(f"{k}.lon2") - c(f"{k}.lon1")), sign(k) * (c(f"{k}.lat2") - c(f"{k}.lat1")))
    label = angles.direction_label(c("a.state") != "bidirectional", c("b.state") != "bidirectional", angles.direction_cosine(*v("a"), *v("b")))
    return g.select("i", "j", label.alias("status")).where("status <> 'bidirectional_both'")


def parallel_pairs(spark, sf_dir):
    p = pixels.parallel_pairs(fx.pixel_lines(spark, sf_dir))
    return p.select("image", "i", "j", half_up(c("distance"), 4).alias("distance"), half_up(c("overlap"), 3).alias("overlap"), half_up(c("angle_diff"), 3).alias("angle_diff"))


def pair_score(spark, sf_dir):
    p = pixels.parallel_pairs(fx.pixel_lines(spark, sf_dir)).where("shorter >= 20 and length_ratio > 0.6")
    return p.select("image", "i", "j", half_up(c("score"), 5).alias("score"))


def double_lines(spark, sf_dir):
    p = pixels.parallel_pairs(fx.pixel_lines(spark, sf_dir)).where("shorter >= 20 and length_ratio > 0.6").withColumn("score", half_up(c("score"), 6))
    return matching.greedy(p, one_sided=False, group=["image"]).select("image", "i", "j", "score")


def image_summary(spark, sf_dir):
    n = fx.pixel_lines(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("lines"))
    p = pixels.parallel_pairs(fx.pixel_lines(spark, sf_dir)).groupBy("image").agg(F.count(F.lit(1)).alias("pairs"), half_up(F.avg("score"), 4).alias("mean_score"))
    return n.join(p, "image", "left").select("image", "lines", F.coalesce("pairs", F.lit(0)).alias("pairs"), "mean_score")


def overlap_filter(spark, sf_dir):
    """Detected roads (second network) kept: at least 15 m, and covered less than the length-dependent bound by known roads."""
    line = F.array(pt(c("lon1"), c("lat1")), pt(c("lon2"), c("lat2")))
    det = fx.roads_b(spark, sf_dir).select(c("way_id").alias("id"), line.alias("line"))
    known = fx.way_lines(spark, sf_dir).where(~F.concat(F.lit("highway="), c("highway")).rlike(tags.MINOR)).select(line.alias("line"))
    g = spatial.covered_share(det, known, 7e-5)
    share = c("covered") / c("length")
    return g.where((c("length") >= 15) & (share < F.least(F.lit(0.85), c("length") / 40 * 0.85))).select(c("id").alias("way_id"), r(c("length"), 3).alias("length"), r(share, 4).alias("share"))


def geohash12(spark, sf_dir):
    return fx.nodes(spark, sf_dir).select("node_id", geo.geohash(c("lon"), c("lat")).alias("geohash"))


def wkt_hash_id(spark, sf_dir):
    text = F.concat(F.lit("POINT ("), c("node_id").cast("string"), F.lit(" "), (c("node_id") * 7 % 1000).cast("string"), F.lit(")"))
    return fx.nodes(spark, sf_dir).select("node_id", geo.wkt_hash_id(text).alias("hash_id"))


def tag_regex_exclude(spark, sf_dir):
    t = fx.ways(spark, sf_dir).select("way_id", F.concat_ws(", ", F.concat(F.lit("highway="), c("highway")), F.when(c("way_id") % 6 == 0, "name=old trail"), F.when(c("way_id") % 8 == 0, "waterway=ditch")).alias("tags"))
    return t.where(~c("tags").rlike(tags.MINOR)).select("way_id", (~c("tags").rlike(tags.MINOR_OR_LOCAL)).alias("major"))


def snap_nodes(spark, sf_dir):
    n = fx.nodes(spark, sf_dir).select("node_id", geo.merc_x(c("lon")).alias("x"), geo.merc_y(c("lat")).alias("y"))
    return n.select("node_id", geo.snap_key(c("x"), 0.1).alias("kx"), geo.snap_key(c("y"), 0.1).alias("ky"))


def project_tags(spark, sf_dir):
    m = F.map_filter(F.create_map(F.lit("highway"), c("highway"), F.lit("oneway"), c("oneway"), F.lit("maxspeed"), c("maxspeed"), F.lit("lanes:turn"), c("junction"), F.lit("source:lanes"), c("highway")), lambda _, v: v.isNotNull())
    w = fx.ways(spark, sf_dir).select("way_id", m.alias("m"))
    flat = lambda col: F.array_join(F.array_sort(F.map_keys(col)), ",")
    return w.select("way_id", flat(tags.prefix_keys(tags.keep_keys(c("m"), ("highway", "oneway", "maxspeed")))).alias("basic"), flat(tags.output_keys(c("m"), ("highway",), ())).alias("output"))


QUERIES = {f.__name__: f for f in (
    sign_direction, highway_filter, traversable_edges, loop_start_edges, oneway_normalize, tag_text_parse, arrow_case_remap, array_quadkey_filter, quadkey_children,
    non_osm_segments, intersection_weights, true_intersections, adjacency_lists, mercator_project, tile_bbox, pixel_to_lonlat, way_chord_length, polyline_length, bearing,
    nearest_road, split_way, proximity_thinning, detections_near_network, detections_unmatched, closed_loops, untagged_roundabouts, triangles, speed_reachability, prolongation,
    connected_components, chain_merge, chain_lines, split_segments, network_candidates, match_scores, greedy_match, projection_match, combined_match, direction_differences,
    parallel_pairs, pair_score, double_lines, image_summary, overlap_filter, geohash12, wkt_hash_id, tag_regex_exclude, snap_nodes, project_tags,
)}
