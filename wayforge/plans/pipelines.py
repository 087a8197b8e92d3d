"""The composite pipelines over user data: DataFrames in, DataFrames of features out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.functions import angles, geo, pixels, tags
from wayforge.operators import graph, matching, spatial

c = F.col


def sign_directions(ways: DataFrame) -> DataFrame:
    """way_id, node_id, lon, lat, alt_dir for sign nodes with a numeric direction. ways: way_id, tags, nodes."""
    from wayforge.sources.geojson import explode_nodes

    wn = explode_nodes(ways.where(tags.get(c("tags"), "highway").isin(*tags.ROAD_CLASSES)))
    at = W.partitionBy("way_id").orderBy("seq")
    near = wn.withColumns({"nlon": F.lead("lon").over(at), "nlat": F.lead("lat").over(at), "plon": F.lag("lon").over(at), "plat": F.lag("lat").over(at)})
    direction = tags.int_of(tags.get(c("tags"), "direction")).cast("double")
    sign = near.where(tags.get(c("tags"), "highway").isin("stop", "give_way", "traffic_signals")).withColumn("direction", direction).where("direction is not null")
    rot = angles.rotation_angle
    to_next = F.coalesce(rot(c("lon"), c("lat"), c("nlon"), c("nlat")), rot(c("plon"), c("plat"), c("lon"), c("lat")))
    to_prev = F.coalesce(rot(c("lon"), c("lat"), c("plon"), c("plat")), rot(c("nlon"), c("nlat"), c("lon"), c("lat")))
    return sign.where("nlon is not null or plon is not null").select("way_id", "node_id", "lon", "lat", angles.forward_or_backward(c("direction"), to_next, to_prev).alias("alt_dir"))


def way_edges(ways: DataFrame) -> DataFrame:
    """way_id, a, b, cost and tag columns: ends of each way and their distance. ways: way_id, tags, nodes."""
    first, last = F.element_at("nodes", 1), F.element_at("nodes", -1)
    xy = lambda n, i: F.element_at(n["geometry"]["coordinates"], i)
    get = lambda k: tags.get(c("tags"), k).alias(k.replace(":", "_"))
    return ways.where(F.size("nodes") > 1).select(
        "way_id", first["id"].alias("a"), last["id"].alias("b"), geo.geodesic(xy(first, 1), xy(first, 2), xy(last, 1), xy(last, 2)).alias("cost"),
        *(get(k) for k in ("highway", "junction", "oneway", "maxspeed", "maxspeed:forward", "maxspeed:backward")),
    )


def loops(ways: DataFrame, budget: float = 200.0) -> DataFrame:
    """start, path, cost of closed loops of two-way roads without junction tag."""
    e = way_edges(ways)
    starts = e.where(tags.loop_start(c("junction"), c("oneway"))).select(c("a").alias("node"))
    return graph.closed_loops(e.where(tags.traversable(c("junction"), c("oneway"))), starts, budget)


def _ring_points(found: DataFrame, ways: DataFrame) -> DataFrame:
    from wayforge.sources.geojson import explode_nodes

    wn = explode_nodes(ways)
    heavy = graph.intersection_weights(wn).where("weight >= 3").select("node_id", F.lit(1).alias("heavy"))
    each = found.select("path", F.posexplode("path").alias("k", "way_id")).join(wn.select("way_id", "seq", "node_id", "lon", "lat"), "way_id").join(heavy, "node_id", "left")
    return each.groupBy("path").agg(
        F.countDistinct(F.when(c("heavy") == 1, c("node_id"))).alias("n_heavy"),
        F.array_sort(F.collect_list(F.struct("k", "seq", "node_id", c("lon").alias("x"), c("lat").alias("y")))).alias("pts"),
    )


def untagged_roundabouts(ways: DataFrame, budget: float = 200.0) -> DataFrame:
    """path, way_id: a row for each way of each round loop; rotations and directions are separate loops."""
    ring = _ring_points(loops(ways, budget).select("path").distinct(), ways).where("n_heavy >= 2")
    is_round = geo.roundness(F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return ring.where(is_round).select("path", F.explode("path").alias("way_id"))


def triangles(ways: DataFrame, budget: float = 200.0, least_area: float = 50.0) -> DataFrame:
    """triangle_id, path, way_id, has_non_residential: loops of three ways and more whose ring, with all its vertices, is a triangle.

    The ring has at least the area, and of its outline, scaled to the same extent on both axes and simplified by 2 % of its
    length, three corners stay, of 5 to 175 degrees each. A side may be cut into several ways; a round loop is none.
    """
    key = F.array_sort("path")
    found = loops(ways, budget).where("size(path) >= 3").groupBy(key.alias("ids")).agg(F.min(F.struct("path", "start")).alias("one"))
    at = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), F.element_at(n["geometry"]["coordinates"], 1).alias("x"), F.element_at(n["geometry"]["coordinates"], 2).alias("y")))
    road = ways.select("way_id", (~F.coalesce(tags.get(c("tags"), "highway").isin("residential", "unclassified"), F.lit(False))).alias("main"), at.alias("at"))
    each = found.select("ids", c("one.start").alias("start"), F.posexplode("one.path").alias("k", "way_id")).join(road, "way_id")
    # A loop is no longer than the budget, so its ways fit in a row.
    whole = each.groupBy("ids").agg(F.first("start").alias("start"), F.bool_or("main").alias("main"), F.array_sort(F.collect_list(F.struct("k", "at"))).alias("sides"))
    # Each way is turned so that it begins where the one before ends.
    begin = F.struct(c("start").alias("cur"), F.array().cast("array<struct<x:double,y:double>>").alias("ring"))

    def walk(done, side):
        turned = F.when(F.element_at(side["at"], 1)["id"] == done["cur"], side["at"]).otherwise(F.reverse(side["at"]))
        return geo.bound(turned, lambda t: F.struct(F.element_at(t, -1)["id"].alias("cur"), F.concat(done["ring"], F.transform(F.slice(t, F.lit(1), F.size(t) - 1), lambda v: pt(v["x"], v["y"]))).alias("ring")))

    open_ring = F.aggregate("sides", begin, walk)["ring"]
    g = whole.select("ids", "main", open_ring.alias("ring")).where(geo.shoelace_m2(F.concat("ring", F.slice("ring", 1, 1))) >= least_area)

    @F.pandas_udf("boolean")
    def is_triangle(rings):
        import numpy as np
        import pandas as pd

        from wayforge.functions import raster

        return pd.Series([raster.has_three_corners(np.array([(v["x"], v["y"]) for v in r])) for r in rings])

    ok = g.where(is_triangle("ring"))
    return ok.select(F.sha2(F.array_join(c("ids").cast("array<string>"), ","), 256).alias("triangle_id"), c("ids").alias("path"), F.explode("ids").alias("way_id"), c("main").alias("has_non_residential"))


def pt(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def city_entrances(ways: DataFrame, budget: float = 50.0, limit: int = 50, only_tagged: bool = True, apart: float = 6.0) -> DataFrame:
    """id, lon, lat of city-limit nodes without a limit of at most `limit` on their way or within budget metres."""
    from wayforge.sources.geojson import explode_nodes

    wn = explode_nodes(ways).where(tags.get(c("tags"), "traffic_sign") == "city_limit").select(c("node_id"), "way_id", "lon", "lat")
    e = way_edges(ways)
    own = wn.join(e, "way_id").where(~F.coalesce(c("junction").isin("roundabout", "circular"), F.lit(False)))
    own = own.where(~tags.own_limit_ok(c("maxspeed"), c("maxspeed_forward"), c("maxspeed_backward"), limit))
    xy = explode_nodes(ways).where("seq = 0 or seq = last").select("way_id", c("node_id").alias("end"), c("lon").alias("elon"), c("lat").alias("elat"))
    seeds = own.select("node_id", "way_id", "lon", "lat").join(xy, "way_id").select(c("node_id").alias("seed"), c("end").alias("node"), (F.lit(budget) - geo.geodesic(c("lon"), c("lat"), c("elon"), c("elat"))).alias("left"))
    cross = graph.both_directions(e.where(c("maxspeed").isNotNull()) if only_tagged else e)
    at = graph.reach(cross, seeds)
    tagged = e.select("way_id", "a", "b", "cost", "maxspeed", "maxspeed_forward", "maxspeed_backward")
    entered = tagged.select(c("a").alias("node"), F.lit(True).alias("first"), "maxspeed", "maxspeed_forward", "maxspeed_backward").unionByName(
        tagged.select(c("b").alias("node"), F.lit(False).alias("first"), "maxspeed", "maxspeed_forward", "maxspeed_backward"))
    low = entered.where(tags.effective_limit(c("maxspeed"), c("maxspeed_forward"), c("maxspeed_backward"), c("first")) <= limit).select("node").distinct()
    ok = at.join(low, "node").select(c("seed").alias("node_id")).distinct()
    bad = own.select("node_id", "lon", "lat").distinct().join(ok, "node_id", "left_anti").select(c("node_id").alias("id"), "lon", "lat")
    return spatial.thin(bad, apart)


def conflate(a: DataFrame, b: DataFrame, distance: float = 20.0, projection: float = 15.0) -> DataFrame:
    """i, j, kind, distance, status of roads matched between networks (id, oneway, junction, line in degrees).

    Roads against their direction (-1) are turned round; direct candidates by grid join and score, taken greedily one to
    one; roads left over by projected sample points; then direction labels.
    """
    def ready(d):
        state = tags.oneway_state(c("oneway"))
        line = F.when(state == "reverse", geo.reverse_line(c("line"))).otherwise(c("line"))
        d = d.select("id", (state != "bidirectional").alias("one"), "junction", geo.project_line(line).alias("line"))
        return d.withColumns(spatial.line_box(c("line")) | {"length": geo.planar_length(c("line"))})

    a, b = ready(a), ready(b)
    near = spatial.box_join(a, b, max(4 * distance, 100.0), distance).where(geo.line_distance(c("l_line"), c("r_line")) <= distance)
    ends = lambda k: (F.element_at(k, -1)["x"] - F.element_at(k, 1)["x"], F.element_at(k, -1)["y"] - F.element_at(k, 1)["y"])
    cosine = angles.direction_cosine(*ends("l_line"), *ends("r_line"))
    share = lambda u, v, r: F.size(F.filter(geo.sample_points(c(u)), lambda p: geo.point_line_distance(c(v), p["x"], p["y"]) <= r)) / F.size(geo.sample_points(c(u)))
    m = near.withColumns({
        "distance": geo.hausdorff(c("l_line"), c("r_line")), "ratio": matching.length_ratio(c("l_length"), c("r_length")),
        "overlap": share("l_line", "r_line", distance / 2), "similarity": F.abs(F.coalesce(cosine, F.lit(0.0))), "cosine": cosine,
    })
    m = m.where(matching.good_match(c("ratio"), c("overlap"), c("similarity"))).withColumn("score", matching.match_score(c("distance"), c("ratio"), c("overlap"), c("similarity")))
    cols = ["i", "j", "distance", "cosine", "one_a", "one_b", "junction"]
    shape = lambda d: d.select(c("l_id").alias("i"), c("r_id").alias("j"), *[k for k in ("score", "distance") if k in d.columns], "cosine", c("l_one").alias("one_a"), c("r_one").alias("one_b"), c("l_junction").alias("junction"))
    direct = matching.greedy(shape(m)).drop("score")
    rest = a.join(direct.select(c("i").alias("id")), "id", "left_anti")
    p = spatial.box_join(rest, b, max(4 * projection, 100.0), projection)
    d = F.transform(geo.sample_points(c("l_line")), lambda q: geo.point_line_distance(c("r_line"), q["x"], q["y"]))
    p = p.withColumn("d", d).withColumns({"distance": F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d"), "coverage": F.size(F.filter("d", lambda x: x <= projection)) / F.size("d"), "cosine": cosine})
    p = shape(p.where((F.abs(c("cosine")) >= 0.7) & (c("coverage") >= 0.6) & (c("distance") <= projection)))
    both = direct.select(F.lit("direct").alias("kind"), *cols).unionByName(matching.best_per_i(p, ["distance", "j"]).select(F.lit("projection").alias("kind"), *cols))
    label = angles.direction_label(c("one_a"), c("one_b"), c("cosine"))
    return both.withColumn("status", F.when(F.coalesce(c("junction").isin("roundabout", "circular"), F.lit(False)), F.lit(None)).otherwise(label)).select("i", "j", "kind", "distance", "status")


def difference_lines(matched: DataFrame, a: DataFrame) -> DataFrame:
    """i, status, colour, line: each difference as a line 6 m to the right, and lost one-ways also red, reversed, to the left."""
    line = geo.project_line(c("line"))
    g = matched.where("status is not null and status <> 'bidirectional_both'").join(a.select(c("id").alias("i"), line.alias("line")), "i")
    turned = F.when(c("status") == "same_direction", c("line")).otherwise(geo.reverse_line(c("line")))
    pink = g.select("i", "status", F.lit("pink").alias("colour"), geo.unproject_line(geo.offset_line(turned, -6.0)).alias("line"))
    red = g.where(c("status").startswith("oneway_to_bidirectional")).select("i", "status", F.lit("red").alias("colour"), geo.unproject_line(geo.offset_line(geo.reverse_line(c("line")), 6.0)).alias("line"))
    return pink.unionByName(red)


def filter_detected(detected: DataFrame, roads: DataFrame, farms: DataFrame, half_width: float = 7e-5, near: float = 4.5e-5, shortest: float = 15.0) -> DataFrame:
    """id, group, line of detected roads worth adding: near the main network at an end, outside farmland, long enough, not known.

    detected: id, line; roads: tags_text, line; farms: ring. Groups are components of lines that touch.
    """
    main = roads.where(~c("tags_text").rlike(tags.MINOR_OR_LOCAL)).select("line")
    ends = detected.select("id", F.explode(F.array(F.element_at("line", 1), F.element_at("line", -1))).alias("p")).select("id", c("p.x").alias("x"), c("p.y").alias("y"))
    touch = spatial.points_to_lines(ends, main, near + half_width, cell=1e-3).select(c("l_id").alias("id")).distinct()
    kept = detected.join(touch, "id", "left_semi")
    boxed = kept.withColumns(spatial.line_box(c("line")))
    fields = farms.where(spatial.ring_is_valid(c("ring"))).withColumns(spatial.line_box(c("ring")))
    inside = spatial.box_join(boxed, fields, 0.01).where(F.forall("l_line", lambda p: spatial.point_in_ring(c("r_ring"), p["x"], p["y"]))).select(c("l_id").alias("id")).distinct()
    kept = kept.join(inside, "id", "left_anti").where(geo.geodesic_length(c("line")) >= shortest)
    cover = spatial.covered_share(kept, roads.where(~c("tags_text").rlike(tags.MINOR)).select("line"), half_width)
    new = cover.where(c("covered") / c("length") < F.least(F.lit(0.85), c("length") / 40 * 0.85)).select("id")
    kept = kept.join(new, "id", "left_semi")
    b = kept.withColumns(spatial.line_box(c("line")))
    pairs = spatial.box_join(b, b, 1e-3).where("l_id < r_id").where(geo.line_distance(c("l_line"), c("r_line")) <= 1e-9).select(c("l_id").alias("a"), c("r_id").alias("b"))
    group = graph.components(pairs)
    return kept.join(group.select(c("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("group"), "line")


def non_osm_segments(segments: DataFrame) -> DataFrame:
    """Road segments whose first source is not OpenStreetMap. segments: sources, subtype, class."""
    first = F.lower(F.try_element_at("sources", F.lit(1))["dataset"])
    return segments.where((c("subtype") == "road") & c("class").isin(*tags.ROAD_CLASSES_LIVING) & ~first.isin("openstreetmap", "osm"))


def turn_lanes(ways: DataFrame, signs: DataFrame, reach: float = 30.0) -> DataFrame:
    """sign_id, way_id, half, angle_diff, distance: each sign's road, and which half of it, split at the sign, it faces.

    ways: id, tags_text, line (degrees); signs: id, lon, lat, angle.
    """
    roads = ways.select(c("id"), tags.parse_map_text(c("tags_text")).alias("tags"), geo.project_line(c("line")).alias("line"))
    pts = signs.select("id", c("angle").cast("double").alias("angle"), geo.merc_x(c("lon")).alias("x"), geo.merc_y(c("lat")).alias("y"))
    got = spatial.points_to_lines(pts, roads, reach, cell=2 * reach)
    cut = geo.split_line(c("r_line"), c("near.seg"), c("near.t"))
    halves = F.array(F.struct(F.lit("a").alias("half"), cut["a"].alias("g")), F.struct(F.lit("b").alias("half"), cut["b"].alias("g")))
    each = got.select(c("l_id").alias("sign_id"), "l_angle", c("r_id").alias("way_id"), tags.get(c("r_tags"), "oneway").alias("oneway"), c("near.d").alias("distance"), F.explode(halves).alias("h"))
    p, q = F.element_at("h.g", 1), F.element_at("h.g", -1)
    each = each.where(geo.planar_length(c("h.g")) > 0).withColumn("angle_diff", angles.line_angle_diff(c("l_angle"), angles.rotation_angle(p["x"], p["y"], q["x"], q["y"]), c("oneway")))
    return spatial.best_per(each, ["sign_id"], [c("angle_diff"), c("distance"), c("way_id"), c("h.half")]).select("sign_id", "way_id", c("h.half").alias("half"), "angle_diff", "distance")


def _tile_lines(tiles: DataFrame, kernel: str, **kw) -> DataFrame:
    """image, z, x, y, line_idx, x1, y1, x2, y2 from tiles (read_tiles); images are independent rows."""
    import pandas as pd

    def run(batches):
        import numpy as np

        from wayforge.functions import raster

        for p in batches:
            rows = []
            for t in p.itertuples(index=False):
                if t.width <= 0 or t.nChannels < 3:
                    continue
                img = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.nChannels)[..., :3]
                rows += [(t.origin, t.z, t.x, t.y, k, *s) for k, s in enumerate(getattr(raster, kernel)(img, **kw))]
            yield pd.DataFrame(rows, columns=["image", "z", "x", "y", "line_idx", "x1", "y1", "x2", "y2"])

    return tiles.mapInPandas(run, "image string, z int, x int, y int, line_idx int, x1 int, y1 int, x2 int, y2 int")


def straight_edges(tiles: DataFrame, **kw) -> DataFrame:
    """Segments of straight edges with lon/lat of both ends."""
    g = _tile_lines(tiles, "straight_edges", **kw)
    box = geo.tile_bbox(c("z"), c("x"), c("y"))
    return g.withColumns({"p": geo.pixel_to_lonlat(c("x1"), c("y1"), box), "q": geo.pixel_to_lonlat(c("x2"), c("y2"), box)})


def double_lines(tiles: DataFrame, lo: float = 8.0, hi: float = 25.0, parallel: float = 12.0, overlap: float = 0.6, min_length: float = 20.0) -> DataFrame:
    """image, i, j, score of pairs of parallel marking lines, each line used once."""
    lines = _tile_lines(tiles, "marking_lines", min_length=min_length)
    p = pixels.parallel_pairs(lines, lo, hi, parallel, overlap).where(f"shorter >= {min_length} and length_ratio > 0.6")
    return matching.greedy(p, one_sided=False, group=["image"])


def image_report(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """image, ok, pairs: readable or not, and how many pairs each image has."""
    n = pairs.groupBy("image").agg(F.count(F.lit(1)).alias("pairs"))
    return tiles.select(c("origin").alias("image"), (c("width") > 0).alias("ok")).join(n, "image", "left").select("image", "ok", F.coalesce("pairs", F.lit(0)).alias("pairs"))
