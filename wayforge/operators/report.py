"""Numbering, counters and output rows of the pipelines, and small scoring helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.functions import geo, tags
from wayforge.operators import spatial
from wayforge.operators.rounds import Rounds

c = F.col


def numbered(matches: DataFrame, order: list[str], prefix: str = "match_") -> DataFrame:
    """Adds match_id, prefix and a running number of three digits or more. The numbers are offsets of range
    partitions plus places within them, so no task sees all rows."""
    rounds = Rounds(matches.sparkSession, "numbered")
    # Written once: ranges are cut by sampling, so a second evaluation might cut them elsewhere.
    ranged = rounds.keep(matches.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    at = ranged.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = rounds.again(ranged).groupBy("__p").count().withColumn("__base", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    n = (c("__base") + c("__k")).cast("string")
    return at.join(sizes, "__p").withColumn("match_id", F.concat(F.lit(prefix), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))).drop("__p", "__k", "__base")


def conflation_counts(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: roads of both networks, matches by kind, differences and the match rate (0 without roads)."""
    m = matches.agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(c("kind") == "direct").alias("direct"), F.count_if(c("kind") == "projection").alias("projected"),
        F.count_if(c("status").isNotNull() & (c("status") != "bidirectional_both")).alias("differences"),
    )
    n = a.select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.lit(0).alias("x"), F.lit(1).alias("y"))).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("roads_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("roads_b"))
    return n.join(m, F.lit(True)).withColumn("match_rate", F.coalesce(F.try_divide(c("matches"), c("roads_a")), F.lit(0.0)))


def loop_counts(found: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row: loops, those of residential roads only, and triangles. found: path, main."""
    t = triangles.agg(F.countDistinct("triangle_id").alias("triangles"))
    return found.agg(F.count(F.lit(1)).alias("loops"), F.count_if(~c("main")).alias("residential_only")).join(t, F.lit(True))


def segment_rows(segments: DataFrame) -> DataFrame:
    """Properties of split roads: segment and parent ids, flags, node weights, length and the one-way state.

    segments: segment_id, original_ids, is_merged, is_split, start_weight, end_weight, oneway, line (metres).
    """
    ids = tags.combined_id(c("original_ids"), c("is_merged"))
    return segments.select(
        "segment_id", ids.alias("parent_id"), F.when(c("is_merged"), ids).alias("merged_id"), F.when(c("is_split"), ids).alias("split_id"), F.when(~c("is_merged") & ~c("is_split"), ids).alias("original_id"),
        "is_merged", "is_split", F.when(c("is_merged"), F.size("original_ids")).otherwise(1).alias("merged_count"), "start_weight", "end_weight",
        ((c("start_weight") >= 3) | (c("end_weight") >= 3)).alias("at_true_intersection"), F.round(geo.planar_length(c("line")), 2).alias("length_meters"), tags.oneway_state(c("oneway")).alias("direction"),
    )


def image_text(report: DataFrame) -> DataFrame:
    """One row of text: images, readable images, pairs and the mean of pairs over images that have any."""
    g = report.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("ok")).alias("ok"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.round(F.avg(F.when(c("pairs") > 0, c("pairs"))), 2), F.lit(0.0)).alias("mean"))
    return g.select(F.concat_ws("\n", *(F.concat(F.lit(f"{t}: "), c(k).cast("string")) for t, k in (("images", "n"), ("readable", "ok"), ("pairs", "pairs"), ("mean pairs per image with pairs", "mean")))).alias("value"))


def maneuvers(edges: DataFrame) -> DataFrame:
    """node_id, ways: one-way roads that leave each node. edges: way_id, a, oneway."""
    return edges.where(tags.oneway_state(c("oneway")) != "bidirectional").groupBy(c("a").alias("node_id")).agg(F.array_sort(F.collect_set("way_id")).alias("ways"))


def is_straight(line: Column, share: float = 0.2) -> Column:
    """Length and chord differ by less than a share of the length."""
    p, q, n = F.element_at(line, 1), F.element_at(line, -1), geo.planar_length(line)
    return F.abs(n - F.sqrt(F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0)))) < share * n


def candidate_score(angle: Column, distance: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Angle over distance plus distance; small angles count by their root, angles over 30 degrees weigh more. Null at distance 0."""
    term = F.when(angle < 15, F.sqrt(angle)).otherwise(angle)
    power = F.when(angle > 30, angle / 30.0).otherwise(1.0)
    return F.try_divide(term, F.pow(F.lit(alpha), power) * distance) + beta * distance


def first_within(pairs: DataFrame, by: str, most: float = 30.0) -> DataFrame:
    """Nearest candidate of each row whose angle differs by at most `most`. pairs: by, angle_diff, distance, road_id."""
    return spatial.best_per(pairs.where(c("angle_diff") <= most), [by], [c("distance"), c("road_id")])


def zone_boxes(quadkeys: DataFrame) -> DataFrame:
    """quadkey, minx, miny, maxx, maxy (degrees): the boxes whose union is the download zone."""
    bit = lambda d: F.aggregate(F.split("quadkey", ""), F.lit(0).cast("long"), lambda s, q: s * 2 + F.floor(q.cast("long") / d) % 2)
    z, x, y = F.length("quadkey"), bit(1), bit(2)
    return quadkeys.select("quadkey", geo.tile_lon(x, z).alias("minx"), geo.tile_lat(y + 1, z).alias("miny"), geo.tile_lon(x + 1, z).alias("maxx"), geo.tile_lat(y, z).alias("maxy"))


def enriched_ways(spark: SparkSession, table: str, country: str, dt: str, quadkeys: list[str]) -> DataFrame:
    """Ways of a country, day and quadkeys from a registered table with map and array columns."""
    return spark.sql(
        f"""select id, tags, geometry_wkt from {table}
        where element_at(metadata_str, 'iso:3166_1') = :country and dt = :dt and size(filter(element_at(metadata_array, 'quadkeys'), x -> array_contains(:quadkeys, x))) > 0
        and element_at(tags, 'highway') in ({', '.join(repr(r) for r in tags.ROAD_CLASSES)})""",
        args={"country": country, "dt": dt, "quadkeys": F.array(*(F.lit(q) for q in quadkeys))},
    )


def sign_detections(spark: SparkSession, table: str, country: str, dt: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Good arrow detections in an open box, arrow types renamed."""
    case = " ".join(f"when '{k}' then '{v}'" for k, v in tags.ARROWS.items())
    return spark.sql(
        f"""select id, lat, lon, angle, 'turn_lanes' as feature_type, case detection_type {case} else detection_type end as arrow_type, country as country_code from {table}
        where dt = :dt and country = :country and lon > :x0 and lon < :x1 and lat > :y0 and lat < :y1 and cluster_size > 10 and confidence > 0.1 and status <> 'Deleted' and message_type = 'arrow'""",
        args={"dt": dt, "country": country, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3]},
    )
