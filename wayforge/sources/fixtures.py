"""Road networks, signs and pixel lines derived by arithmetic from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lon, lat, p_size: parts on a grid 50 columns wide."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as node_id", "-1.25D + (p_partkey % 50) * 4e-4 as lon", "37.72D + floor(p_partkey / 50) * 32e-5 as lat", "p_size"
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, a, b, p_size: east, north and every seventh diagonal edge of the grid."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    top = part.agg(F.max("p_partkey")).first()[0]
    k = F.col("p_partkey")
    east = part.where((k % 50 < 49) & (k + 1 <= top)).select((4 * k).alias("way_id"), k.alias("a"), (k + 1).alias("b"), "p_size")
    north = part.where(k + 50 <= top).select((4 * k + 1).alias("way_id"), k.alias("a"), (k + 50).alias("b"), "p_size")
    slant = part.where((k % 7 == 0) & (k % 50 < 49) & (k + 51 <= top)).select((4 * k + 2).alias("way_id"), k.alias("a"), (k + 51).alias("b"), "p_size")
    return east.unionByName(north).unionByName(slant)


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, a, b, highway, oneway, junction, maxspeed; tags may be null."""
    return edges(spark, sf_dir).selectExpr(
        "way_id", "a", "b",
        "case way_id % 11 when 0 then 'primary' when 1 then 'secondary' when 2 then 'tertiary' when 3 then 'unclassified' when 4 then 'service' when 5 then 'track' else 'residential' end as highway",
        "case p_size % 10 when 0 then 'yes' when 1 then '-1' when 2 then 'no' end as oneway",
        "case when p_size % 17 = 0 then 'roundabout' end as junction",
        "case p_size % 6 when 0 then '30' when 1 then '50' when 2 then '90' when 3 then '110' when 4 then 'signals' end as maxspeed",
    )


def way_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ways with the coordinates of both ends: lon1, lat1, lon2, lat2, and line (array of x, y, with the middle vertex)."""
    n = nodes(spark, sf_dir)
    m = nodes(spark, sf_dir)
    out = ways(spark, sf_dir).join(n.select(F.col("node_id").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), "a").join(
        m.select(F.col("node_id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "b")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    return out.withColumn("line", F.array(p(c("lon1"), c("lat1")), p((c("lon1") + c("lon2")) / 2, (c("lat1") + c("lat2")) / 2), p(c("lon2"), c("lat2"))))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, seq 0..2, last, node_id, lon, lat; the middle node belongs to the way alone."""
    w = way_lines(spark, sf_dir)
    ids = F.array("a", F.col("way_id") + 1_000_000, "b")
    at = w.select("way_id", F.posexplode("line").alias("seq", "p"), ids.alias("ids"))
    return at.select("way_id", "seq", F.lit(2).alias("last"), F.element_at("ids", F.col("seq") + 1).alias("node_id"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, lon, lat, angle, detection_type."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "-1.25D + (event_id * 13 % 49000) * 4e-7 as lon", "37.72D + (event_id * 29 % 12000) * 1e-6 as lat", "(event_id * 137) % 360 as angle",
        "case event_type when 'click' then 'straight' when 'view' then 'u_turn_left' when 'purchase' then 'straight_right' when 'signup' then 'left' else 'u_turn_right' end as detection_type",
    )


def pixel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, line_idx, x1, y1, x2, y2 in a tile of 256 pixels."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as image", "event_id as line_idx", "event_id * 37 % 200 as x1", "event_id * 53 % 200 as y1", "event_id * 37 % 200 + 20 + event_id % 36 as x2", "event_id * 53 % 200 + event_id % 56 as y2"
    )


def roads_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second network: every 11th way is gone, latitude + 5e-5, and one-way values change where way_id % 13 = 0."""
    return way_lines(spark, sf_dir).where("way_id % 11 <> 10").selectExpr(
        "concat('b_', way_id) as way_id", "a", "b", "lon1", "lat1 + 5e-5 as lat1", "lon2", "lat2 + 5e-5 as lat2", "highway",
        "case when way_id % 13 = 0 then case when oneway = 'yes' then '-1' when oneway is null then 'yes' else oneway end else oneway end as oneway",
    )


# The same views as common table expressions, for oracle queries.
VIEWS = """
fx_nodes as (select p_partkey as node_id, -1.25e0 + (p_partkey % 50)*4e-4 as lon, 37.72e0 + floor(p_partkey/50)*32e-5 as lat, p_size from part),
fx_edges as (
 select 4*p_partkey as way_id, p_partkey as a, p_partkey+1 as b, p_size from part where p_partkey % 50 < 49 and p_partkey+1 <= (select max(p_partkey) from part)
 union all select 4*p_partkey+1, p_partkey, p_partkey+50, p_size from part where p_partkey+50 <= (select max(p_partkey) from part)
 union all select 4*p_partkey+2, p_partkey, p_partkey+51, p_size from part where p_partkey % 7 = 0 and p_partkey % 50 < 49 and p_partkey+51 <= (select max(p_partkey) from part)),
fx_ways as (select way_id, a, b,
 case way_id % 11 when 0 then 'primary' when 1 then 'secondary' when 2 then 'tertiary' when 3 then 'unclassified' when 4 then 'service' when 5 then 'track' else 'residential' end as highway,
 case when p_size % 10 = 0 then 'yes' when p_size % 10 = 1 then '-1' when p_size % 10 = 2 then 'no' end as oneway,
 case when p_size % 17 = 0 then 'roundabout' end as junction,
 case when p_size % 6 = 0 then '30' when p_size % 6 = 1 then '50' when p_size % 6 = 2 then '90' when p_size % 6 = 3 then '110' when p_size % 6 = 4 then 'signals' end as maxspeed
 from fx_edges),
fx_way_lines as (select w.*, n.lon as lon1, n.lat as lat1, m.lon as lon2, m.lat as lat2 from fx_ways w join fx_nodes n on n.node_id=a join fx_nodes m on m.node_id=b),
fx_way_nodes as (
 select way_id, 0 as seq, a as node_id, lon1 as lon, lat1 as lat from fx_way_lines
 union all select way_id, 1, 1000000+way_id, (lon1+lon2)/2e0, (lat1+lat2)/2e0 from fx_way_lines
 union all select way_id, 2, b, lon2, lat2 from fx_way_lines),
fx_signs as (select event_id, user_id, -1.25e0 + (event_id*13 % 49000)*4e-7 as lon, 37.72e0 + (event_id*29 % 12000)*1e-6 as lat, (event_id*137) % 360 as angle,
 case event_type when 'click' then 'straight' when 'view' then 'u_turn_left' when 'purchase' then 'straight_right' when 'signup' then 'left' else 'u_turn_right' end as detection_type from events),
fx_lines as (select user_id as image, event_id as line_idx, event_id*37 % 200 as x1, event_id*53 % 200 as y1, event_id*37 % 200 + 20 + event_id % 36 as x2, event_id*53 % 200 + event_id % 56 as y2 from events),
fx_roads_b as (select concat('b_', cast(way_id as varchar)) as way_id, a, b, lon1, lat1 + 5e-5 as lat1, lon2, lat2 + 5e-5 as lat2, highway,
 case when way_id % 13 = 0 then case when oneway = 'yes' then '-1' when oneway is null then 'yes' else oneway end else oneway end as oneway from fx_way_lines where way_id % 11 <> 10)
"""
