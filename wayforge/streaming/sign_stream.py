"""Sign directions over a stream of ways: each way is read alone, so the batch expressions apply to a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayforge.functions import angles, tags

c = F.col


def sign_directions(ways: DataFrame) -> DataFrame:
    """way_id, node_id, alt_dir from ways (way_id, tags, nodes); neighbours are taken by place in the array, without a window."""
    n, at = F.size("nodes"), F.posexplode("nodes")
    each = ways.where(tags.get(c("tags"), "highway").isin(*tags.ROAD_CLASSES)).select("way_id", "nodes", n.alias("n"), at.alias("k", "node"))
    xy = lambda node, i: F.element_at(node["geometry"]["coordinates"], i)
    near = lambda k: F.try_element_at(c("nodes"), k)
    prev, nxt = F.when(c("k") > 0, near(F.greatest(c("k"), F.lit(1)))), F.when(c("k") < c("n") - 1, near(c("k") + 2))
    rot = lambda p, q: angles.rotation_angle(xy(p, 1), xy(p, 2), xy(q, 1), xy(q, 2))
    here, direction = c("node"), tags.int_of(tags.get(c("node.properties"), "direction")).cast("double")
    to_next, to_prev = F.coalesce(rot(here, nxt), rot(prev, here)), F.coalesce(rot(here, prev), rot(nxt, here))
    sign = each.where(tags.get(c("node.properties"), "highway").isin("stop", "give_way", "traffic_signals") & direction.isNotNull() & (c("n") > 1))
    return sign.select("way_id", c("node.id").alias("node_id"), angles.forward_or_backward(direction, to_next, to_prev).alias("alt_dir"))
