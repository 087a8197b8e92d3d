"""Tag maps: parsing, projection, one-way values and road-class predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes of the two whitelists.
ROAD_CLASSES = (
    "motorway", "trunk", "motorway_link", "trunk_link", "primary", "primary_link", "secondary",
    "secondary_link", "tertiary", "unclassified", "residential", "tertiary_link", "service",
)
ROAD_CLASSES_LIVING = (*ROAD_CLASSES, "living_street")
# Spellings of one-way states.
BOTH_WAYS, FORWARD, REVERSE = ("no", "false", "0", "bidirectional", "two-way"), ("yes", "true", "1", "forward"), ("-1", "reverse", "backward")
# Substring patterns of excluded tags.
MINOR, MINOR_OR_LOCAL = "waterway|rail|highway=service|highway=track", "waterway|rail|highway=service|highway=track|highway=unclassified|highway=residential"
# Arrow types and their lane names.
ARROWS = {
    "u_turn_left": "reverse_left", "u_turn_right": "right_reverse", "straight": "through",
    "straight_right": "through_right", "straight_left_right": "left_through_right", "straight_left": "left_through",
}


def parse_map_text(text: Column) -> Column:
    """`{k=v, k2=v2}` to a map: pieces that are not one key and one non-empty value are skipped, a
    deleted value reads 0, of a repeated key the last counts, and oneway defaults to no."""
    parts = F.transform(F.split(F.regexp_replace(text, r"^\{+|\}+$", ""), ", "), lambda s: F.split(s, "="))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & (F.element_at(p, 2) != ""))
    entries = F.transform(good, lambda p: F.struct(F.element_at(p, 1).alias("key"), F.when(F.element_at(p, 2) == "[DELETED]", "0").otherwise(F.element_at(p, 2)).alias("value")))
    # Bound as a lambda's argument, or the entries would be worked out anew for each of them.
    last = F.element_at(F.transform(F.array(entries), lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))), 1)
    m = F.map_from_entries(last)
    return F.when(F.map_contains_key(m, "oneway"), m).otherwise(F.map_concat(m, F.create_map(F.lit("oneway"), F.lit("no"))))


def get(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def keep_keys(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(*keys))


def prefix_keys(tags: Column, prefix: str = "string:") -> Column:
    return F.transform_keys(tags, lambda k, _: F.concat(F.lit(prefix), k))


def drop_null_values(tags: Column) -> Column:
    return F.map_filter(tags, lambda _, v: v.isNotNull())


def output_keys(tags: Column, basic: tuple[str, ...], prolongation: tuple[str, ...]) -> Column:
    """Properties to write: basic and prolongation keys, and lane or turn keys that are no correction, source or parking."""
    return F.map_filter(tags, lambda k, v: v.isNotNull() & (
        k.isin(*basic, *prolongation) | ((k.contains("lanes") | k.contains("turn")) & ~k.contains("correction") & ~k.contains("source") & ~k.contains("parking"))
    ))


def oneway_state(value: Column) -> Column:
    """bidirectional, forward or reverse; unknown and missing values are bidirectional."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*FORWARD), "forward").when(v.isin(*REVERSE), "reverse").otherwise("bidirectional")


def loop_start(junction: Column, oneway: Column) -> Column:
    return ~(F.coalesce(junction.isin("roundabout", "circular"), F.lit(False)) | F.coalesce(oneway.isin("yes", "-1", "1"), F.lit(False)))


def traversable(junction: Column, oneway: Column) -> Column:
    return junction.isNull() & ~F.coalesce(oneway.isin("yes", "-1", "1"), F.lit(False))


def effective_limit(maxspeed: Column, forward: Column, backward: Column, at_first: Column) -> Column:
    """Speed limit met on entering a way: maxspeed if a number; else, if the tag is there, that of the direction; else none."""
    side = F.when(at_first, forward).otherwise(backward)
    return F.when(maxspeed.isNotNull(), F.coalesce(int_of(maxspeed), int_of(side)))


def own_limit_ok(maxspeed: Column, forward: Column, backward: Column, most: int = 50) -> Column:
    n = int_of(maxspeed)
    either = (int_of(forward) <= most) | (int_of(backward) <= most)
    return F.coalesce(F.when(maxspeed.isNotNull(), n <= most).otherwise(either), F.lit(False))


def int_of(text: Column) -> Column:
    return text.try_cast("int")


def name_of(tags: Column) -> Column:
    return F.coalesce(get(tags, "name"), get(tags, "NAME"), get(tags, "road_name"), F.lit("Unknown"))


def combined_id(ids: Column, merged: Column) -> Column:
    return F.when(merged & (F.size(ids) > 1), F.array_join(ids, "_")).otherwise(F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit("unknown")))


def arrow_name(kind: Column) -> Column:
    out = F.when(F.lit(False), kind)
    for k, v in ARROWS.items():
        out = out.when(kind == k, v)
    return out.otherwise(kind)


def tile_name(file: Column) -> Column:
    """STRUCT<z, x, y> from `prefix_z_x_y.png`; null parts if the name has another shape."""
    stem = F.split(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", ""), "_")
    ok = F.size(stem) == 4
    return F.struct(*(F.when(ok, int_of(F.try_element_at(stem, F.lit(i)))).alias(n) for i, n in ((2, "z"), (3, "x"), (4, "y"))))


def quadkey_children(quadkey: Column, level: int) -> Column:
    """All descendants of a quadkey at a level (itself if it is that long)."""
    more = F.lit(level) - F.length(quadkey)
    n = F.pow(F.lit(4.0), more).cast("long")
    digits = lambda i: F.lpad(F.conv(i.cast("string"), 10, 4), level, "0")
    return F.when(more <= 0, F.array(quadkey)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(quadkey, F.substring(digits(i), F.length(quadkey) + 1, more))))
