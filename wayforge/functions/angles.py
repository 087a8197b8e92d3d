"""Angle and direction expressions (degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar azimuth from point 1 to point 2 in [0, 360): 0 is +y, 90 is +x."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360.0, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Unsigned difference of two azimuths, in [0, 180]."""
    return F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def line_angle_diff(a: Column, b: Column, oneway: Column) -> Column:
    """Difference of a heading and a road: roads of both directions are folded modulo 180."""
    folded = F.pmod(b - a, F.lit(180.0))
    return F.when(oneway == "no", F.least(folded, 180.0 - folded)).otherwise(angle_diff(a, b))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    dl, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def forward_or_backward(direction: Column, to_next: Column, to_prev: Column) -> Column:
    """A sign's azimuth against the bearings to its neighbours on the way; ties are backward."""
    return F.when(angle_diff(direction, to_next) > angle_diff(direction, to_prev), "forward").otherwise("backward")


def direction_cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(n > 0, (ax * bx + ay * by) / n)


def vertex_angle(ax: Column, ay: Column, px: Column, py: Column, bx: Column, by: Column) -> Column:
    """Angle at p between a and b, in [0, 180]; 0 if a side has no length."""
    c = direction_cosine(ax - px, ay - py, bx - px, by - py)
    return F.when(c.isNotNull(), F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))).otherwise(0.0)


def direction_label(one_a: Column, one_b: Column, cosine: Column) -> Column:
    """How two matched roads differ in direction; one_a and one_b say which are one-way. Cut-offs are 0.7."""
    same, opposite = cosine > 0.7, cosine < -0.7

    def kind(prefix: str, sep: str) -> Column:
        return F.when(same, f"{prefix}{sep}same").when(opposite, f"{prefix}{sep}opposite").otherwise(f"{prefix}{sep}mixed")

    both = F.when(cosine.isNull(), "unknown_direction").when(same, "same_direction").when(opposite, "opposite_direction").otherwise("mixed_direction")
    a_only = F.when(cosine.isNull(), "oneway_to_bidirectional").otherwise(kind("oneway_to_bidirectional", "_"))
    b_only = F.when(cosine.isNull(), "bidirectional_to_oneway").otherwise(kind("bidirectional_to_oneway", "_"))
    return F.when(~one_a & ~one_b, "bidirectional_both").when(one_a & ~one_b, a_only).when(~one_a & one_b, b_only).otherwise(both)
