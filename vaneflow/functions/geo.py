"""Geometry of flight: norms, attitudes, frames and map projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp

EARTH_M = 6_371_000.0


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def quaternion_euler(w: Column, x: Column, y: Column, z: Column) -> Column:
    """struct(roll, pitch, yaw) in degrees of the normalised quaternion; null where it has no length."""
    n = norm(w, x, y, z)
    w, x, y, z = (F.when(n > 1e-12, q / n) for q in (w, x, y, z))
    roll = F.degrees(F.atan2((w * x + y * z) * 2, F.lit(1.0) - (x * x + y * y) * 2))
    pitch = F.degrees(F.asin(clamp((w * y - z * x) * 2, -1.0, 1.0)))
    yaw = F.degrees(F.atan2((w * z + x * y) * 2, F.lit(1.0) - (y * y + z * z) * 2))
    return F.struct(roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"))


def ned_to_body(north: Column, east: Column, down: Column, roll: Column, pitch: Column, yaw: Column) -> Column:
    """struct(forward, right, down): a vector of the local frame in the body's, angles in radians (yaw, pitch, roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    forward = north * cp * cy + east * cp * sy - down * sp
    right = north * (sr * sp * cy - cr * sy) + east * (sr * sp * sy + cr * cy) + down * sr * cp
    below = north * (cr * sp * cy + sr * sy) + east * (cr * sp * sy - sr * cy) + down * cr * cp
    return F.struct(forward.alias("forward"), right.alias("right"), below.alias("down"))


def heading_frame(north: Column, east: Column, yaw: Column) -> Column:
    """struct(forward, right) in the plane."""
    return F.struct((north * F.cos(yaw) + east * F.sin(yaw)).alias("forward"), (east * F.cos(yaw) - north * F.sin(yaw)).alias("right"))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """struct(x, y): metres north and east of the anchor (degrees), azimuthal equidistant."""
    a, b, c = F.radians(lat), F.radians(lat0), F.radians(lon) - F.radians(lon0)
    arc = F.acos(clamp(F.sin(b) * F.sin(a) + F.cos(b) * F.cos(a) * F.cos(c), -1.0, 1.0))
    k = F.when(F.abs(arc) < 1e-12, F.lit(1.0)).otherwise(F.try_divide(arc, F.sin(arc)))
    return F.struct((k * (F.cos(b) * F.sin(a) - F.sin(b) * F.cos(a) * F.cos(c)) * EARTH_M).alias("x"), (k * F.cos(a) * F.sin(c) * EARTH_M).alias("y"))


def gps_degrees(version: Column, lat: Column, lon: Column, alt: Column) -> Column:
    """struct(lat, lon, alt): newer logs hold degrees and metres, older ones 1e-7 degrees and millimetres."""
    new = version >= 2
    return F.struct(F.when(new, lat).otherwise(lat * 1e-7).alias("lat"), F.when(new, lon).otherwise(lon * 1e-7).alias("lon"), F.when(new, alt).otherwise(alt * 1e-3).alias("alt"))


def valid_fix(fix_type: Column, lat: Column, lon: Column, alt: Column) -> Column:
    return (fix_type > 2) & F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180) & ~F.isnan(alt)


def flow_angles(forward: Column, right: Column, down: Column) -> Column:
    """struct(attack, sideslip, speed): angles in degrees of a velocity in the body's frame."""
    speed = norm(forward, right, down)
    slip = F.degrees(F.asin(clamp(F.try_divide(right, speed), -1.0, 1.0)))
    return F.struct(F.degrees(F.atan2(down, forward)).alias("attack"), F.coalesce(slip, F.lit(0.0)).alias("sideslip"), speed.alias("speed"))
