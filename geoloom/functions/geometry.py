"""Geometry as Catalyst expressions: projections, tiles, boxes, rings, pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.051129
EARTH = 6_378_137.0
HAVERSINE_RADIUS = 6_371_000.0
MAX_ZOOM = 22


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_lat(lat: Column) -> Column:
    return clamp(lat, -MAX_LAT, MAX_LAT)


def valid_position(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamp_lat(lat)) / 2)) * EARTH


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / EARTH)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def side(zoom) -> Column:
    """Tiles along an axis; zooms beyond 22 count as 22."""
    return F.pow(F.lit(2.0), F.least(_as_column(zoom), F.lit(MAX_ZOOM)))


def world_x(lon: Column) -> Column:
    """0 at the west edge, 1 at the east edge."""
    return (lon + 180) / 360


def world_y(lat: Column) -> Column:
    """0 at the north edge, 1 at the south edge of the square map."""
    p = F.radians(clamp_lat(lat))
    return (1 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2


def _cell(fraction: Column, zoom) -> Column:
    n = side(zoom)
    cell = F.floor(fraction * n)
    return F.when(fraction.isNull() | F.isnan(fraction), 0).otherwise(F.greatest(F.lit(0), F.least(cell, n.cast("long") - 1))).cast("int")


def tile_x(lon: Column, zoom) -> Column:
    """Column of the tile; positions off the map go to the edge, NaN to 0."""
    return _cell(world_x(lon), zoom)


def tile_y(lat: Column, zoom) -> Column:
    return _cell(world_y(lat), zoom)


def tile_west(x: Column, zoom) -> Column:
    return x / side(zoom) * 360 - 180


def tile_north(y: Column, zoom) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / side(zoom)))))


def tile_box(x: Column, y: Column, zoom) -> dict[str, Column]:
    return {"min_lon": tile_west(x, zoom), "min_lat": tile_north(y + 1, zoom), "max_lon": tile_west(x + 1, zoom), "max_lat": tile_north(y, zoom)}


def tile_parent(x: Column, y: Column, zoom: Column) -> tuple[Column, Column, Column]:
    """The tile above; null at zoom 0."""
    up = zoom > 0
    return F.when(up, F.shiftright(x, 1)), F.when(up, F.shiftright(y, 1)), F.when(up, zoom - 1)


def tile_children(x: Column, y: Column, zoom: Column) -> Column:
    """The four tiles below, in reading order; an error at the deepest zoom."""
    kid = lambda dx, dy: F.struct((x * 2 + dx).cast("int").alias("x"), (y * 2 + dy).cast("int").alias("y"), (zoom + 1).cast("int").alias("z"))
    kids = F.array(kid(0, 0), kid(1, 0), kid(0, 1), kid(1, 1))
    return F.when(F.when(zoom >= MAX_ZOOM, F.raise_error(F.lit("no tiles below zoom 22"))).isNull(), kids)


def tile_key(x: Column, y: Column, zoom: Column) -> Column:
    """Sort key: zoom, then column, then row."""
    return F.shiftleft(zoom.cast("long"), 48).bitwiseOR(F.shiftleft(x.cast("long"), 24)).bitwiseOR(y.cast("long"))


def tile_of_key(key: Column) -> tuple[Column, Column, Column]:
    mask = (1 << 24) - 1
    return F.shiftright(key, 24).bitwiseAND(F.lit(mask)).cast("int"), key.bitwiseAND(F.lit(mask)).cast("int"), F.shiftright(key, 48).cast("int")


def local_x(lon: Column, x: Column, zoom, extent: int = 4096) -> Column:
    """Position inside a tile, not rounded; may leave [0, extent]."""
    return (world_x(lon) * side(zoom) - x) * extent


def local_y(lat: Column, y: Column, zoom, extent: int = 4096) -> Column:
    return (world_y(lat) * side(zoom) - y) * extent


def local_lon(px: Column, x: Column, zoom, extent: int = 4096) -> Column:
    return (x + px / extent) / side(zoom) * 360 - 180


def local_lat(py: Column, y: Column, zoom, extent: int = 4096) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (y + py / extent) / side(zoom)))))


def tolerance(zoom) -> Column:
    """Simplification tolerance in degrees: one unit of a tile of 4096."""
    return F.lit(360.0) / side(zoom) / 4096


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the sphere."""
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    return 2 * HAVERSINE_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def packed(degrees: Column, offset: float) -> Column:
    """What is left of a coordinate that was stored as a 32-bit float with an offset (256 for lon, 128 for lat)."""
    return (degrees + F.lit(offset)).cast("float").cast("double") - F.lit(offset)


def quantised(degrees: Column) -> Column:
    return F.round(degrees * 1e7).cast("int")


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether boxes share a point, edges included."""
    return (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"]) & (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"])


def in_box(lon: Column, lat: Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def box_of(points: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of array<struct<x,y>>; null for no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat")))


def expand(box: Column, fraction: float) -> Column:
    """The box grown on each side by a share of its width and height."""
    w, h = (box["max_lon"] - box["min_lon"]) * fraction, (box["max_lat"] - box["min_lat"]) * fraction
    return F.struct((box["min_lon"] - w).alias("min_lon"), (box["min_lat"] - h).alias("min_lat"), (box["max_lon"] + w).alias("max_lon"), (box["max_lat"] + h).alias("max_lat"))


def box_text(box: Column) -> Column:
    return F.format_string("%.6f,%.6f,%.6f,%.6f", box["min_lon"], box["min_lat"], box["max_lon"], box["max_lat"])


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring: positive if counter-clockwise."""
    here = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    after = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(here, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)


def wound(ring: Column, counter_clockwise: bool = True) -> Column:
    """The ring in the asked direction; one without area stays as it is."""
    a = twice_area(ring)
    return F.when(a < 0 if counter_clockwise else a > 0, F.reverse(ring)).otherwise(ring)


def closed_by_refs(refs: Column) -> Column:
    return (F.size(refs) >= 4) & (F.element_at(refs, 1) == F.element_at(refs, -1))


def pixel_x(lon: Column, min_lon: Column, max_lon: Column, width: int) -> Column:
    """Pixel column, rounded half up and clamped; 0 for a box without width."""
    span = max_lon - min_lon
    return F.when(span > 0, clamp(F.round((lon - min_lon) * (width - 1) / span), 0, width - 1)).otherwise(0).cast("int")


def pixel_y(lat: Column, min_lat: Column, max_lat: Column, height: int) -> Column:
    """Pixel row, north up."""
    span = max_lat - min_lat
    up = F.when(span > 0, F.round((lat - min_lat) * (height - 1) / span)).otherwise(0)
    return clamp(height - 1 - up, 0, height - 1).cast("int")


def snap(degrees: Column, step: float) -> Column:
    return F.floor(degrees / step) * step


def grid_key(lat: Column, lon: Column, step: float) -> Column:
    return F.format_string("%.2f_%.2f", snap(lat, step), snap(lon, step))


def elevation_file(lat: Column, lon: Column) -> Column:
    """Name of the elevation tile whose south-west corner is the floor of the position."""
    south, west = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.format_string("%s%02d%s%03d.hgt", F.when(south < 0, "S").otherwise("N"), F.abs(south), F.when(west < 0, "W").otherwise("E"), F.abs(west))


def label_angle(dx: Column, dy: Column) -> Column:
    """Direction in pixel space as 0-255."""
    return F.pmod(F.floor(F.pmod(F.atan2(dy, dx) * 128 / math.pi + 256, F.lit(256.0))), F.lit(256)).cast("int")


def view_zoom(view_degrees: Column) -> Column:
    """Tile zoom for a view of so many degrees."""
    return clamp(F.floor(F.log2(360.0 / view_degrees)), 0, 14).cast("int")


def view_box(lon: Column, lat: Column, view_degrees: Column, aspect: float) -> dict[str, Column]:
    w, h = view_degrees / 2, view_degrees / aspect / 2
    return {"min_lon": lon - w, "min_lat": lat - h, "max_lon": lon + w, "max_lat": lat + h}
