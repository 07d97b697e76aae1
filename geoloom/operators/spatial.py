"""Spatial joins and tile cover as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G


def cells(low: Column, high: Column, step: float) -> Column:
    """Indices of the grid cells that an interval touches."""
    return F.sequence(F.floor(low / step), F.floor(high / step))


def points_in_boxes(points: DataFrame, boxes: DataFrame, step: float = 10.0) -> DataFrame:
    """Every (box, point) with the point inside, edges included; box columns are prefixed ``b_``.

    A box lists its cells, a point has one, and the join is on the cell; so a
    pair meets once and nothing is compared with everything.
    """
    b = boxes.select(*(F.col(c).alias(f"b_{c}") for c in boxes.columns))
    b = b.withColumn("cx", F.explode(cells(F.col("b_min_lon"), F.col("b_max_lon"), step))).withColumn("cy", F.explode(cells(F.col("b_min_lat"), F.col("b_max_lat"), step)))
    p = points.withColumn("cx", F.floor(F.col("lon") / step)).withColumn("cy", F.floor(F.col("lat") / step))
    inside = G.in_box(F.col("lon"), F.col("lat"), F.col("b_min_lon"), F.col("b_min_lat"), F.col("b_max_lon"), F.col("b_max_lat"))
    return p.join(b, ["cx", "cy"]).filter(inside).drop("cx", "cy")


def boxes_meeting(left: DataFrame, right: DataFrame, step: float = 10.0) -> DataFrame:
    """Every pair of boxes that share a point; left and right columns are prefixed ``l_`` and ``r_``.

    Pairs that share several cells are reported by the first of them only.
    """
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)).withColumn("cx", F.explode(cells(F.col(f"{p}_min_lon"), F.col(f"{p}_max_lon"), step))).withColumn("cy", F.explode(cells(F.col(f"{p}_min_lat"), F.col(f"{p}_max_lat"), step)))
    both = side(left, "l").join(side(right, "r"), ["cx", "cy"])
    meet = G.boxes_meet({c: F.col(f"l_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")}, {c: F.col(f"r_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")})
    first = (F.col("cx") == F.floor(F.greatest("l_min_lon", "r_min_lon") / step)) & (F.col("cy") == F.floor(F.greatest("l_min_lat", "r_min_lat") / step))
    return both.filter(meet & first).drop("cx", "cy")


def in_range(features: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Features whose box meets the asked one; the comparisons reach the scan."""
    return features.filter((F.col("min_lon") <= max_lon) & (F.col("max_lon") >= min_lon) & (F.col("min_lat") <= max_lat) & (F.col("max_lat") >= min_lat))


def smallest_region(points: DataFrame, regions: DataFrame, step: float = 10.0) -> DataFrame:
    """id, region_id of the smallest box around each point; the first on ties."""
    area = (F.col("b_max_lon") - F.col("b_min_lon")) * (F.col("b_max_lat") - F.col("b_min_lat"))
    return points_in_boxes(points, regions, step).groupBy("id").agg(F.min(F.struct(area.alias("area"), F.col("b_id").alias("region_id"))).alias("m")).select("id", "m.region_id")


def nearest(clicks: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """click_id, id of the nearest point within ``radius`` degrees, longitudes scaled by the click's latitude; the smallest id on ties."""
    c = clicks.select(F.col("id").alias("click_id"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    reach = F.lit(radius) / F.greatest(F.cos(F.radians("c_lat")), F.lit(0.01))
    c = c.withColumn("cx", F.explode(cells(F.col("c_lon") - reach, F.col("c_lon") + reach, radius))).withColumn("cy", F.explode(cells(F.col("c_lat") - radius, F.col("c_lat") + radius, radius)))
    p = points.withColumn("cx", F.floor(F.col("lon") / radius)).withColumn("cy", F.floor(F.col("lat") / radius))
    d = F.pow(F.col("lat") - F.col("c_lat"), 2) + F.pow((F.col("lon") - F.col("c_lon")) * F.cos(F.radians("c_lat")), 2)
    near = p.join(c, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") < radius * radius)
    return near.groupBy("click_id").agg(F.min(F.struct("d", "id")).alias("m")).select("click_id", "m.id")


def tiles_of_boxes(boxes: DataFrame, min_zoom: Column, max_zoom: int) -> DataFrame:
    """Adds z, x, y of every tile that a box touches from its own smallest zoom on."""
    out = boxes.withColumn("z", F.explode(F.when(min_zoom <= max_zoom, F.sequence(min_zoom, F.lit(max_zoom))).otherwise(F.array().cast("array<int>"))))
    z = F.col("z")
    out = out.withColumn("x", F.explode(F.sequence(G.tile_x(F.col("min_lon"), z), G.tile_x(F.col("max_lon"), z))))
    return out.withColumn("y", F.explode(F.sequence(G.tile_y(F.col("max_lat"), z), G.tile_y(F.col("min_lat"), z))))


def tiles_of_points(points: DataFrame, min_zoom: Column, max_zoom: int) -> DataFrame:
    """Adds z, x, y of the tile of a point at every zoom from its own smallest on."""
    out = points.withColumn("z", F.explode(F.when(min_zoom <= max_zoom, F.sequence(min_zoom, F.lit(max_zoom))).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("x", G.tile_x(F.col("lon"), F.col("z"))).withColumn("y", G.tile_y(F.col("lat"), F.col("z")))


# Features of a tile at most, by the largest zoom they hold for.
TILE_CAPS = ((3, 5_000), (6, 20_000), (9, 60_000), (12, 150_000), (22, 500_000))


def tile_cap(zoom: Column) -> Column:
    out = F.lit(TILE_CAPS[-1][1])
    for top, cap in reversed(TILE_CAPS[:-1]):
        out = F.when(zoom <= top, cap).otherwise(out)
    return out


#: Shares of a crowded tile that are ranked by themselves.
SHARES = 32


def capped(tiled: DataFrame, ordinal: list[str], cap: Column) -> DataFrame:
    """The first features of every tile by ``ordinal``; run on ids, before geometry is joined.

    Tiles are counted first and only those beyond their cap are ranked: first
    inside ``SHARES`` shares of a tile, then what is left of them. So a tile that
    holds most features is never sorted whole in one task.
    """
    key, order = ["z", "x", "y"], ", ".join(ordinal)
    crowded = tiled.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max(cap).alias("cap")).filter("size > cap").select(*key, "cap")
    share = F.pmod(F.xxhash64(*ordinal), F.lit(SHARES))
    inside = tiled.join(crowded, key).withColumn("share", share).withColumn("rank", F.expr(f"row_number() over (partition by z, x, y, share order by {order})")).filter("rank <= cap")
    ranked = inside.withColumn("rank", F.expr(f"row_number() over (partition by z, x, y order by {order})")).filter("rank <= cap").select(*tiled.columns)
    return tiled.join(crowded, key, "left_anti").unionByName(ranked)


def first_per_cell(rows: DataFrame, cell: list[str], ordinal: list[str]) -> DataFrame:
    """The first row of every cell by ``ordinal``."""
    return rows.withColumn("rank", F.expr(f"row_number() over (partition by {', '.join(cell)} order by {', '.join(ordinal)})")).filter("rank = 1").drop("rank")
